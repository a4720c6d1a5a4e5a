"""Contiguous shards of near-equal byte size, from global prefix sums of the sizes.

Sizes are summed per range of the order, the totals of the ranges are summed up, and the byte
offset of each row decides its shard: offset * shards / total. A shard differs from the target
by one document at most.

Null or empty text: size ``overhead`` only. Null doc_id: ordered first. Repeated rows: each has
its own slot. Empty table: no rows. Other columns are ignored.
"""

from pyspark.sql import Column, DataFrame, functions as F

from defectloom.llm.prefix import running_sums
from defectloom.llm.store import keep

SHARDS = 24
OVERHEAD = 8


def byte_size(text: str = "text", overhead: int = OVERHEAD) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def byte_shards(
    docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: key, size, text checksum, shard and slot in the shard."""
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        byte_size(text).alias("size"),
        F.crc32(F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))).alias("text_crc32"),
    )
    narrow = keep(narrow, "sizes")
    total = narrow.agg(F.sum("size")).scalar()
    placed = running_sums(narrow, ["doc_id", "text_crc32", "size"], {"_at": "size", "_pos": F.lit(1)})
    shard = F.least(F.lit(shards - 1), F.floor(F.col("_at") * shards / total)).cast("int")
    placed = keep(placed.select(*narrow.columns, "_pos", shard.alias("shard")), "placed")
    # One row per shard.
    first = placed.groupBy("shard").agg(F.min("_pos").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        *narrow.columns, "shard", (F.col("_pos") - F.col("_first")).cast("long").alias("slot")
    )


def write_shards(
    docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text"
) -> None:
    """Write the rows of ``docs``, whose keys identify them, to one folder per shard."""
    placed = byte_shards(docs, shards, key, text).select(F.col("doc_id").alias(key), "shard", "slot")
    rows = docs.drop("shard", "slot").join(placed, key)
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
