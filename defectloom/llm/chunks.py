"""Exact dedup by recipes of content-defined chunks.

Each text, with its runs of white space as single blanks, is cut where the bytes around a place say
so, so equal passages give equal chunks wherever they stand. A text's recipe is the ordered list of
its chunks' identifiers. Texts stay where they are: only recipes are grouped. For recipes that more
than one document has, each task sends every chunk once, and chunks with one digest are compared byte
by byte: a digest stands for one content, or else each content gets a number of its own in the
recipe. Then documents with equal recipes have equal texts, and the one with the smallest id stays.

Null text: counts as empty; empty texts are equal to each other. Very long texts: cut in chunks of
``MAX_CHUNK`` bytes at most; only recipes, 16 bytes per chunk, are shuffled whole. Ties: of rows that
share an id and a text, one stays. Null ids: after all others, so such a row stays only in a group
without ids. Repeated rows: each has its row, and counts. Empty table: no rows. Other columns are
ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from defectloom.llm.hashsets import bitmap, knows
from defectloom.llm.store import keep, ship

# Bytes of a chunk: at least, on average above that, at most.
MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 1 << 10, 1 << 12, 1 << 16
WINDOW = 16
DIGEST_BYTES = 16
# Chunks that a task remembers as sent, and bytes of a batch of them.
_SENT_AT_ONCE = 8 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPACES = b" \t\n\x0b\x0c\r"


def normalised(text: str | None) -> bytes:
    """The text's bytes, with one blank for each run of blanks, tabs, line and page breaks."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = b" ".join(data.split())
    if not out:
        return data[:1] and b" "
    return b" " * (data[0] in _SPACES) + out + b" " * (data[-1] in _SPACES)


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks: after a window whose hash is small, within the bounds of sizes."""
    if len(data) <= 2 * MIN_CHUNK:
        return [len(data)] if data else []
    ends, last = [], 0
    for start in range(0, len(data) - WINDOW + 1, _SENT_AT_ONCE):
        size = min(_SENT_AT_ONCE, len(data) - WINDOW + 1 - start)
        early = np.ndarray((size,), "<u8", data, start, (1,))
        late = np.ndarray((size,), "<u8", data, start + WINDOW // 2, (1,))
        h = early * _ODD[0] + late * _ODD[1]
        h ^= h >> np.uint64(32)
        h *= _ODD[0]
        for place in np.flatnonzero(h < np.uint64((1 << 64) // MEAN_CHUNK)).tolist():
            end = place + start + WINDOW
            while end - last > MAX_CHUNK:
                last += MAX_CHUNK
                ends.append(last)
            if end - last >= MIN_CHUNK:
                last = end
                ends.append(last)
    while len(data) - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


def chunk_list(data: bytes) -> list[bytes]:
    ends = cut_points(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def _known(bits: np.ndarray, recipe: bytes) -> bool:
    """Whether the bitmap may hold the recipe, by the hash that Spark's ``xxhash64`` gives."""
    return bool(knows(bits, np.array([xxhash.xxh64_intdigest(recipe, 42)], np.uint64))[0])


def recipes(docs: DataFrame, key: str = "doc_id", text: str = "text", digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """(row, key, text_sha256, recipe) of each document, written; ``row`` numbers the rows."""
    ship(docs.sparkSession)

    def scan(batches):
        for batch in batches:
            shas, lists = [], []
            for text in batch.column(2):
                data = normalised(text.as_py())
                shas.append(hashlib.sha256(data).hexdigest())
                lists.append(b"".join(_digest(chunk, digest_bytes) for chunk in chunk_list(data)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(shas), pa.array(lists, pa.binary())],
                ["row", "key", "text_sha256", "recipe"],
            )

    own = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t")
    )
    kind = own.schema["key"].dataType.simpleString()
    return keep(own.mapInArrow(scan, f"row long, key {kind}, text_sha256 string, recipe binary"), "recipes")


def _sent_chunks(docs: DataFrame, text: str, known, digest_bytes: int) -> DataFrame:
    """(digest, chunk), each task's chunks of documents whose recipe the bitmap knows, mostly once."""

    def scan(batches):
        sent, held, size = {}, [], 0
        for batch in batches:
            for text in batch.column(0):
                chunks = chunk_list(normalised(text.as_py()))
                digests = [_digest(chunk, digest_bytes) for chunk in chunks]
                if not _known(known.value, b"".join(digests)):
                    continue
                for digest, chunk in zip(digests, chunks):
                    if sent.get(digest) != chunk:
                        sent[digest] = chunk
                        held.append((digest, chunk))
                        size += len(chunk)
                if size > _SENT_AT_ONCE:
                    yield _pairs(held)
                    sent, held, size = {}, [], 0
        if held:
            yield _pairs(held)

    return docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(scan, "digest binary, chunk binary")


def _pairs(held: list) -> pa.RecordBatch:
    digests, chunks = zip(*held)
    return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(chunks, pa.binary())], ["digest", "chunk"])


def _renamed(docs: DataFrame, text: str, known, twice: DataFrame, digest_bytes: int) -> DataFrame:
    """(text_sha256, names): which content stands behind each ambiguous digest of a text, in order."""

    def scan(batches):
        for batch in batches:
            for text in batch.column(0):
                data = normalised(text.as_py())
                chunks = chunk_list(data)
                digests = [_digest(chunk, digest_bytes) for chunk in chunks]
                if chunks and _known(known.value, b"".join(digests)):
                    n, sha = len(chunks), hashlib.sha256(data).hexdigest()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([sha] * n), pa.array(range(n), pa.int64()), pa.array(digests, pa.binary()),
                         pa.array(chunks, pa.binary())],
                        ["text_sha256", "place", "digest", "chunk"],
                    )

    found = docs.select(F.col(f"`{text}`").alias("t"))
    found = found.mapInArrow(scan, "text_sha256 string, place long, digest binary, chunk binary")
    named = found.join(twice, ["digest", "chunk"]).select("text_sha256", "place", "number").distinct()
    listed = named.groupBy("text_sha256").agg(F.sort_array(F.collect_list(F.struct("place", "number"))).alias("l"))
    return listed.select("text_sha256", F.array_join(F.transform("l", lambda e: e["number"]), ",").alias("names"))


def exact_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", digest_bytes: int = DIGEST_BYTES
) -> DataFrame:
    """One row per document: key, keep (the key of the row that stays), group_size, kept, text_sha256.

    ``digest_bytes`` is the size of a chunk's digest; right results don't depend on it.
    """
    spark = docs.sparkSession
    made = recipes(docs, key, text, digest_bytes)
    shared = made.groupBy("recipe").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND length(recipe) > 0")
    marks = keep(shared.select(F.xxhash64("recipe").alias("mark")), "marks")
    names = F.lit("")
    if marks.take(1):
        known = spark.sparkContext.broadcast(bitmap(marks))
        sent = _sent_chunks(docs, text, known, digest_bytes).distinct()
        # A digest has one content, but for collisions, so its group is one row.
        number = F.row_number().over(W.partitionBy("digest").orderBy("chunk"))
        sides = F.count(F.lit(1)).over(W.partitionBy("digest"))
        twice = sent.withColumns({"number": number, "sides": sides}).where("sides > 1")
        twice = keep(twice.select("digest", "chunk", "number"), "ambiguous")
        if twice.take(1):
            made = made.join(_renamed(docs, text, known, twice, digest_bytes), "text_sha256", "left")
            names = F.coalesce("names", F.lit(""))
    made = made.withColumn("ids", F.concat(F.encode(names, "utf-8"), F.lit(b"/"), "recipe"))
    first = F.min(F.struct(F.col("key").isNull().alias("late"), "key", "row"))
    groups = made.groupBy("ids").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    groups = groups.where("n > 1")
    found = made.join(groups, "ids", "left")
    alone = F.col("n").isNull()
    return found.select(
        "key",
        F.when(alone, F.col("key")).otherwise(F.col("first.key")).alias("keep"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
        "text_sha256",
    )
