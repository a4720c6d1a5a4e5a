"""Token ids in binary files: one zstandard frame per document, one dictionary for all.

Layout below a path: ``dictionary`` holds the shared dictionary and its SHA-256; ``packs`` holds
one row per pack, whose ``payload`` is this record, all numbers little-endian:

    8 bytes    magic "TOKPACK1"
    32 bytes   SHA-256 of the dictionary
    u32        width of an id in bytes (2 or 4)
    u32        number of documents n
    n x i64    document ids; n x u8: 1 where the id is not null
    n x u32    number of ids
    (n+1) x u64  offsets of the frames, counted from the end of the offsets
    frames     each the ids of a document, compressed alone

A document is read by its offset alone. Packs lie in the order of the keys; a pack knows how
many ids lie before it in its range, and ranges are summed up when the files are read. The
packs are rows of a Spark table, so they lie in any store that Spark writes, and a lost task's
output is never seen.

Null or empty text: a document without ids but the end id. Very long texts: encoded part by part, one
frame each. Null doc_id: ordered first. Ties in the id: by a hash of the text. Repeated rows: written
each. Empty table: no packs. Columns other than key and text are ignored.
"""

import hashlib
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from defectloom.llm.encoder import ChunkEncoder
from defectloom.llm.prefix import order_ranges
from defectloom.llm.pretoken import groups, read_spec
from defectloom.llm.store import ship

END_ID = 1
MAGIC = b"TOKPACK1"
HEAD = struct.Struct("<8s32sII")
PACK_BYTES = 4 << 20
PACK_DOCS = 65_536
# The dictionary is fitted on a sample: about so many documents, so many bytes of each.
SAMPLE_DOCS, SAMPLE_BYTES = 2_000, 8 << 10
DICTIONARY_BYTES = 64 << 10
LEVEL = 3


class LibraryEncoder(ChunkEncoder):
    """Ids of texts, those of new words by the tokenizers library."""

    def __init__(self, spec: str):
        super().__init__(spec)
        self.tokenize = self.splitter.library.model.tokenize

    def words(self, new) -> dict[str, bytes]:
        tokenize = self.tokenize
        return {word: array("I", [t.id for t in tokenize(word)]).tobytes() for word in new}

    def whole(self, chunk: str) -> bytes:
        return array("I", self.splitter.library.encode(chunk, add_special_tokens=False).ids).tobytes()


def _narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train_dictionary(docs: DataFrame, spec, width: int, key: str, text: str) -> bytes:
    """A dictionary of id arrays from a hashed sample of bounded size."""
    rows = docs.count()
    place = F.xxhash64(F.col(key), F.lit("dictionary")).bitwiseAND((1 << 62) - 1) / float(1 << 62)
    sample = docs.where(place * max(rows, 1) < SAMPLE_DOCS).select(F.col(text).alias("text"))

    def serialised(batches):
        encoder = LibraryEncoder.of(spec.value)
        for batch in batches:
            encoded = (ids for group in groups(batch.column(0)) for ids in encoder.encode(group))
            out = [_narrow(ids, width)[:SAMPLE_BYTES] for ids in encoded]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    # Repeated keys could put more rows than planned into the sample.
    found = sample.mapInArrow(serialised, "ids binary").limit(4 * SAMPLE_DOCS)
    samples = sorted(bytes(row.ids) for row in found.toLocalIterator() if row.ids)
    if len(samples) < 16:
        return b"".join(samples)[-DICTIONARY_BYTES:]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, threads=0).as_bytes()
    except zstandard.ZstdError:  # too little to learn from: the samples themselves
        return b"".join(samples)[-DICTIONARY_BYTES:]


class PackWriter:
    """Collects frames of one range and gives them back as packs."""

    def __init__(self, digest: bytes, width: int):
        self.digest, self.width = digest, width
        self.range, self.part, self.before = None, 0, 0
        self._reset()

    def _reset(self):
        self.keys, self.counts, self.frames, self.bytes = [], [], [], 0

    def add(self, rng: int, key: int | None, count: int, frame: bytes):
        if self.frames and (
            rng != self.range or self.bytes + len(frame) > PACK_BYTES or len(self.frames) >= PACK_DOCS
        ):
            yield self.pack()
        if rng != self.range:
            self.range, self.part, self.before = rng, 0, 0
        self.keys.append(key)
        self.counts.append(count)
        self.frames.append(frame)
        self.bytes += len(frame)

    def pack(self) -> dict:
        n, known = len(self.keys), [k for k in self.keys if k is not None]
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in self.frames])])
        payload = b"".join(
            [
                HEAD.pack(MAGIC, self.digest, self.width, n),
                np.array([k or 0 for k in self.keys], "<i8").tobytes(),
                np.array([k is not None for k in self.keys], "u1").tobytes(),
                np.array(self.counts, "<u4").tobytes(),
                offsets.astype("<u8").tobytes(),
                *self.frames,
            ]
        )
        row = {
            "range": self.range, "part": self.part, "first_id": min(known, default=None),
            "last_id": max(known, default=None), "n_docs": n, "n_ids": sum(self.counts),
            "ids_before": self.before, "payload": payload,
        }
        self.part += 1
        self.before += row["n_ids"]
        self._reset()
        return row


PACK_SCHEMA = (
    "range long, part int, first_id long, last_id long, n_docs long, n_ids long, ids_before long, "
    "payload binary"
)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    key: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode every text, add ``end_id`` and write the ids in ascending order of the keys."""
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(read_spec(tokenizer))
    size = max(LibraryEncoder(spec.value).splitter.library.get_vocab_size(), end_id + 1)
    width = 2 if size <= 1 << 16 else 4
    words = train_dictionary(docs, spec, width, key, text)
    digest = hashlib.sha256(words).digest()
    spark.createDataFrame([(digest, words)], "sha256 binary, dictionary binary").coalesce(1).write.parquet(
        f"{path}/dictionary"
    )
    end = array("I", [end_id]).tobytes()

    def compress(batches):
        encoder = LibraryEncoder.of(spec.value)
        packer = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=True
        )
        for batch in batches:
            counts, frames = [], []
            for group in groups(batch.column("text")):
                for ids in encoder.encode(group):
                    counts.append(len(ids) // 4 + 1)
                    frames.append(packer.compress(_narrow(ids + end, width)))
            columns = [*(batch.column(n) for n in ("_range", "key", "mark")), pa.array(counts, pa.int64()),
                       pa.array(frames, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["_range", "key", "mark", "n_ids", "frame"])

    def pack(batches):
        writer = PackWriter(digest, width)
        schema = pa.schema(
            [(n, pa.binary() if n == "payload" else pa.int32() if n == "part" else pa.int64())
             for n in (part.split()[0] for part in PACK_SCHEMA.split(", "))]
        )
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("_range", "key", "n_ids", "frame"))):
                for done in writer.add(*row):
                    yield pa.RecordBatch.from_pylist([done], schema)
        if writer.frames:
            yield pa.RecordBatch.from_pylist([writer.pack()], schema)

    keyed = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    # Texts that share an id, or have none, stand in the order of a hash, over as many ranges as they fill.
    keyed = keyed.withColumn("mark", F.xxhash64("text"))
    ranged = order_ranges(keyed, ["key", "mark"])(keyed).withColumn("_range", F.col("_range").cast("long"))
    frames = ranged.mapInArrow(compress, "_range long, key long, mark long, n_ids long, frame binary")
    ordered = frames.repartition("_range").sortWithinPartitions("_range", "key", "mark")
    ordered.mapInArrow(pack, PACK_SCHEMA).write.parquet(f"{path}/packs")


def _dictionary(spark: SparkSession, path: str) -> tuple[bytes, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    digest, words = bytes(row.sha256), bytes(row.dictionary)
    if hashlib.sha256(words).digest() != digest:
        raise ValueError(f"the dictionary below {path} is damaged")
    return digest, words


class Pack:
    """One pack's index; documents are decompressed one by one."""

    def __init__(self, payload: bytes, digest: bytes, unpacker):
        magic, own, self.width, n = HEAD.unpack_from(payload)
        if magic != MAGIC or own != digest:
            raise ValueError("a pack has another format or dictionary")
        at = HEAD.size
        self.keys = np.frombuffer(payload, "<i8", n, at)
        self.known = np.frombuffer(payload, "u1", n, at := at + 8 * n).astype(bool)
        self.counts = np.frombuffer(payload, "<u4", n, at := at + n)
        self.offsets = np.frombuffer(payload, "<u8", n + 1, at := at + 4 * n)
        self.at, self.payload, self.unpacker = at + 8 * (n + 1), memoryview(payload), unpacker

    def ids(self, k: int) -> np.ndarray:
        """The ids of the pack's k-th document."""
        start, end = self.at + int(self.offsets[k]), self.at + int(self.offsets[k + 1])
        return np.frombuffer(self.unpacker.decompress(self.payload[start:end]), f"<u{self.width}")


def _unpacker(words: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))


def _records(spark: SparkSession, path: str, packs: DataFrame, wanted=None) -> DataFrame:
    ship(spark)
    digest, words = _dictionary(spark, path)

    def unpack(batches):
        unpacker = _unpacker(words)
        for batch in batches:
            for before, payload in zip(*(batch.column(c).to_pylist() for c in ("ids_before", "payload"))):
                pack = Pack(payload, digest, unpacker)
                starts = before + np.cumsum(pack.counts, dtype=np.int64) - pack.counts
                picked = np.arange(len(pack.keys))
                if wanted is not None:
                    picked = picked[np.isin(pack.keys, wanted) & pack.known]
                for some in np.array_split(picked, max(1, len(picked) // 1024)):
                    ids = [pack.ids(k).astype("<u4") for k in some]
                    columns = [
                        pa.array(pack.keys[some], mask=~pack.known[some]),
                        pa.array(starts[some]),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()),
                        pa.array([i.tobytes() for i in ids], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "start", "n_ids", "crc32", "ids"])

    return packs.mapInArrow(unpack, "key long, start long, n_ids long, crc32 long, ids binary")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All documents of the files: key, start, n_ids, crc32 and ids (unsigned 32-bit) in order."""
    packs = spark.read.parquet(f"{path}/packs")
    # One row per range, of which there are a few thousand at most.
    totals = packs.groupBy("range").agg(F.sum("n_ids").alias("n"))
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset"))
    placed = packs.join(F.broadcast(offsets), "range")
    placed = placed.select((F.col("_offset") + F.col("ids_before")).alias("ids_before"), "payload")
    return _records(spark, path, placed)


def read_documents(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """A few documents by key: only the packs that may hold them are read, and only their frames.

    ``start`` counts within the range.
    """
    packs = spark.read.parquet(f"{path}/packs")
    may = F.lit(False)
    for k in keys:
        may = may | (F.col("first_id") <= k) & (F.col("last_id") >= k)
    return _records(spark, path, packs.where(may).select("ids_before", "payload"), np.array(keys))
