"""Quality rules: word and repetition counts of a document, and lines repeated across documents.

A line's normal form (ASCII lower case, white space runs as one blank) is hashed with 128 bits.
For each host the distinct documents with a line are counted; documents with the same text are
one document here, so copies alone make no line common. A line is removed where ``max_docs`` of
the host's documents have it, a number that does not grow with the host; in smaller hosts also
where at least ``min_docs`` and more than ``max_share`` of them have it. A document that fails a
base rule, or keeps less than ``min_left`` of its words, is rejected.

Null or empty text: no words, so it fails the base rule. Null source: a host of its own. Null
doc_id, repeated rows: each row has its own verdict, which depends on host and text alone. Empty
table: no rows. Other columns are ignored, or kept as they are by ``keep_good``.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from defectloom.llm.store import keep, packed, ship

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_SHARE = 0.1
MIN_DOCS = 20
MAX_DOCS = 20
MIN_LEFT = 0.3
# The characters that count as symbols, and those that part words.
SYMBOLS = b"#*$%&|<>"
BLANKS = " \t\n\v\f\r"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = f"struct<{', '.join(f'{n}: long' for n in COUNTS)}, lines: array<binary>, line_words: array<int>>"
_symbol = np.isin(np.arange(256), list(SYMBOLS))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words that the text has more than once.

    Windows grow by doubling: a window is known by the ranks of its two halves, and only places
    whose halves both occur again are looked at further.
    """
    n = len(words)
    if n <= window:
        return 0
    names: dict[bytes, int] = {}
    rank = np.fromiter(map(names.setdefault, words, range(n)), np.int64, n)
    again = (np.bincount(rank, minlength=n) > 1)[rank]
    size = 1
    while size < window:
        step = min(size, window - size)
        places = n - size - step + 1
        at = np.nonzero(again[:places] & again[step : step + places])[0]
        _, own, times = np.unique(rank[at] * n + rank[at + step], return_inverse=True, return_counts=True)
        more = times[own] > 1
        at, size = at[more], size + step
        again, rank = np.zeros(places, bool), np.zeros(places, np.int64)
        again[at], rank[at] = True, own[more]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edges) > 0))


def measure(text: str | None, host: str | None) -> dict:
    """Counts of one text, and for each line with a word its hash within the host and its words."""
    text = text or ""
    prefix = b"-" if host is None else b"+" + host.encode("utf-8", "surrogatepass") + b"\0"
    words, lines, line_words, seen, repeats = [], [], [], set(), 0
    for line in text.split("\n"):
        raw = line.encode("utf-8", "surrogatepass")
        own = raw.split()
        if own:
            words += own
            lines.append(xxhash.xxh3_128_digest(prefix + b" ".join(own).lower()))
            line_words.append(len(own))
            repeats += raw in seen
            seen.add(raw)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, BLANKS)),
        "n_symbols": int(np.count_nonzero(_symbol[data])),
        "n_dup_lines": repeats,
        "n_repeat_words": repeated_words(words),
        "lines": lines,
        "line_words": line_words,
    }


_MEASURE_TYPE = pa.struct(
    [(n, pa.int64()) for n in COUNTS] + [("lines", pa.list_(pa.binary())), ("line_words", pa.list_(pa.int32()))]
)


def _measured(text: str, host: str) -> Column:
    @F.arrow_udf(MEASURES)
    def measures(texts: pa.Array, hosts: pa.Array) -> pa.Array:
        return pa.array([measure(t.as_py(), h.as_py()) for t, h in zip(texts, hosts)], _MEASURE_TYPE)

    return measures(F.col(text), F.col(host))


def _own_key(host: str, text: str) -> Column:
    """Names a document by host and text."""
    known = F.when(F.col(host).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(host), F.lit("\0")))
    return F.unhex(F.md5(F.concat(known, F.coalesce(F.col(text), F.lit(""))).cast("binary")))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def _judged(docs, key, host, text, max_share, min_docs, min_left, max_docs) -> tuple[DataFrame, DataFrame]:
    """The measures of each row with its verdict, and the lines removed from each document."""
    ship(docs.sparkSession)
    measured = docs.select(
        F.col(key).alias("doc_id"), F.col(host).alias("host"), _own_key(host, text).alias("own"),
        _measured(text, host).alias("m"),
    ).select("doc_id", "host", "own", "m.*")
    measured = keep(measured, "measured")
    # Each host's documents, copies once.
    distinct = measured.groupBy("own").agg(
        *[F.any_value(n).alias(n) for n in ("host", "n_words", "lines", "line_words")]
    )
    distinct = keep(distinct, "distinct")
    hosts = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    counted = distinct.select("host", F.explode(F.array_distinct("lines")).alias("line"))
    counted = counted.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.where(F.col("n") >= min(min_docs, max_docs))
    hosts = hosts.withColumnRenamed("host", "_host")
    common = counted.join(hosts, F.col("host").eqNullSafe(F.col("_host")))
    of_small = (F.col("n") >= min_docs) & (F.col("n") > max_share * F.col("docs"))
    common = keep(common.where((F.col("n") >= max_docs) | of_small).select("line"), "common")
    lines = distinct.select("own", F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
    lines = lines.select("own", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    removed = lines.join(common, "line").groupBy("own").agg(
        F.sum("words").alias("lost"), F.collect_set("line").alias("removed")
    )
    removed = keep(removed, "removed")
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    judged = measured.drop("host", "lines", "line_words").join(removed.drop("removed"), "own", "left")
    judged = judged.withColumn("base_failed", base_failed())
    good = ~F.col("base_failed") & (left >= min_left * F.col("n_words"))
    return judged.select("own", "doc_id", *COUNTS, "base_failed", left.alias("n_left"), good.alias("kept")), removed


def quality(
    docs: DataFrame,
    key: str = "doc_id",
    host: str = "source",
    text: str = "text",
    max_share: float = MAX_SHARE,
    min_docs: int = MIN_DOCS,
    min_left: float = MIN_LEFT,
    max_docs: int = MAX_DOCS,
) -> DataFrame:
    """One row per document: its counts, the words left without common lines, the verdict."""
    return _judged(docs, key, host, text, max_share, min_docs, min_left, max_docs)[0].drop("own")


def keep_good(
    docs: DataFrame,
    key: str = "doc_id",
    host: str = "source",
    text: str = "text",
    max_share: float = MAX_SHARE,
    min_docs: int = MIN_DOCS,
    min_left: float = MIN_LEFT,
    max_docs: int = MAX_DOCS,
) -> DataFrame:
    """The documents that pass, without their common lines; the other columns as they are."""
    judged, removed = _judged(docs, key, host, text, max_share, min_docs, min_left, max_docs)
    good = judged.where("kept").select("own").distinct().join(removed.drop("lost"), "own", "left")
    good = keep(good.select("own", "removed"), "good")

    @F.arrow_udf("string")
    def without(texts: pa.Array, hosts: pa.Array, gone: pa.Array) -> pa.Array:
        return pa.array([_without(t.as_py(), h.as_py(), g.as_py()) for t, h, g in zip(texts, hosts, gone)], pa.string())

    rows = packed(docs, host=host, text=text).withColumn("own", _own_key("host", "text")).join(good, "own")
    shorter = F.when(F.col("removed").isNull(), F.col("text")).otherwise(
        without(F.col("text"), F.col("host"), F.coalesce("removed", F.array().cast("array<binary>")))
    )
    return rows.select(F.col("row").withField(f"`{text}`", shorter).alias("row")).select("row.*")


def _without(text: str, host: str | None, gone: list[bytes]) -> str:
    if not gone:
        return text
    prefix = b"-" if host is None else b"+" + host.encode("utf-8", "surrogatepass") + b"\0"
    gone, left = set(gone), []
    for line in text.split("\n"):
        own = line.encode("utf-8", "surrogatepass").lower().split()
        if not own or xxhash.xxh3_128_digest(prefix + b" ".join(own)) not in gone:
            left.append(line)
    return "\n".join(left)
