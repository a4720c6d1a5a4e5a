"""Phrase collocations: runs of two to five words that occur often and more than by chance.

The first pass finds every run that can be frequent, without a counter for each run there is. Runs
are dealt to hash partitions by their hash. A task keeps a Misra-Gries summary per partition, and the
summaries of a partition are merged; their capacity exceeds the partition's mass over the
threshold, so no frequent run is missing. What a partition has really lost is carried along: if it
reaches the threshold, the pass is repeated with more room. Words go first, then pairs of words that
can be frequent, then longer runs of such pairs, since no part of a frequent run is rarer than it.

The second pass counts exactly: tasks add up the runs that a bitmap of the first pass's hashes knows,
and send them by hash partition, where the counts of a phrase are summed by its text. The bitmap has a fixed greatest size; what it
wrongly knows is counted as exactly and falls below the threshold.

Each group of documents (``lang``; null counts as ``und``) is scored alone. A phrase of a occurrences
cut after k words has score floor(1000 * a * n / (l * r)), with n the group's words and l and r the
occurrences of its two parts; the lowest score of all cuts counts, the smallest k on ties. Phrases
inside a longer candidate as frequent as themselves go.

Null and empty texts: no words. Very long texts: worked on in slices of about a megabyte, nothing of
them left out. Ties: by occurrences, then by the phrase's bytes. Repeated rows: each counts.
Empty table, or no phrase that is frequent: no rows. Other columns are ignored.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from defectloom.llm.hashsets import bitmap, knows
from defectloom.llm.store import keep, ship
from defectloom.llm.summaries import Summary, tally
from defectloom.llm.wordstream import LONGEST, slices

THRESHOLD = 100
TOP = 2000
NO_GROUP = "und"
# Counters of a hash partition, at least and in large tables; how many times the mass over the threshold
# they are; hash partitions at least, and counters a task holds before it sends them.
CAPACITY, MAX_CAPACITY, ROOM, MIN_PARTS, HELD = 1 << 16, 1 << 20, 16, 64, 1 << 20
# Runs that a hash partition of the second pass holds on average.
PART_RUNS = 1 << 14
_SENT = "part long, grp string, mass long, lost long, hashes binary, counts binary"


class _Held:
    """What a task has counted and not yet sent."""

    def __init__(self, parts: int, capacity: int):
        self.bits, self.capacity = parts.bit_length() - 1, capacity
        self.hashes, self.counts, self.mass = [], [], 0
        self.size = 0

    def add(self, hashes: np.ndarray) -> None:
        hashes, counts = tally(hashes)
        self.hashes.append(hashes)
        self.counts.append(counts)
        self.size += len(hashes)
        if self.size > 2 * HELD:
            self._merge()

    def _merge(self) -> None:
        hashes, counts = tally(np.concatenate(self.hashes), np.concatenate(self.counts))
        self.hashes, self.counts, self.size = [hashes], [counts], len(hashes)

    def rows(self):
        """A summary per hash partition; the hashes stand in order, so a partition is a range."""
        if not self.size:
            return
        self._merge()
        hashes, counts = self.hashes[0], self.counts[0]
        part = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part)) + 1
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]):
            own = Summary(self.capacity)
            own.add(hashes[first:last], counts[first:last])
            mass = int(counts[first:last].sum())
            yield int(part[first]), None, mass, own.lost, own.hashes.tobytes(), own.counts.astype("<i8").tobytes()
        self.hashes, self.counts, self.size = [], [], 0


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = [field.split()[0] for field in _SENT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _group_number(name: str) -> int:
    """A number that stands for the group in hashes."""
    return xxhash.xxh64_intdigest(name.encode("utf-8", "replace"), 7) >> 1


def _numbered(batch, names: dict[int, str]) -> list[int]:
    groups = batch.column(1).to_pylist()
    numbers = {g: _group_number(g) for g in set(groups)}
    names.update({n: g for g, n in numbers.items()})
    return [numbers[g] for g in groups]


def _runs(part, lengths: range, known):
    """The hashes of all unbroken runs whose words, and pairs below longer runs, may be frequent."""
    words = hashes = part.words(0)
    whole = np.ones(len(words), bool) if known is None else knows(known, words)
    pairs = None
    for n in range(1, lengths.stop):
        if n > 1:
            hashes = part.longer(hashes, words, n)
            whole = part.unbroken(whole[:-1] & (whole[1:] if n == 2 else pairs[n - 2 :]), n)
        if n == 2 and lengths.start > 2:
            at = np.flatnonzero(whole)
            whole[at] = knows(known, hashes[at])
        if n == 2:
            pairs = whole
        if n in lengths:
            yield hashes[np.flatnonzero(whole[: part.own])]


def _summaries(docs: DataFrame, lengths: range, known, parts: int, capacity: int) -> DataFrame:
    """Each task's summaries per hash partition, and for words its number of them per group."""
    count_words = lengths.start == 1

    def scan(batches):
        bits = None if known is None else known.value
        held, names, totals = _Held(parts, capacity), {}, {}
        for batch in batches:
            numbers = _numbered(batch, names)
            for part in slices((t.as_py() for t in batch.column(0)), numbers):
                if count_words:
                    for g, n in zip(*np.unique(part.group[: part.own], return_counts=True)):
                        totals[int(g)] = totals.get(int(g), 0) + int(n)
                for hashes in _runs(part, lengths, bits):
                    held.add(hashes)
                if held.size > HELD:
                    held._merge()
                    if held.size > HELD:
                        yield _batch(list(held.rows()))
        rows = list(held.rows()) + [(-1, names[g], n, 0, b"", b"") for g, n in totals.items()]
        if rows:
            yield _batch(rows)

    return docs.mapInArrow(scan, _SENT)


def _merged(sent: DataFrame, capacity: int, threshold: int) -> DataFrame:
    """What may be frequent: (part, lost, hash), the hash null in a row that says what was lost."""

    def merge(batches):
        at, own, waiting, size = None, None, [], 0

        def take():
            lost, hashes, counts = zip(*waiting)
            own.add(np.concatenate(hashes), np.concatenate(counts), sum(lost))
            waiting.clear()

        def done():
            take()
            found = np.concatenate([own.possible(threshold).view(np.int64), np.zeros(1, np.int64)])
            missing = np.arange(len(found)) == len(found) - 1
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), x)) for x in (at, own.lost)] + [pa.array(found, mask=missing)],
                ["part", "lost", "hash"],
            )

        for batch in batches:
            for part, lost, hashes, counts in zip(*(batch.column(k) for k in range(4))):
                if part.as_py() != at:
                    if own is not None:
                        yield done()
                    at, own, size = part.as_py(), Summary(capacity), 0
                some = np.frombuffer(hashes.as_buffer(), "<u8"), np.frombuffer(counts.as_buffer(), "<i8")
                waiting.append((lost.as_py(), *some))
                size += len(some[0])
                if size > capacity:
                    take()
                    size = 0
        if own is not None:
            yield done()

    dealt = sent.where("part >= 0").select("part", "lost", "hashes", "counts").repartition("part")
    return dealt.sortWithinPartitions("part").mapInArrow(merge, "part long, lost long, hash long")


def _possible(docs: DataFrame, lengths: range, known, mass: int, threshold: int, capacity: int):
    """(hashes of runs that may be frequent, words per group) as written tables."""
    totals = None
    # With room to spare little is lost, and so little passes that isn't frequent.
    counters = ROOM * mass // threshold
    capacity = max(capacity, min(MAX_CAPACITY, counters >> 12))
    while True:
        parts = max(MIN_PARTS, 1 << (counters // capacity).bit_length())
        sent = _summaries(docs, lengths, known, parts, capacity)
        if lengths.start == 1:
            # The words per group are read from it as well.
            sent = keep(sent, "words")
            totals = keep(sent.where("part < 0").groupBy("grp").agg(F.sum("mass").alias("n")), "totals")
        found = keep(_merged(sent, capacity, threshold), f"possible{lengths.start}")
        if not found.where(F.col("lost") >= threshold).take(1):
            return found.where("hash IS NOT NULL").select("hash"), totals
        capacity, counters = 4 * capacity, 4 * counters


def _exact(docs: DataFrame, known, parts: int) -> DataFrame:
    """(part, entries, counts): each task's exact counts of the runs that may be frequent, a list of
    them per hash partition. An entry is a phrase, a line break and its group."""
    shift = 65 - parts.bit_length()

    def scan(batches):
        bits, names, found = known.value, {}, {}

        def rows():
            order = sorted(found, key=lambda k: k[0])
            part = np.array([k[0] for k in order], np.uint64) >> np.uint64(shift)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).astype(np.int32)
            entries = pa.array([found[k][0] for k in order], pa.string())
            counts = pa.array([found[k][1] for k in order], pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(part[cuts[:-1]].astype(np.int64)), pa.ListArray.from_arrays(cuts, entries),
                 pa.ListArray.from_arrays(cuts, counts)],
                ["part", "entries", "counts"],
            )

        for batch in batches:
            numbers = _numbered(batch, names)
            for part in slices((t.as_py() for t in batch.column(0)), numbers):
                _count(part, bits, names, found)
                if len(found) > HELD // 4:
                    yield rows()
                    found.clear()
        if found:
            yield rows()

    return docs.mapInArrow(scan, "part long, entries array<string>, counts array<long>")


def _summed(sent: DataFrame, threshold: int) -> DataFrame:
    """(grp, phrase, words, f) of the runs that are frequent; a task holds one hash partition at a time."""

    def merge(batches):
        at, totals = None, {}

        def done():
            kept = [(*entry.split("\n", 1), n) for entry, n in totals.items() if n >= threshold]
            phrases, groups, counts = zip(*kept) if kept else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(groups, pa.string()), pa.array(phrases, pa.string()),
                 pa.array([p.count(" ") + 1 for p in phrases], pa.int32()), pa.array(counts, pa.int64())],
                ["grp", "phrase", "words", "f"],
            )

        for batch in batches:
            for part, entries, counts in zip(*(batch.column(k) for k in range(3))):
                if part.as_py() != at:
                    yield done()
                    at, totals = part.as_py(), {}
                for entry, n in zip(entries.as_py(), counts.as_py()):
                    totals[entry] = totals.get(entry, 0) + n
        yield done()

    dealt = sent.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(merge, "grp string, phrase string, words int, f long")


def _count(part, bits, names: dict[int, str], found: dict) -> None:
    """Add a slice's runs that the bitmap knows to ``found``, by two hashes of 64 bits."""
    words, others = part.words(0), part.words(1)
    hashes, checks = words, others
    whole = knows(bits, words)
    for n in range(1, LONGEST + 1):
        if n > 1:
            hashes, checks = part.longer(hashes, words, n), part.longer(checks, others, n)
            whole = part.unbroken(whole[:-1] & whole[1:], n)
            at = np.flatnonzero(whole)
            whole[at] = knows(bits, hashes[at])
        at = np.flatnonzero(whole[: part.own])
        if not len(at):
            continue
        # Equal by both hashes: 128 bits.
        order = at[np.lexsort((checks[at], hashes[at]))]
        h, c = hashes[order], checks[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
        counts = np.diff(np.append(first, len(order)))
        for k, a, b, count in zip(order[first].tolist(), h[first].tolist(), c[first].tolist(), counts.tolist()):
            entry = found.get((a, b, n))
            if entry is None:
                found[a, b, n] = [f"{part.text(k, n)}\n{names[int(part.group[k])]}", count]
            else:
                entry[1] += count


def frequent_runs(
    docs: DataFrame, text: str = "text", group: str = "lang", threshold: int = THRESHOLD, capacity: int = CAPACITY
) -> tuple[DataFrame, DataFrame]:
    """(grp, phrase, words, f) of all runs of one to five words that occur ``threshold`` times, and
    (grp, n) with the number of words of each group."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col(f"`{text}`").alias("t"), F.coalesce(F.col(f"`{group}`"), F.lit(NO_GROUP)).alias("g"))
    # Between two words stands a byte at least.
    mass = own.agg(F.sum(F.octet_length("t") + 1)).first()[0] or 0
    words, totals = _possible(own, range(1, 2), None, mass // 2 + 1, threshold, capacity)
    mass = totals.agg(F.sum("n")).first()[0] or 0
    every = words
    for lengths in (range(2, 3), range(3, LONGEST + 1)):
        known = spark.sparkContext.broadcast(bitmap(every))
        more, _ = _possible(own, lengths, known, mass * len(lengths), threshold, capacity)
        every = every.unionByName(more)
    known = spark.sparkContext.broadcast(bitmap(every))
    parts = max(MIN_PARTS, 1 << (every.count() // PART_RUNS).bit_length())
    return keep(_summed(_exact(own, known, parts), threshold), "frequent"), totals


def _exact_number(name: str) -> Column:
    return F.col(name).cast("decimal(38,0)")


def collocations(
    docs: DataFrame, text: str = "text", group: str = "lang", threshold: int = THRESHOLD, top: int = TOP,
    capacity: int = CAPACITY,
) -> DataFrame:
    """Each group's first ``top`` phrases: grp, rank, phrase, a, l, r, n, score."""
    runs, totals = frequent_runs(docs, text, group, threshold, capacity)
    longer = runs.where("words > 1").select("grp", "phrase", "words", F.col("f").alias("a"))
    parts = F.split("phrase", " ")

    def joined(start, size):
        return F.array_join(F.slice("parts", start, size), " ")

    split = longer.withColumn("parts", parts).withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    split = split.withColumns({"head": joined(F.lit(1), F.col("k")), "rest": joined(F.col("k") + 1, F.col("words"))})
    count = runs.select("grp", "phrase", "f")
    heads = count.select("grp", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = count.select("grp", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    product = F.lit(1000).cast("decimal(38,0)") * _exact_number("a") * _exact_number("n")
    scored = (
        split.drop("parts").join(heads, ["grp", "head"]).join(rests, ["grp", "rest"]).join(totals, "grp")
        .withColumns({"_p": product, "_q": _exact_number("l") * _exact_number("r")})
        .withColumn("score", F.expr("_p div _q"))
    )
    best = scored.groupBy("grp", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Each phrase's parts, with the most frequent phrase that holds them.
    held = longer.withColumn("parts", parts).withColumn("size", F.explode(F.expr("sequence(1, words - 1)")))
    held = held.where("size > 1").withColumn("start", F.explode(F.expr("sequence(1, words - size + 1)")))
    held = held.select("grp", joined(F.col("start"), F.col("size")).alias("phrase"), "a")
    held = held.groupBy("grp", "phrase").agg(F.max("a").alias("most"))
    alone = best.join(held, ["grp", "phrase"], "left").where("most IS NULL OR most < a")
    order = W.partitionBy("grp").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = alone.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(
        "grp", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )
