"""Mixing sources to target weights by entropy balancing.

Targets: the sources share the words of the whole corpus by weight, none more than ``most`` times
its own words; what a source can't take goes to the others by weight. Rates: among all rates
between 0 and ``most`` that bring a source's words to its target, those closest to one copy of
each document in the sense of entropy are min(most, exp(l * x)), x the document's size over its
source's mean and l the multiplier of the source's constraint. Newton steps on the convex dual
find all multipliers at once; each step is one aggregation over the counts of (source, size).

Copies: rates are summed up in order of source, size and a hash, in integers, and a document's
copies are the whole numbers its rate steps over. It gets its rate rounded up or down, and the
rounding of a source adds up to the size of its largest document at most. What is left of a
source's target is then made up, round by round, by one copy more or less of the document whose
size comes nearest to it.

Null or empty text: size zero, one copy. Null source: a source of its own, last in order. Null
doc_id, repeated rows: each row is a document. Empty table: no rows. Other columns are ignored,
or kept as they are by ``mix``.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from defectloom.llm.prefix import running_sums
from defectloom.llm.store import keep, packed, row_marks

WEIGHTS = (1, 2, 3)
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"
UNIT = 1 << 24
STEPS = 60
CLOSE = 1e-7
TOUCHES = 4


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source``, ``docs``, ``source_size`` and ``target`` from rows of (source, size, n)."""
    sources = sizes.groupBy("source").agg(
        F.sum("n").alias("docs"), F.sum(F.col("size") * F.col("n")).alias("source_size")
    )
    sources = sources.withColumn("_last", F.col("source").isNull())
    ranked = running_sums(keep(sources, "sources"), ["_last", "source"], {"_rank": F.lit(1)})
    place = F.pmod("_rank", F.lit(len(weights))) + 1
    weight = F.element_at(F.array(*map(F.lit, weights)), place.cast("int")).cast("long")
    ranked = keep(ranked.withColumn("weight", weight).drop("_last", "_rank"), "ranked")
    total, shares = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    # A source is full once its weight's part of what is left exceeds what it may take. Filling
    # sources raises the part of the others, so this goes up until no further source is full.
    rest, open_weight = total or 0, shares or 1
    while True:
        full = most * F.col("source_size") * open_weight < rest * F.col("weight")
        taken, left = ranked.agg(
            F.sum(F.when(full, most * F.col("source_size")).otherwise(0)),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))),
        ).first()
        now = ((total or 0) - (taken or 0), left or 1)
        if now == (rest, open_weight):
            break
        rest, open_weight = now
    share = (F.lit(rest) * F.col("weight")).cast("double") / open_weight
    target = F.when(full, (most * F.col("source_size")).cast("double")).otherwise(share)
    return ranked.select("source", "docs", "source_size", target.alias("target"))


def _rate(lam: str, size: str, mean: str, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.col(lam) * F.col(size) / F.col(mean)))


def multipliers(sizes: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """Add ``mean`` and the multiplier ``lam`` to ``targets``.

    A step is Newton's on the logarithm of the words taken; where it leaves the bracket of the
    root it halves or widens the bracket instead.
    """
    mean = F.when(F.col("source_size") > 0, F.col("source_size") / F.col("docs")).otherwise(1.0)
    full = F.col("target") >= most * F.col("source_size")
    infinite = float("inf")
    state = targets.withColumns(
        {
            "mean": mean,
            # A source that takes all it may has the limit of the multiplier.
            "lam": F.when((F.col("source_size") > 0) & full, F.lit(infinite)).otherwise(0.0),
            "low": F.lit(-infinite),
            "high": F.lit(infinite),
            "done": full | (F.col("source_size") == 0),
        }
    )
    state = keep(state, "state")
    for _ in range(STEPS):
        if not state.where("not done").take(1):
            break
        open_ = state.where("not done").select(F.col("source").alias("_source"), "lam", "mean")
        at = sizes.join(open_, F.col("source").eqNullSafe(F.col("_source")))
        rate = _rate("lam", "size", "mean", most)
        words = F.col("n") * rate * F.col("size")
        slope = F.when(rate < most, words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = at.groupBy("_source").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("_source")), "left")
        off = F.log(F.col("words") / F.col("target"))
        low = F.when(off < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") - off * F.col("words") / F.col("slope")
        halved = (
            F.when(high == infinite, F.greatest(2 * low, F.lit(1.0)))
            .when(low == -infinite, F.least(2 * high, F.lit(-1.0)))
            .otherwise((low + high) / 2)
        )
        inside = (F.col("slope") > 0) & (step > low) & (step < high)
        near = F.abs(off) <= CLOSE
        moved = F.when(F.col("done") | near, F.col("lam")).when(inside, step).otherwise(halved)
        state = joined.select(
            *targets.columns, "mean", moved.alias("lam"), low.alias("low"), high.alias("high"),
            (F.col("done") | near).alias("done"),
        )
        state = keep(state, "state")
    return state.select(*targets.columns, "mean", "lam")


def _copies(rows: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Add source_size, target and copies to rows of (source, size, _h, ...)."""
    sizes = keep(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    solved = keep(multipliers(sizes, keep(source_targets(sizes, weights, most), "targets"), most), "solved")
    solved = solved.withColumnRenamed("source", "_source")
    rated = rows.join(solved, F.col("source").eqNullSafe(F.col("_source")))
    rate = F.when(F.col("size") == 0, 1.0).otherwise(_rate("lam", "size", "mean", most))
    rated = rated.select(
        *rows.columns, "source_size", "target", F.round(rate * UNIT).cast("long").alias("_rate")
    )
    rated = keep(rated, "rated")
    order = ["source", "size", "_h", "_g"]
    summed = running_sums(rated, order, {"_at": "_rate", "_pos": F.lit(1)})
    # A document without words has a rate of one, so it has one copy.
    copies = F.expr(f"(_at + _rate) div {UNIT} - _at div {UNIT}")
    mixed = keep(summed.withColumn("copies", copies).drop("_at", "_rate"), "rounded")
    for _ in range(TOUCHES):
        touches = keep(_touches(mixed, most), "touches")
        if not touches.take(1):
            break
        changed = F.col("copies") + F.coalesce("_up", F.lit(0))
        mixed = mixed.join(touches, "_pos", "left").withColumn("copies", changed).drop("_up")
        mixed = keep(mixed.select("_pos", *rows.columns, "source_size", "target", "copies"), "touched")
    return mixed.drop("_pos")


def _touches(mixed: DataFrame, most: int) -> DataFrame:
    """For each source one row, by ``_pos``, that brings its words nearer to the target with one
    copy more or less (``_up``); none for a source that comes no nearer."""
    taken = F.sum(F.col("size") * F.col("copies"))
    left = mixed.groupBy("source").agg((F.max("target") - taken).alias("_left"))
    left = keep(left.withColumnRenamed("source", "_source"), "left")
    rows = mixed.join(left, F.col("source").eqNullSafe(F.col("_source")))
    up = F.when(F.col("_left") > 0, 1).otherwise(-1).cast("long")
    off = F.abs(F.col("_left") - up * F.col("size"))
    can = (off < F.abs("_left")) & (F.col("copies") + up).between(0, most)
    best = F.min(F.struct(off.alias("off"), "_h", "_g", "_pos", up.alias("_up"))).alias("best")
    return rows.where(can).groupBy("source").agg(best).select("best._pos", "best._up")


def _narrow(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    rows = packed(docs, doc_id=key, source=source, text=text)
    return keep(rows.select("doc_id", "source", n_words("text").alias("size"), *row_marks(docs)), "rows")


def mixture(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``source_size``, ``target``, ``copies``."""
    mixed = _copies(_narrow(docs, key, source, text), weights, most)
    return mixed.select("doc_id", "size", "source_size", "target", "copies")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
) -> DataFrame:
    """``docs`` with every row as often as the mixture takes it."""
    mixed = _copies(_narrow(docs, key, source, text), weights, most)
    # Equal rows are one here, with the copies of all of them.
    times = keep(mixed.groupBy("_h", "_g").agg(F.sum("copies").alias("_times")).where("_times > 0"), "times")
    rows = packed(docs).select("row", *row_marks(docs)).dropDuplicates(["_h", "_g"]).join(times, ["_h", "_g"])
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("row.*")
