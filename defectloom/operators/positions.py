"""Exact row numbers over tables of any size.

A window without a partition key sorts the whole table in one task. Here the key range is
cut into buckets first: the cut points come from a small hashed sample of the keys, every
bucket is numbered on its own, and the sizes of the buckets before it give its offset. The
sample only decides where the cuts are; each row is numbered. The number of buckets follows
the number of rows.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from defectloom.functions.lookup import count_at_most

PER_BUCKET = 16
MIN_BUCKETS, MAX_BUCKETS = 16, 8192
ROWS_PER_BUCKET = 200_000
HASH_SPAN = 1 << 62
# The sample is binomial around 16 keys per bucket, so four times the number of buckets is far
# outside what it can give.
LIMIT = 4 * MAX_BUCKETS


def _cut_points(keys: DataFrame, names: list[str], buckets: int | None, rows_per_bucket: int):
    """Evenly spread keys, in order, as a one-value subquery."""
    rows = keys.agg(F.count(F.lit(1))).scalar()
    followed = F.least(F.lit(MAX_BUCKETS), F.ceil(rows / rows_per_bucket))
    wanted = F.greatest(F.lit(MIN_BUCKETS), followed) if buckets is None else F.lit(buckets)
    place = F.xxhash64(*names).bitwiseAND(HASH_SPAN - 1) / F.lit(float(HASH_SPAN))
    sample = keys.where(place * rows < wanted * PER_BUCKET)
    every = f"filter(sort_array(collect_list(struct(*))), (k, i) -> i % {PER_BUCKET} = {PER_BUCKET - 1})"
    return sample.agg(F.expr(every)).scalar()


def with_position(
    df: DataFrame,
    order: list[str],
    within: list[str] | None = None,
    into: str = "pos",
    buckets: int | None = None,
    weight: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add the 0-based place of each row in ``order``, counted anew in every ``within`` group.

    ``within`` and ``order`` together identify a row. With ``weight``, a column of counts without
    nulls, a row takes as many places as it says, and gets the first of them. Whole rows move into the
    buckets, one task each, so wide rows need a smaller ``rows_per_bucket``. ``df`` is read several
    times, mostly its keys alone: write it out first if it is costly to make.
    """
    within = within or []
    names = [*within, *order]
    keys = df.select(*names)
    cuts = _cut_points(keys, names, buckets, rows_per_bucket)
    key = f"struct({', '.join(f'`{n}`' for n in names)})"

    def bucketed(table: DataFrame) -> DataFrame:
        found = count_at_most("_cuts", key, LIMIT)
        return table.withColumn("_cuts", cuts).select(*table.columns, found.alias("_bucket"))

    group = [*within, "_bucket"]
    if weight is None:
        sizes = bucketed(keys).groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    else:
        sizes = bucketed(df.select(*names, weight)).groupBy(*group).agg(F.sum(weight).alias("_n"))
    before = W.partitionBy(*within).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(n).alias(f"_of_{n}") for n in within],
        F.col("_bucket").alias("_of_bucket"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    rows = W.partitionBy(*group).orderBy(*order)
    if weight is None:
        local = F.row_number().over(rows) - 1
    else:
        local = F.coalesce(F.sum(weight).over(rows.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = bucketed(df).withColumn("_local", local)
    same = F.col("_bucket") == F.col("_of_bucket")
    for n in within:
        # A missing group is a group.
        same = same & F.col(n).eqNullSafe(F.col(f"_of_{n}"))
    if not within:
        # One row per bucket: bounded by ``LIMIT`` whatever the size of the table.
        offsets = F.broadcast(offsets)
    place = (F.col("_offset") + F.col("_local")).cast("long").alias(into)
    return numbered.join(offsets, same).select(*df.columns, place)
