"""Running sums over a whole table in a given order, without a sort in one task.

The order is cut into ranges at a hashed sample of its keys. Each range sums up alone, and the
totals of the ranges before it are its offset: per-partition totals first, then their prefix.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from defectloom.functions.lookup import count_at_most

PER_RANGE = 32
MIN_RANGES, MAX_RANGES, ROWS_PER_RANGE = 64, 4096, 100_000
HASH_SPAN = 1 << 62


def order_ranges(df: DataFrame, order: list[str]):
    """A function that adds ``_range``, the number of a row's range in ``order``.

    The sample decides only where the cuts are. It holds ``PER_RANGE`` keys per range on
    average, at most about 130,000 of them, and is sorted inside one small subquery.
    """
    rows = df.count()
    ranges = min(MAX_RANGES, max(MIN_RANGES, rows // ROWS_PER_RANGE))
    place = F.xxhash64(*order).bitwiseAND(HASH_SPAN - 1) / F.lit(float(HASH_SPAN))
    # A key counts once, however many rows have it.
    sample = df.select(*order).where(place * max(rows, 1) < ranges * PER_RANGE).distinct()
    nth = f"filter(sort_array(collect_list(struct(*))), (k, i) -> i % {PER_RANGE} = {PER_RANGE - 1})"
    cuts = sample.agg(F.expr(nth)).scalar()
    key = f"struct({', '.join(f'`{n}`' for n in order)})"

    def ranged(table: DataFrame) -> DataFrame:
        # The sample is binomial around PER_RANGE keys per range: far below four times as many.
        found = count_at_most("_cuts", key, 4 * ranges)
        return table.withColumn("_cuts", cuts).select(*table.columns, found.alias("_range"))

    return ranged


def running_sums(df: DataFrame, order: list[str], sums: dict[str, Column | str]) -> DataFrame:
    """Add, for each name in ``sums``, the sum of its value over all rows before a row.

    ``df`` is read three times and should be a narrow written table. Nulls come first in
    ``order``. Rows that agree in all of ``order`` stand in any sequence among themselves.
    """
    ranged = order_ranges(df, order)
    values = {name: F.col(v) if isinstance(v, str) else v for name, v in sums.items()}
    totals = ranged(df).groupBy("_range").agg(
        *[F.sum(v).alias(f"_sum_{name}") for name, v in values.items()]
    )
    # One row per range, whatever the number of rows.
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "_range", *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_sum_{n}") for n in sums]
    )
    before = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = ranged(df).select(
        *df.columns,
        "_range",
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_own_{n}") for n, v in values.items()],
    )
    return local.join(F.broadcast(offsets), "_range").select(
        *df.columns, *[(F.col(f"_sum_{n}") + F.col(f"_own_{n}")).alias(n) for n in sums]
    )
