"""Search in a sorted array of bounded size."""

from pyspark.sql import Column, functions as F


def count_at_most(sorted_values: str, value: str, max_size: int) -> Column:
    """How many entries of the sorted array are <= ``value`` (both SQL expressions).

    The array holds ``max_size`` entries at most; the search halves the range in each step.
    """
    steps = ", ".join(str(1 << k) for k in range(max_size.bit_length() - 1, -1, -1))
    fits = f"b + s <= size({sorted_values}) AND get({sorted_values}, b + s - 1) <= {value}"
    # Never null, so a join on the result needs no null filter.
    return F.expr(
        f"coalesce(aggregate(array({steps}), 0, (b, s) -> if({fits}, b + s, b)), 0)"
    )
