"""Naming an intermediate value inside a column expression."""

from pyspark.sql import Column, functions as F


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it.

    Spark shares equal subexpressions of a row, but not those inside lambda functions.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
