"""Seeded draws that depend on the row's key only.

A draw hashes its key parts and the seed, so a job gives the same rows whatever the number
of partitions, the order of the input or the number of retries.
"""

from pyspark.sql import Column, functions as F

SPAN = 1 << 32


def _as_text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def _digits(seed: int, *key) -> Column:
    """The draw as eight hexadecimal digits, which stand in the order of the numbers."""
    text = F.concat_ws("|", *[_as_text(part) for part in (*key, seed)])
    return F.left(F.md5(text), F.lit(8))


def draw(seed: int, *key) -> Column:
    """An integer in [0, 2**32)."""
    return F.conv(_digits(seed, *key), 16, 10).cast("long")


def pick(n, seed: int, *key) -> Column:
    """An integer in [0, n)."""
    return (draw(seed, *key) % n).cast("int")


def chance(p: float, seed: int, *key) -> Column:
    """True with probability ``p``."""
    below = int(p * SPAN)
    return F.lit(True) if below >= SPAN else _digits(seed, *key) < f"{below:08x}"


def shuffle_key(seed: int, *key) -> Column:
    """A string whose order is a seeded random order of the keys."""
    return F.md5(F.concat_ws("|", *[_as_text(part) for part in (*key, seed)]))
