"""A set of 64-bit hashes as a bitmap of bounded size, which tasks ask before they send a row on.

The bitmap has two bits per hash and at most ``MAX_BITS`` of them (16 MB), however many hashes there
are. It may know a hash that was never put in, so it only saves work: who asks must check the rows
that pass.
"""

import numpy as np
from pyspark.sql import DataFrame, functions as F

MIN_BITS, MAX_BITS, BITS_PER_HASH = 1 << 16, 1 << 27, 32


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The bitmap of a one-column table of hashes (bigint, without nulls), a written table."""
    wanted = max(1, hashes.count()) * BITS_PER_HASH
    size = min(MAX_BITS, max(MIN_BITS, 1 << (wanted - 1).bit_length()))
    h = F.col(hashes.columns[0])
    both = F.array(h.bitwiseAND(size - 1), F.shiftrightunsigned(h, 32).bitwiseAND(size - 1))
    cells = hashes.select(F.explode(both).alias("place")).select(
        F.shiftright("place", 6).alias("cell"), F.expr("shiftleft(1L, cast(place & 63 AS int))").alias("bit")
    )
    # A row per 64 bits at most reaches the driver.
    made = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.int64)
    out[made.column("cell").to_numpy()] = made.column("bits").to_numpy()
    return out.view(np.uint64)


def knows(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each of the hashes (uint64) may be in the set."""
    mask = np.uint64(len(bits) * 64 - 1)
    found = np.ones(len(hashes), bool)
    for place in (hashes & mask, (hashes >> np.uint64(32)) & mask):
        found &= (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found
