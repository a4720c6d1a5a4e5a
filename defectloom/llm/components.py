"""Connected components of a table of links, by alternating star steps.

Each round points a node to the smallest known neighbour of its neighbours, until nothing
changes; the number of rounds grows with the logarithm of the longest chain. Links are first
reduced to a forest inside each batch, so that a large group costs as many links as it has
members. Every round is a written table.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from defectloom.llm.store import keep, ship


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest of its component, for the links given."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    moved = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[root[moved]]


def link_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A forest as rows of (node, root)."""
    node, root = forest(np.asarray(a, np.int64), np.asarray(b, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def _forests(batches):
    for batch in batches:
        yield link_batch(batch.column(0).to_numpy(), batch.column(1).to_numpy())


def _mark(links: DataFrame) -> tuple:
    h = F.xxhash64("node", "root")
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.bitwiseAND(0xFFFFFFFF))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that isn't the smallest of its component.

    ``links`` has two bigint columns without nulls; direction, repeats and loops don't matter.
    """
    ship(links.sparkSession)
    links = keep(links.mapInArrow(_forests, "node long, root long"), "links")
    mark = _mark(links)
    while mark[0]:
        # Large star: a node takes over the smallest neighbour of its neighbour. A neighbour
        # without a smaller one stays, so a large star is not gathered around its centre.
        smallest = keep(links.groupBy("node").agg(F.min("root").alias("up")), "up")
        large = links.join(smallest.select(F.col("node").alias("root"), "up"), "root", "left")
        large = large.select("node", F.coalesce("up", "root").alias("root")).distinct()
        large = keep(large, "large")
        # Small star: all smaller neighbours of a node go to the smallest of them.
        smallest = keep(large.groupBy("node").agg(F.min("root").alias("up")), "up")
        small = large.join(smallest, "node").where(F.col("root") != F.col("up"))
        small = small.select(F.col("root").alias("node"), F.col("up").alias("root"))
        links = small.union(smallest.select("node", F.col("up").alias("root"))).distinct()
        links = keep(links, "links")
        before, mark = mark, _mark(links)
        if mark == before:
            break
    return links
