"""Near copies by SimHash: fingerprints that differ in few bits, found in BK-trees.

Texts become 64-bit fingerprints, equal ones once. Fingerprints within ``max_bits`` of each other
agree in at least one of ``max_bits + 1`` blocks of bits, so a fingerprint goes to one shard per
block, by the block's leading bits; their number grows with the fingerprints. Where one block has
too few bits for that, the bits are cut into more blocks, of which several agree, and a fingerprint
goes to one shard per choice of those: for 3 bits 4 shards of up to 16 bits, 10 of 24, 20 of 30 or
35 of 36. The members of a shard are cut by hash into trees of bounded size. A tree's children are
keyed by their integer Hamming distance to the parent; it is sent to every block of queries of its
shard, and a query at distance d from a node follows only the edges from d - max_bits to
d + max_bits. In a crowded shard a bounded number of trees meets a bounded number of blocks under
one key. No tree, link or component passes the driver.

Null, empty or blank text: fingerprint zero, linked like any other. Very long text: hashed whole, its
votes summed in steps of 65,536 shingles. Ties: a bit with as many votes for as against is 0. Null doc_id: the row gets the
smallest known id of its component, null if there is none. Repeated rows: each has its row.
Empty table: no rows. Other columns are ignored, or kept as they are by ``drop_near_copies``.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from defectloom.llm.components import components, link_batch
from defectloom.llm.store import keep, packed, row_marks, ship

SHINGLE = 3
SEED = 42
MAX_BITS = 3
SHARD_SIZE = 512
TREE_SIZE = 2048
TREES_AT_ONCE = 32
QUERIES_AT_ONCE = 256
_AT_ONCE = 1 << 16


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The majority of each bit over the hashes of all shingles, as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        first, last = (ends - sizes)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(first, last)]
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _AT_ONCE):
        some = np.array(hashes[k : k + _AT_ONCE], "<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, columns: list, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``columns`` and the fingerprint ``fp`` of each text."""
    ship(docs.sparkSession)

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(t.as_py(), shingle) for t in texts], pa.int64())

    return docs.select(*columns, fp(F.col(text)).alias("fp"))


class BkTree:
    """Nodes in breadth-first order; a node's children lie together, by rising distance."""

    def __init__(self, prints: np.ndarray, parent: np.ndarray, distance: np.ndarray):
        self.prints, self.parent, self.distance = prints, parent, distance
        self._edges = parent.astype(np.int64) * 128 + distance

    @classmethod
    def build(cls, prints: np.ndarray) -> "BkTree":
        made, parents, distances = [prints[:1]], [np.array([-1], np.int32)], [np.zeros(1, np.uint8)]
        todo, at = prints[1:], np.zeros(max(0, len(prints) - 1), np.int32)
        known, total = prints[:1], 1
        while len(todo):
            apart = np.bitwise_count(todo ^ known[at - (total - len(known))])
            keys = at.astype(np.int64) * 128 + apart
            # The first comer of each (node, distance) becomes the child; the others go on to it.
            keys, first, child = np.unique(keys, return_index=True, return_inverse=True)
            rest = np.ones(len(todo), bool)
            rest[first] = False
            known = todo[first]
            made.append(known)
            parents.append((keys // 128).astype(np.int32))
            distances.append((keys % 128).astype(np.uint8))
            todo, at = todo[rest], (total + child[rest]).astype(np.int32)
            total += len(known)
        return cls(np.concatenate(made), np.concatenate(parents), np.concatenate(distances))

    def dump(self) -> bytes:
        return self.prints.tobytes() + self.parent.tobytes() + self.distance.tobytes()

    @classmethod
    def load(cls, data: bytes) -> "BkTree":
        n = len(data) // 13
        return cls(
            np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.int32, n, 8 * n),
            np.frombuffer(data, np.uint8, n, 12 * n),
        )

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, print) at most ``radius`` bits apart."""
        asked, found = [], []
        for k in range(0, len(queries), QUERIES_AT_ONCE):
            some = queries[k : k + QUERIES_AT_ONCE]
            who, node = np.arange(len(some)), np.zeros(len(some), np.int64)
            while len(who):
                apart = np.bitwise_count(some[who] ^ self.prints[node]).astype(np.int64)
                near = apart <= radius
                asked.append(some[who[near]])
                found.append(self.prints[node[near]])
                low = np.searchsorted(self._edges, node * 128 + np.maximum(apart - radius, 0))
                high = np.searchsorted(self._edges, node * 128 + apart + radius, "right")
                n = high - low
                who = np.repeat(who, n)
                node = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return np.concatenate(asked), np.concatenate(found)


def _build(batches):
    for batch in batches:
        trees = [
            BkTree.build(np.array(own, np.int64).view(np.uint64)).dump()
            for own in batch.column("members").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("shard", "tile", "trees")), pa.array(trees, pa.binary())],
            ["shard", "tile", "trees", "tree"],
        )


def in_shards(prints: DataFrame, rows: int, max_bits: int = MAX_BITS) -> DataFrame:
    """Each ``fp`` with its shards, so that two within ``max_bits`` bits share one at least.

    With ``rows`` random fingerprints a shard has some ``SHARD_SIZE`` members, however many rows.
    """
    wanted = (rows // SHARD_SIZE).bit_length()
    for blocks in range(max_bits + 1, max_bits + 5):
        agree = blocks - max_bits
        lead = min(agree * (64 // blocks), wanted)
        if lead == wanted:
            break
    ends = [64 * (k + 1) // blocks for k in range(blocks)]
    shards = []
    for n, chosen in enumerate(combinations(ends, agree)):
        shard = F.lit(n).cast("long")
        for k, end in enumerate(chosen):
            bits = lead // agree + (k < lead % agree)
            own = F.shiftrightunsigned("fp", end - bits).bitwiseAND((1 << bits) - 1)
            shard = F.shiftleft(shard, bits).bitwiseOR(own)
        shards.append(shard)
    return prints.select("fp", F.explode(F.array(*shards)).alias("shard"))


def near_prints(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (node, root) that join all distinct fingerprints ``fp`` within ``max_bits`` bits."""
    ship(prints.sparkSession)
    members = in_shards(prints, prints.count(), max_bits)
    # Shards above the size of a tree are cut by hash into as many trees as they need.
    large = keep(
        members.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TREE_SIZE // 2),
        "large",
    )
    trees = F.coalesce(F.ceil(F.col("n") / (TREE_SIZE // 2)), F.lit(1))
    tile = F.pmod(F.xxhash64("fp", F.lit("tile")), trees).cast("int")
    tiles = members.join(large, "shard", "left")
    tiles = tiles.groupBy("shard", tile.alias("tile"), trees.cast("int").alias("trees"))
    tiles = keep(tiles.agg(F.collect_list("fp").alias("members")), "tiles")
    trees = keep(tiles.mapInArrow(_build, "shard long, tile int, trees int, tree binary"), "trees")
    # Trees and queries of a shard meet in groups, so a crowded shard is many keys of bounded size.
    group = lambda c: F.floor(F.col(c) / TREES_AT_ONCE).cast("int")
    last = F.floor((F.col("trees") - 1) / TREES_AT_ONCE).cast("int")
    trees = trees.select(
        "shard", "tile", "tree", group("tile").alias("one"), F.explode(F.sequence(group("tile"), last)).alias("other")
    )
    asked = tiles.select(
        "shard", F.col("tile").alias("_from"), "members", group("tile").alias("other"),
        F.explode(F.sequence(F.lit(0), group("tile"))).alias("one"),
    )
    pairs = trees.join(asked, ["shard", "one", "other"]).where("_from >= tile").select("tree", "members")

    def search(batches):
        for batch in batches:
            for tree, members in zip(*(batch.column(c) for c in ("tree", "members"))):
                queries = members.values.to_numpy().view(np.uint64)
                one, other = BkTree.load(tree.as_py()).within(queries, max_bits)
                yield link_batch(one.view(np.int64), other.view(np.int64))

    return pairs.mapInArrow(search, "node long, root long")


def _rooted(prints: DataFrame, max_bits: int) -> DataFrame:
    """Each distinct ``fp`` with the smallest fingerprint of its component, as ``root``."""
    kinds = keep(prints.select("fp").distinct(), "kinds")
    roots = components(near_prints(kinds, max_bits))
    rooted = kinds.join(roots, kinds.fp == roots.node, "left")
    return keep(rooted.select("fp", F.coalesce("root", "fp").alias("root")), "rooted")


def simhash_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` and ``component_id``, the smallest reachable id."""
    prints = keep(fingerprints(docs, [F.col(key).alias("doc_id")], text, shingle), "prints")
    rooted = _rooted(prints, max_bits)
    first = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "first")
    first = keep(first.join(rooted, "fp"), "rooted_first")
    smallest = keep(first.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    own = keep(first.join(smallest, "root").select("fp", "component_id"), "own")
    return prints.join(own, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id.

    Among rows with the same id a hash of the row decides; of equal rows one stays. A component
    without any id keeps one row.
    """
    rows = packed(docs, doc_id=key, text=text)
    prints = keep(fingerprints(rows, ["doc_id", *row_marks(docs)], "text", shingle), "prints")
    rooted = _rooted(prints, max_bits)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h", "_g")
    # Smallest row per fingerprint first, then per component.
    first = keep(prints.groupBy("fp").agg(F.min(row).alias("row")), "first")
    best = first.join(rooted, "fp").groupBy("root").agg(F.min("row").alias("row"))
    best = keep(best.select("row._h", "row._g"), "best")
    kept = rows.select("row", *row_marks(docs)).join(best, ["_h", "_g"], "left_semi")
    return kept.dropDuplicates(["_h", "_g"]).select("row.*")
