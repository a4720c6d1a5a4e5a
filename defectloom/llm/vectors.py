"""Near copies of vectors by an inverted multi-index.

The two halves of the unit vectors have codebooks of their own, fitted on a bounded sample; the
pairs of codes form a grid of cells, and every vector is filed in the cell of its nearest codes.
From its own cell a vector visits others by rising bound: the squared distance it would have to
move, in both halves together, to fall into the cell. The traversal stops at the bound below which
the cells of ``recall`` of all neighbours at the threshold lie, measured on the sample with
neighbours in random directions and in those in which near vectors of the sample differ, whichever
lie further, at the latest where no neighbour can lie. Everything in a visited
cell is verified by the cosine in double precision. A pair is looked at if either visits the
other's cell.

Equal vectors are one in the index, with their number. Cells are cut into tiles of bounded size.
A task gathers the vectors that visit a cell into packs, and a pack meets the cell's tiles one by
one; out come numbers of links and a forest of links, never the pairs.

Null or empty vectors, zero vectors and those with null or non-finite components have no links.
Vectors of different lengths have none with each other. Each of the 64 most frequent lengths, and of
those with more than ``FEW`` distinct vectors, has an index; all other lengths are compared in full,
tile by tile, in one job. Null vec_id: the row counts as a vector
and is never the kept one. Repeated rows: each counts. Empty table: no rows. Other columns are
ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from defectloom.llm.components import components, forest
from defectloom.llm.store import keep, ship

THRESHOLD = 0.95
RECALL = 0.995
# Vectors the codebooks are fitted on, at most about; codes of a half, at most; vectors of a cell, on
# average, before that; vectors of a tile, at most about.
SAMPLE, CODES, PER_CELL, TILE = 16_384, 256, 48, 512
LENGTHS, FEW = 64, 8192
PROBES, AROUND = 1024, 8
ROUNDS = 12


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    vectors = vectors.astype(np.float64)
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / largest
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _apart(points: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum(
        (points * points).sum(1)[:, None] - 2 * points @ codes.T + (codes * codes).sum(1)[None], 0
    )


def fit_codes(points: np.ndarray, n: int) -> np.ndarray:
    """Centres by Lloyd's rounds from evenly spread points; an empty centre stays where it is."""
    codes = points[np.linspace(0, len(points) - 1, n).astype(int)].copy()
    for _ in range(ROUNDS):
        own = _apart(points, codes).argmin(1)
        sums, sizes = np.zeros_like(codes), np.bincount(own, minlength=n)
        np.add.at(sums, own, points)
        codes[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return codes


class MultiIndex:
    """Codebooks of both halves, the cells of vectors and the cells they visit."""

    def __init__(self, sample: np.ndarray, codes: int, threshold: float, recall: float):
        self.half = sample.shape[1] // 2
        self.codes = [fit_codes(part, min(codes, len(part))) for part in self._halves(sample)]
        self.between = [np.sqrt(_apart(c, c)) for c in self.codes]
        self.width = len(self.codes[1])
        self.stop = 2 * (1 - threshold) * (1 + 1e-9)
        if recall < 1:
            self.stop = min(self.stop, self._measured(sample, threshold, recall))

    def _halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors[:, : self.half], vectors[:, self.half :]

    def _measured(self, sample: np.ndarray, threshold: float, recall: float) -> float:
        """The bound within which ``recall`` of neighbours at the threshold fall."""
        rng = np.random.default_rng(0)
        stops = [self._way(sample[:4096], rng.standard_normal(sample[:4096].shape), threshold, recall)]
        probes = np.repeat(sample[:PROBES], 4, axis=0)
        # In data of low rank neighbours lie along the data, not anywhere.
        alike = sample[:PROBES] @ sample.T
        alike[alike > 1 - 1e-9] = -2
        some = min(AROUND, len(sample) - 1)
        if some:
            nearest = np.repeat(np.argpartition(-alike, some - 1, axis=1)[:, :some], 4, axis=0)
            weights = rng.standard_normal(nearest.shape)
            turn = np.einsum("ps,psd->pd", weights, sample[nearest]) - weights.sum(1, keepdims=True) * probes
            stops.append(self._way(probes, turn, threshold, recall))
        return max(stops)

    def _way(self, sample: np.ndarray, turn: np.ndarray, threshold: float, recall: float) -> float:
        """The bound for neighbours at the threshold in the directions of ``turn``."""
        turn = unit(turn - (turn * sample).sum(1, keepdims=True) * sample + 1e-300)
        near = threshold * sample + np.sqrt(1 - threshold * threshold) * turn
        one, two = self.bounds(sample)
        cells = self.cells(near)
        at = np.arange(len(sample))
        return float(np.quantile(one[at, cells // self.width] + two[at, cells % self.width], recall))

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        one, two = (_apart(p, c).argmin(1) for p, c in zip(self._halves(vectors), self.codes))
        return one * self.width + two

    def bounds(self, vectors: np.ndarray) -> list[np.ndarray]:
        """For each half, the squared way from a vector to the region of each code."""
        out = []
        for part, codes, between in zip(self._halves(vectors), self.codes, self.between):
            apart = _apart(part, codes)
            own = apart.argmin(1)
            at = np.arange(len(part))
            gap = between[own]
            way = (apart - apart[at, own][:, None]) / np.where(gap > 0, 2 * gap, np.inf)
            way[at, own] = 0
            out.append(np.maximum(way, 0) ** 2)
        return out

    def visits(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (vector, cell) up to the stop.

        Both halves' codes are taken in rising order; the pairs of ranks whose bounds add up to
        less than the stop form a staircase, which is walked code by code.
        """
        one, two = self.bounds(vectors)
        order = np.argsort(two, axis=1, kind="stable")
        rising = np.take_along_axis(two, order, axis=1)
        who, cells = [], []
        for code in range(one.shape[1]):
            steps = (rising <= self.stop - one[:, code : code + 1]).sum(1)
            some = np.repeat(np.arange(len(vectors)), steps)
            rank = np.arange(len(some)) - np.repeat(np.cumsum(steps) - steps, steps)
            who.append(some)
            cells.append(code * self.width + order[some, rank])
        return np.concatenate(who), np.concatenate(cells)

    def visited(self, vectors: np.ndarray, home: int, cells: np.ndarray) -> np.ndarray:
        """Whether each vector, at home in one cell, visits the cell beside it."""
        bound = np.zeros(len(vectors))
        places = (cells // self.width, cells % self.width)
        homes = (home // self.width, home % self.width)
        for part, codes, between, to, own in zip(self._halves(vectors), self.codes, self.between, places, homes):
            further = ((part - codes[to]) ** 2).sum(1) - ((part - codes[own]) ** 2).sum(1)
            gap = between[own, to]
            way = np.maximum(further, 0) / np.where(gap > 0, 2 * gap, np.inf)
            bound += way * way
        return bound <= self.stop


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


TILES = "cell long, tile int, nodes binary, copies binary, vectors binary"
PACKS = "cell long, tile int, homes binary, nodes binary, copies binary, vectors binary"
# Vectors that a task gathers by visited cell before it sends them on.
GATHERED = 1 << 17


def _batch(schema: str, rows: list[dict]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [part.split() for part in schema.split(", ")]
    return pa.RecordBatch.from_pylist(rows, pa.schema([(name, types[kind]) for name, kind in fields]))


def _packed(cell, tile, **arrays) -> dict:
    return {"cell": int(cell), "tile": int(tile)} | {n: np.ascontiguousarray(a).tobytes() for n, a in arrays.items()}


def _by_tile(batches, length: int):
    """(cell, tile, nodes, copies, vectors) of rows that come sorted by cell and tile."""
    held: list = []
    name = None
    for batch in batches:
        cells, tiles = batch.column("cell").to_numpy(), batch.column("tile").to_numpy()
        parts = [batch.column(c).to_numpy() for c in ("node", "copies")] + [_matrix(batch.column("vector"), length)]
        cuts = np.nonzero((np.diff(cells) != 0) | (np.diff(tiles) != 0))[0] + 1
        for a, b in zip([0, *cuts], [*cuts, len(cells)]):
            if a == b:
                continue
            now = cells[a], tiles[a]
            if held and now != name:
                yield (*name, *(np.concatenate(p) for p in zip(*held)))
                held = []
            name = now
            held.append([p[a:b] for p in parts])
    if held:
        yield (*name, *(np.concatenate(p) for p in zip(*held)))


def _links_of_length(vectors: DataFrame, length: int, threshold: float, recall: float) -> DataFrame:
    """(kind, a, b) for distinct ``vectors`` of one length: kind 0 says that node a has b links,
    kind 1 links a with b in a forest."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.count()
    place = F.xxhash64("vector").bitwiseAND((1 << 62) - 1) / float(1 << 62)
    drawn = vectors.where(place * rows < SAMPLE).select("vector").orderBy(F.xxhash64("vector", F.lit(1)))
    sample = unit(np.array([r.vector for r in drawn.limit(2 * SAMPLE).collect()] or [[1.0] * length]))
    codes = min(CODES, max(1, int(np.ceil(np.sqrt(rows / PER_CELL)))))
    # Two books of at most 256 codes, and the tiles of at most 65,536 cells.
    index = spark.sparkContext.broadcast(MultiIndex(sample, codes, threshold, recall))
    kind = np.float32 if dict(vectors.dtypes)["vector"] == "array<float>" else np.float64

    @F.arrow_udf("long")
    def cell_of(column: pa.Array) -> pa.Array:
        return pa.array(index.value.cells(unit(_matrix(column, length))).astype(np.int64))

    filed = keep(vectors.withColumn("cell", cell_of("vector")), "filed")
    full = filed.groupBy("cell").agg(F.ceil(2 * F.count(F.lit(1)) / TILE).cast("int").alias("n")).where("n > 1")
    full = keep(full, "full")
    tiles = spark.sparkContext.broadcast({r.cell: r.n for r in full.collect()})
    # A tile is a share of the cell's vectors by hash. One row per full cell, 65,536 at most.
    filed = filed.join(F.broadcast(full), "cell", "left")
    share = F.pmod(F.xxhash64("vector", F.lit("tile")), F.coalesce("n", F.lit(1)))
    filed = filed.withColumn("tile", share.cast("int"))
    sorted_ = filed.repartition("cell", "tile").sortWithinPartitions("cell", "tile")
    sorted_ = sorted_.select("cell", "tile", "node", "copies", "vector")

    def members(batches):
        for cell, tile, nodes, copies, own in _by_tile(batches, length):
            yield _batch(TILES, [_packed(cell, tile, nodes=nodes, copies=copies, vectors=own.astype(kind))])

    def visitors(batches):
        held: dict[int, list] = {}
        size = 0

        def sent():
            rows = []
            for target, parts in held.items():
                homes, nodes, copies, own = (np.concatenate(p) for p in zip(*parts))
                for k in range(0, len(nodes), TILE):
                    some = slice(k, k + TILE)
                    arrays = {"homes": homes[some], "nodes": nodes[some], "copies": copies[some], "vectors": own[some]}
                    rows += [_packed(target, tile, **arrays) for tile in range(tiles.value.get(target, 1))]
                    if len(rows) >= 32:
                        yield _batch(PACKS, rows)
                        rows = []
            if rows:
                yield _batch(PACKS, rows)

        for cell, _, nodes, copies, own in _by_tile(batches, length):
            who, targets = index.value.visits(unit(own))
            order = np.argsort(targets, kind="stable")
            who, targets = who[order], targets[order]
            cuts = np.nonzero(np.diff(targets))[0] + 1
            for a, b in zip([0, *cuts], [*cuts, len(targets)]):
                some = who[a:b]
                homes = np.full(len(some), cell, np.int64)
                held.setdefault(int(targets[a]), []).append((homes, nodes[some], copies[some], own[some].astype(kind)))
            size += len(who)
            if size > GATHERED:
                yield from sent()
                held, size = {}, 0
        yield from sent()

    filed_tiles = keep(sorted_.mapInArrow(members, TILES), "tiles")
    visiting = keep(sorted_.mapInArrow(visitors, PACKS), "visitors")
    theirs = filed_tiles.select("cell", "tile", *[F.col(c).alias(f"_{c}") for c in ("nodes", "copies", "vectors")])

    def links_of(row: dict) -> tuple:
        x, y = (unit(np.frombuffer(row[c], kind).reshape(-1, length)) for c in ("vectors", "_vectors"))
        a, b = (np.frombuffer(row[c], np.int64) for c in ("nodes", "_nodes"))
        i, j = np.nonzero(x @ y.T >= threshold)
        home = np.frombuffer(row["homes"], np.int64)[i]
        # At home each of two vectors finds the other, and itself.
        stays = a[i] != b[j]
        later = np.nonzero(home > row["cell"])[0]
        # Who visits the other's home has met it there.
        stays[later] = ~index.value.visited(y[j[later]], row["cell"], home[later])
        i, j, home = i[stays], j[stays], home[stays]
        ours, theirs = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        np.add.at(ours, i, np.frombuffer(row["_copies"], np.int64)[j])
        away = home != row["cell"]
        np.add.at(theirs, j[away], np.frombuffer(row["copies"], np.int64)[i[away]])
        node, root = forest(a[i], b[j])
        parts = [(0, a[ours > 0], ours[ours > 0]), (0, b[theirs > 0], theirs[theirs > 0]), (1, node, root)]
        return tuple(np.concatenate(c) for c in zip(*[(np.full(len(n), k, np.int32), n, v) for k, n, v in parts]))

    def compare(batches):
        for batch in batches:
            found = [links_of({c: batch.column(c)[k].as_py() for c in batch.schema.names}) for k in range(batch.num_rows)]
            if found:
                columns = [pa.array(np.concatenate(c)) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "a", "b"])

    return visiting.join(theirs, ["cell", "tile"]).mapInArrow(compare, "kind int, a long, b long")


def _links_of_few(vectors: DataFrame, threshold: float) -> DataFrame:
    """The same as ``_links_of_length`` for vectors of many lengths, each of at most ``FEW``."""
    ship(vectors.sparkSession)
    sized = vectors.withColumn("length", F.size("vector"))
    tiles = sized.groupBy("length").agg(F.ceil(2 * F.count(F.lit(1)) / TILE).cast("int").alias("n"))
    one = F.struct("node", "copies", F.col("vector").cast("array<double>").alias("vector"))
    tile = F.pmod(F.xxhash64("vector"), "n").cast("int")
    packs = sized.join(tiles, "length").groupBy("length", tile.alias("tile")).agg(F.collect_list(one).alias("v"))
    packs = packs.select(
        "length", "tile", F.col("v.node").alias("node"), F.col("v.copies").alias("copies"), F.flatten("v.vector").alias("vector")
    )
    packs = keep(packs, "few")
    theirs = packs.select("length", *[F.col(c).alias(f"_{c}") for c in ("tile", "node", "copies", "vector")])

    def links_of(batch, k: int) -> list[tuple]:
        def array(name):
            return batch.column(name)[k].values.to_numpy(zero_copy_only=False)

        length = batch.column("length")[k].as_py()
        same = batch.column("tile")[k] == batch.column("_tile")[k]
        a, b = array("node"), array("_node")
        x, y = (unit(array(c).reshape(-1, length)) for c in ("vector", "_vector"))
        i, j = np.nonzero(x @ y.T >= threshold)
        i, j = i[a[i] != b[j]], j[a[i] != b[j]]
        ours, others = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        np.add.at(ours, i, array("_copies")[j])
        if not same:
            np.add.at(others, j, array("copies")[i])
        node, root = forest(a[i], b[j])
        return [(0, a[ours > 0], ours[ours > 0]), (0, b[others > 0], others[others > 0]), (1, node, root)]

    def compare(batches):
        for batch in batches:
            parts = [p for k in range(batch.num_rows) for p in links_of(batch, k)]
            if parts:
                columns = zip(*[(np.full(len(n), kind, np.int32), n, v) for kind, n, v in parts])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["kind", "a", "b"])

    pairs = packs.join(theirs, "length").where(F.col("tile") <= F.col("_tile"))
    return pairs.mapInArrow(compare, "kind int, a long, b long")


def near_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``."""
    v = F.col("vector")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = F.coalesce(sound & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(key).alias("vec_id"), F.col(vector).alias("vector"))
    rows = rows.withColumn("vector", F.when(sound, v))
    kinds = rows.where("vector is not null").groupBy("vector").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first")
    )
    # Numbered as it is written, so that the numbers stay.
    kinds = keep(kinds.withColumn("node", F.monotonically_increasing_id()), "kinds")
    sizes = keep(kinds.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n")), "lengths")
    lengths = {r.length for r in sizes.orderBy(F.desc("n"), "length").limit(LENGTHS).collect()}
    # Each of these has work of its own.
    lengths |= {r.length for r in sizes.where(F.col("n") > FEW).collect()}
    found = None
    for length in sorted(lengths):
        some = kinds.where(F.size("vector") == length)
        part = keep(_links_of_length(some, length, threshold, recall), "found")
        found = part if found is None else found.union(part)
    if len(lengths) >= LENGTHS:
        few = kinds.where(~F.size("vector").isin(*lengths))
        found = found.union(keep(_links_of_few(few, threshold), "found"))
    if found is None:
        found = df.sparkSession.createDataFrame([], "kind int, a long, b long")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    links = found.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = components(links).withColumnRenamed("node", "_node")
    nodes = kinds.join(keep(counts, "counts"), "node", "left")
    nodes = nodes.join(roots, nodes.node == roots._node, "left").select(
        "vector", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("root"),
    )
    nodes = keep(nodes, "nodes")
    smallest = keep(nodes.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    nodes = keep(nodes.join(smallest, "root").select("vector", "n_links", "component_id"), "placed")
    alone = rows.where("vector is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    linked = rows.where("vector is not null").join(nodes, "vector").select("vec_id", "n_links", "component_id")
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return linked.union(alone).withColumn("kept", kept)
