"""Near-duplicate embeddings by PCA-ordered tiled comparison; exact at the threshold.

Vectors are normalised and turned to their principal axes, so most of a dot
product lies in the leading dimensions.  Equal vectors are one.  The others are
sorted by the leading axes and cut into blocks of equal size.  A task holds one
block and lets others pass by, a batch at a time.  In a tile the leading
dimensions' products are accumulated first; with the norms of what is left
(Cauchy-Schwarz) they bound the cosine, and a pair stops where the bound falls
below the threshold.  Survivors go through more dimensions and at last the whole
product in double precision.

Blocks whose boxes along the leading axes are farther apart than the threshold
allows do not meet.  A task returns a row for each vector that has links: how
many, and one vector it is connected with.  So a dense group of any size gives as
many rows as it has vectors, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ranked
from .components import connected_components
from .simhash import Forest

THRESHOLD = 0.9
#: Leading dimensions after which the bound is tested; the last stage is the whole vector.
STAGES = (16, 32)
#: Leading axes along which blocks have boxes.
BOXES = 3
#: Rows and numbers of a block at most, fewest blocks of a large table, vectors of one length up to which there is one tile,
#: rows of a tile that are multiplied at once, and meetings of blocks up to which their table is broadcast.
BLOCK, BLOCK_VALUES, BLOCKS, SMALL, STRIPE, BROADCAST_PAIRS = 65_536, 1 << 23, 8, 2048, 512, 200_000


def normalised(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors of the second-moment matrix of all normalised vectors, largest first, as columns."""

    def moments(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                x = normalised(_matrix(batch.column(0), width))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["cell", "v"])

    cells = vectors.select("embedding").mapInArrow(moments, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    matrix = np.zeros(width * width)
    matrix[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    return np.linalg.eigh(matrix.reshape(width, width))[1][:, ::-1].copy()


class Tile:
    """Vectors with their leading coordinates and the norms of what those leave."""

    def __init__(self, vectors: np.ndarray, axes: np.ndarray):
        self.unit = normalised(vectors)
        self.lead = self.unit @ axes
        used = np.cumsum(self.lead * self.lead, axis=1)
        self.steps = [k for k in STAGES if k < vectors.shape[1]] or [vectors.shape[1]]
        self.tails = {k: np.sqrt(np.maximum(0.0, 1.0 - used[:, k - 1])) if k < vectors.shape[1] else np.zeros(len(vectors)) for k in self.steps}
        k = self.steps[0]
        self.first = np.concatenate([self.lead[:, :k], self.tails[k][:, None]], axis=1).astype(np.float32)


def tile_links(a: Tile, b: Tile | None, threshold: float):
    """Yield index arrays (i, j) of the pairs with cosine >= threshold; ``b`` None compares a with itself, i < j."""
    other = a if b is None else b
    for at in range(0, len(a.unit), STRIPE):
        first = at if b is None else 0
        maybe = a.first[at : at + STRIPE] @ other.first[first:].T >= threshold - 1e-4  # single precision is good to about 1e-6
        if maybe.mean() > 0.2:
            # a dense tile: the whole product costs less than picking its pairs
            maybe &= a.unit[at : at + STRIPE] @ other.unit[first:].T >= threshold - 1e-9
        i, j = np.nonzero(maybe)
        i, j = i + at, j + first
        if b is None:
            i, j = i[i < j], j[i < j]
        for k in a.steps[1:]:
            keep = np.zeros(len(i), bool)
            for p in range(0, len(i), 1 << 18):
                x, y = i[p : p + (1 << 18)], j[p : p + (1 << 18)]
                keep[p : p + (1 << 18)] = np.einsum("ij,ij->i", a.lead[x, :k], other.lead[y, :k]) + a.tails[k][x] * other.tails[k][y] >= threshold - 1e-6
            i, j = i[keep], j[keep]
        # the original coordinates decide
        keep = np.zeros(len(i), bool)
        for p in range(0, len(i), 1 << 17):
            x, y = i[p : p + (1 << 17)], j[p : p + (1 << 17)]
            keep[p : p + (1 << 17)] = np.einsum("ij,ij->i", a.unit[x], other.unit[y]) >= threshold
        if keep.any():
            yield i[keep], j[keep]


class _Held:
    """A task's block: its links so far, within itself and with what has passed by."""

    def __init__(self, node: np.ndarray, weight: np.ndarray, vectors: np.ndarray, axes: np.ndarray, threshold: float):
        self.node, self.weight, self.axes, self.threshold = node, weight, axes, threshold
        self.tile, self.forest, self.links = Tile(vectors, axes), Forest(len(node)), np.zeros(len(node), np.int64)
        for i, j in tile_links(self.tile, None, threshold):
            np.add.at(self.links, i, weight[j])
            np.add.at(self.links, j, weight[i])
            self.forest.link(i, j)

    def meet(self, node: np.ndarray, weight: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        """Links of passing vectors."""
        links, of = np.zeros(len(node), np.int64), np.full(len(node), -1)
        for i, j in tile_links(self.tile, Tile(vectors, self.axes), self.threshold):
            np.add.at(self.links, i, weight[j])
            np.add.at(links, j, self.weight[i])
            new = of[j] < 0
            of[j[new]] = i[new]
            # all that one vector is linked with is connected
            self.forest.link(of[j], i)
        some = np.flatnonzero(links)
        return _links(node[some], links[some], self.node[of[some]])

    def rest(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.links)
        return _links(self.node[some], self.links[some], self.node[self.forest.root[some]])


_LINKS = "node long, links long, root long"


def _links(node: np.ndarray, links: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64()), pa.array(root, pa.int64())], ["node", "links", "root"])


def _compare(shared, width: int, threshold: float):
    """Over rows sorted by (group, side): side 0 is the block held, side 1 passes by."""

    def run(batches):
        group, held, parts = None, None, []

        def hold():
            return _Held(*(np.concatenate(x) for x in zip(*parts, strict=True)), shared.value, threshold) if parts else None

        for batch in batches:
            if not batch.num_rows:
                continue
            groups, sides = (batch.column(c).to_numpy() for c in ("group", "side"))
            starts = np.flatnonzero(np.concatenate([[True], (groups[1:] != groups[:-1]) | (sides[1:] != sides[:-1])]))
            for a, z in zip(starts, [*starts[1:], len(groups)], strict=True):
                part = batch.slice(a, z - a)
                rows = part.column("node").to_numpy(), part.column("w").to_numpy(), _matrix(part.column("embedding"), width)
                if groups[a] != group:
                    if held := held or hold():
                        yield held.rest()
                    group, held, parts = groups[a], None, []
                if sides[a] == 0:
                    parts.append(rows)
                    continue
                held = held or hold()
                parts = []
                yield held.meet(*rows)
        if held := held or hold():
            yield held.rest()

    return run


def _links_of_few(distinct: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) for lengths with at most ``SMALL`` vectors each, a length at a time."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        width = table.column("width")[0].as_py()
        vectors = _matrix(table.column("embedding").chunk(0), width)
        held = _Held(table.column("node").to_numpy(), table.column("w").to_numpy(), vectors, np.eye(width)[:, : max(STAGES)], threshold)
        return pa.Table.from_batches([held.rest()])

    return distinct.select("width", "node", "w", "embedding").groupBy("width").applyInArrow(run, _LINKS)


def _links_of_width(distinct: DataFrame, width: int, n: int, threshold: float) -> DataFrame:
    """(node, links, root) of every meeting of blocks for the distinct vectors of one length."""
    spark = distinct.sparkSession
    shared = spark.sparkContext.broadcast(principal_axes(distinct, width)[:, : max(STAGES)])
    boxes = min(BOXES, width)
    names = [f"c{k}" for k in range(boxes)]

    def leading(batches):
        for batch in batches:
            if batch.num_rows:
                lead = normalised(_matrix(batch.column("embedding"), width)) @ shared.value[:, :boxes]
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(lead[:, k]) for k in range(boxes)]], [*batch.schema.names, *names])

    plain = distinct.select("node", "w", "embedding")
    led = plain.mapInArrow(leading, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in plain.schema] + [f"{c} double" for c in names]))
    rows = min(BLOCK, max(STRIPE, BLOCK_VALUES // width))
    blocks = max(1, min(BLOCKS, n // 256), -(-n // rows))
    slabs = math.isqrt(blocks)
    if slabs > 1:
        # slabs along the first axis, sorted by the second one inside
        cuts = led.agg(F.percentile_approx("c0", [i / slabs for i in range(1, slabs)], 10_000)).first()[0]
        slab = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("c0")))
        led = ranked(led, slab, F.col("c1") if boxes > 1 else F.col("c0"))
    else:
        led = ranked(led, F.col("c0"))
    led = led.withColumn("block", F.floor(F.col("rank") * blocks / n).cast("int"))
    bounds = [f(c).alias(f"{c}_{e}") for c in names for e, f in (("a", F.min), ("z", F.max))]
    box = cut(led.groupBy("block").agg(*bounds))
    # unit vectors with cosine >= threshold are no farther apart than this, nor are their leading coordinates
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    cell = lambda c: F.floor(c / reach).cast("int")
    here = box.select("*", F.explode(F.sequence(cell(F.col("c0_a")), cell(F.col("c0_z")))).alias("cell"))
    there = box.select(*[F.col(c).alias(f"o_{c}") for c in box.columns], F.explode(F.sequence(cell(F.col("c0_a")) - 1, cell(F.col("c0_z")) + 1)).alias("o_cell"))
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"o_{c}_a") - F.col(f"{c}_z"), F.col(f"{c}_a") - F.col(f"o_{c}_z"))
    near = sum((gap(c) * gap(c) for c in names), F.lit(0.0)) <= reach * reach
    pairs = here.join(there, (F.col("cell") == F.col("o_cell")) & (F.col("block") < F.col("o_block")) & near).select("block", "o_block").distinct()
    # of two blocks that meet one is held; each holds about half of those it meets
    even = (F.col("block") + F.col("o_block")) % 2 == 0
    meets = pairs.select(F.when(even, F.col("o_block")).otherwise(F.col("block")).alias("from"), F.when(even, F.col("block")).otherwise(F.col("o_block")).alias("group"), F.lit(1).alias("side"))
    meets = cut(meets.unionByName(box.select(F.col("block").alias("from"), F.col("block").alias("group"), F.lit(0).alias("side"))))
    few = meets.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    sent = led.join(F.broadcast(meets) if few else meets, F.col("block") == F.col("from")).select("group", "side", "node", "w", "embedding")
    return sent.repartition("group").sortWithinPartitions("group", "side").mapInArrow(_compare(shared, width, threshold), _LINKS)


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    Vectors that are null, zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths.  Repeated rows and equal vectors
    are vectors of their own with links to each other.  A null id never names a
    component unless it has no other; an empty table gives an empty result; other
    columns take no part.
    """
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].alias("embedding"))
    usable = F.coalesce(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    valid = rows.where(usable)
    distinct = valid.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("w"))
    distinct = cut(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("width", F.size("embedding")))
    widths = distinct.groupBy("width").count().collect()
    many = [(r["width"], r["count"]) for r in widths if r["count"] > SMALL]
    tiles = _links_of_few(distinct.where(~F.col("width").isin([w for w, _ in many])), threshold)
    for width, n in many:
        tiles = tiles.unionByName(_links_of_width(distinct.where(F.col("width") == width), width, n, threshold))
    if not widths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    tiles = cut(tiles)
    comp = connected_components(tiles, "node", "root")
    links = tiles.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = distinct.select("node", "embedding", "least", "w").join(links, "node", "left").join(comp, "node", "left")
    nodes = nodes.withColumn("component", F.coalesce("component", "node"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(nodes.join(least, "component").select(F.col("embedding").alias("__v"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id"))
    linked = valid.join(named, valid["embedding"] == named["__v"]).select("vec_id", "n_links", "component_id")
    lonely = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(lonely).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
