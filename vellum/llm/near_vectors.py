"""Embedding near-dedup: a subspace pigeonhole join.

Unit vectors with cosine c or more are at most 2 - 2c apart in squared distance. After a rotation the vector is
split into blocks; in at least one block the squared distance is at most that budget over the number of blocks; a
vector of few components has a block for each. Each block is range-joined on a grid over its first coordinates: a
vector goes to every cell that its half-radius ball touches, so that the cell of a pair's middle holds both.

The join never writes pairs. A first pass over the cells, with the block's coordinates alone, keeps the vectors that
have a candidate there; a second one, with the whole vectors, counts every linked pair exactly once: in the first
block whose budget it keeps, in the cell of its middle. What leaves a cell is a count of links and one edge to a
representative for each vector, however many pairs there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, components, release

#: Blocks of the rotated vector, coordinates of a block that the grid uses, cell width in radii.
BLOCKS, GRID, WIDTH = 8, 3, 2.0
#: Vectors of a cell that are compared at a time.
TILE = 2048
#: What is granted to rounding: more than single precision can lose on unit vectors.
SLACK = 1e-5
#: A cell's number along a coordinate is kept in so many bits.
_BITS = 21


def rotation(dim: int, seed: int = 20) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def units(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows' numbers and their vectors at length one, in double precision."""
    good, out = [], []
    for i, v in enumerate(vectors):
        if v is not None and len(v) and None not in v:
            a = np.asarray(v, np.float64)
            top = np.abs(a).max()
            if np.isfinite(top) and top > 0:
                a = a / top  # so that squares of very large or small components stay finite
                good.append(i)
                out.append(a / np.sqrt(a @ a))
    return np.array(good, np.int64), out


class Grid:
    """Blocks, radius and cells for vectors of one length."""

    def __init__(self, dim: int, budget: float, blocks: int) -> None:
        self.turn = rotation(dim)
        parts = min(blocks, dim)
        self.edges = np.linspace(0, dim, parts + 1).astype(int)
        self.limit = budget / parts + SLACK
        self.radius = float(np.sqrt(self.limit))
        self.width = max(self.radius * WIDTH, 2.0 ** (3 - _BITS))

    def rotated(self, unit: np.ndarray) -> np.ndarray:
        return np.einsum("ij,jk->ik", unit, self.turn, optimize=False)  # row by row: a vector's numbers don't depend on its neighbours

    def block(self, x: np.ndarray, k: int) -> np.ndarray:
        return x[:, self.edges[k] : self.edges[k + 1]]

    def cell(self, p: np.ndarray) -> np.ndarray:
        """Number of the cell of each point of a block."""
        return _code(np.floor(p[:, :GRID] / self.width).astype(np.int64))


def _code(c: np.ndarray) -> np.ndarray:
    return ((c + (1 << _BITS - 1)) << (np.arange(c.shape[1]) * _BITS)).sum(axis=1)


def _corner(cell: int, n: int) -> np.ndarray:
    """The coordinates of a cell from its number."""
    return np.array([(cell >> j * _BITS & (1 << _BITS) - 1) - (1 << _BITS - 1) for j in range(n)])


def cells(vectors: DataFrame, budget: float, blocks: int) -> DataFrame:
    """Rows (label, dim, block, cell, id, point): each vector in every cell that its half-radius ball touches in a block."""

    def run(batches):
        grids: dict[int, Grid] = {}
        for b in batches:
            good, unit = units(b["v"].to_pylist())
            sizes = np.array([len(u) for u in unit], np.int64)
            for dim in np.unique(sizes).tolist():
                rows = good[sizes == dim]
                g = grids.setdefault(dim, Grid(dim, budget, blocks))
                x = g.rotated(np.stack([u for u in unit if len(u) == dim]))
                for k in range(len(g.edges) - 1):
                    p = g.block(x, k)
                    q = p[:, :GRID]
                    low, high = (np.floor((q + side * g.radius / 2) / g.width).astype(np.int64) for side in (-1, 1))
                    for corner in range(1 << q.shape[1]):
                        up = np.array([corner >> j & 1 for j in range(q.shape[1])], bool)
                        m = ((~up) | (high > low)).all(axis=1)
                        if m.any():
                            n, take = int(m.sum()), pa.array(rows[m])
                            yield pa.RecordBatch.from_arrays(
                                [b["label"].take(take), pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(_code(np.where(up, high, low)[m])), b["id"].take(take), pa.array([y.tobytes() for y in p[m].astype("<f4")], pa.binary())],
                                names=["label", "dim", "block", "cell", "id", "point"],
                            )

    return vectors.mapInArrow(run, "label string, dim int, block int, cell long, id long, point binary")


_KEYS = ["label", "dim", "block", "cell"]


def in_tiles(rows: DataFrame) -> DataFrame:
    """Adds i, j and side: a cell of very many vectors is split in tiles, every two of which meet once; cells of one vector go."""
    sizes = rows.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*_KEYS, F.ceil(F.col("n") / (2 * TILE)).cast("int").alias("tiles"))
    rows = rows.join(sizes, _KEYS).withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least("tile", o).alias("i"), F.greatest("tile", o).alias("j"), F.when(F.col("tile") > o, 1).when(F.col("tile") < o, 2).otherwise(0).alias("side")))
    return rows.withColumn("t", F.explode(meet)).select(*[c for c in rows.columns if c not in ("tiles", "tile")], "t.i", "t.j", "t.side")


def _meeting(side: np.ndarray, s: int, e: int) -> np.ndarray:
    """Which pairs of rows s..e with rows s.. a tile is for: each once, and of two tiles only across."""
    i, j = np.arange(s, e)[:, None], np.arange(s, len(side))[None]
    return (i < j) & ((side[s:e, None] != side[None, s:]) | (side[s:e, None] == 0))


def _candidates(budget: float, blocks: int):
    """The vectors of a tile that are near another in the block, their middle in this cell or so near that rounding decides."""

    def run(t: pa.Table) -> pa.Table:
        g = Grid(t["dim"][0].as_py(), budget, blocks)
        x = np.frombuffer(b"".join(t["point"].to_pylist()), "<f4").reshape(t.num_rows, -1)
        side, sq = t["side"].to_numpy(), (x * x).sum(axis=1)
        q = x[:, :GRID]
        low = _corner(t["cell"][0].as_py(), q.shape[1]) * g.width - 1e-5
        high = low + g.width + 2e-5
        near = np.zeros(t.num_rows, bool)
        for s in range(0, t.num_rows, TILE):
            e = min(s + TILE, t.num_rows)
            d = sq[s:e, None] + sq[None, s:] - 2 * (x[s:e] @ x[s:].T)
            i, j = np.nonzero((d <= g.limit + SLACK) & _meeting(side, s, e))
            middle = (q[s + i] + q[s + j]) / 2
            here = ((middle >= low) & (middle <= high)).all(axis=1)
            near[s + i[here]] = near[s + j[here]] = True
        return t.select([*_KEYS, "id"]).filter(pa.array(near))

    return run


def _links(budget: float, blocks: int, cosine: float):
    """Of a tile: for each vector how many others it is linked with in pairs that count here, and a representative of what it is joined to."""

    def run(t: pa.Table) -> pa.Table:
        dim, here, block = t["dim"][0].as_py(), t["cell"][0].as_py(), t["block"][0].as_py()
        g = Grid(dim, budget, blocks)
        v = np.frombuffer(b"".join(t["vector"].to_pylist()), "<f8").reshape(-1, dim)
        v = v / np.abs(v).max(axis=1, keepdims=True)
        norm = np.sqrt((v * v).sum(axis=1))
        x = g.rotated(v / norm[:, None])
        side, copies, ids = t["side"].to_numpy(), t["copies"].to_numpy(), t["id"].to_numpy()
        n_links, root = np.zeros(t.num_rows, np.int64), np.arange(t.num_rows)
        for s in range(0, t.num_rows, TILE):
            e = min(s + TILE, t.num_rows)
            found = ((v[s:e] / norm[s:e, None]) @ (v[s:] / norm[s:, None]).T >= cosine - 1e-9) & _meeting(side, s, e)
            rows, cols = np.nonzero(found)
            for k in range(0, len(rows), 1 << 15):
                i, j = s + rows[k : k + (1 << 15)], s + cols[k : k + (1 << 15)]
                m = (v[i] * v[j]).sum(axis=1) / (norm[i] * norm[j]) >= cosine
                for b in range(block):  # a block before this one counts the pair
                    m &= ((g.block(x[i], b) - g.block(x[j], b)) ** 2).sum(axis=1) > g.limit
                m &= ((g.block(x[i], block) - g.block(x[j], block)) ** 2).sum(axis=1) <= g.limit
                m &= g.cell((g.block(x[i], block) + g.block(x[j], block)) / 2) == here
                i, j = i[m], j[m]
                n_links += np.bincount(i, copies[j], t.num_rows).astype(np.int64) + np.bincount(j, copies[i], t.num_rows).astype(np.int64)
                while len(i):  # the smaller root takes the larger one, until no pair is left with two
                    a, z = root[i], root[j]
                    apart = a != z
                    i, j, a, z = i[apart], j[apart], a[apart], z[apart]
                    np.minimum.at(root, np.maximum(a, z), np.minimum(a, z))
                    while (root[root] != root).any():
                        root = root[root]
        linked = pa.array(n_links > 0)
        release()
        return pa.table([t["id"], pa.array(n_links), pa.array(ids[root])], names=["a", "others", "to"]).filter(linked)

    return run


def links(classes: DataFrame, scratch: Scratch, cosine: float, blocks: int = BLOCKS) -> DataFrame:
    """Rows (a, others, to): for classes (id, label, v, copies), linked vectors of other classes counted in parts, and edges that join what is linked."""
    budget = 2 - 2 * cosine
    near = in_tiles(cells(classes, budget, blocks)).groupBy(*_KEYS, "i", "j").applyInArrow(_candidates(budget, blocks), "label string, dim int, block int, cell long, id long")
    near = scratch.keep(near.distinct())

    def raw(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([np.asarray(x, "<f8").tobytes() for x in b["v"].to_pylist()], pa.binary()), b["copies"]], names=["id", "vector", "copies"])

    whole = classes.select("id", "v", "copies").mapInArrow(raw, "id long, vector binary, copies long")
    return in_tiles(near).join(whole, "id").groupBy(*_KEYS, "i", "j").applyInArrow(_links(budget, blocks, cosine), "a long, others long, to long")


def near_vectors(vectors: DataFrame, scratch: Scratch, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links and groups of all vectors: rows (id_col, n_links, component_id, kept).

    Vectors are compared if their labels are equal and not null. Equal vectors of a label are one class, so that copies
    are not expanded into pairs; they count as linked with each other. A vector that is null, empty, zero, or holds null
    or non-finite components links with nothing; so does one without a label or an id, and vectors of different lengths.
    `cosine` must be positive. Repeated rows count as other vectors.
    """
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), v.alias("v"))
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    some = F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = scratch.keep(rows.withColumn("key", F.when(finite & some & F.col("label").isNotNull() & F.col("id").isNotNull(), F.xxhash64("label", "v"))))
    usable = rows.where("key is not null")
    classes = scratch.keep(usable.groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))
    linked = scratch.keep(links(classes, scratch, cosine))
    other = linked.groupBy("a").agg(F.sum("others").alias("others"))
    found = components(linked.select("a", F.col("to").alias("b")), scratch).select(F.col("node").alias("a"), "component")
    of_class = classes.select(F.col("id").alias("a"), "label", "v", "copies").join(other, "a", "left").join(found, "a", "left")
    of_class = of_class.select("label", "v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "a").alias("component_id"))
    known = usable.join(of_class, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = known.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
