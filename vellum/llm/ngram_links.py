"""Counting the links of an n-gram Jaccard join whose components are known: each pair is compared once, none is written.

Links lie within components. A component's sets are compared with each other in tiles of bounded size; of a component
too large for one tile it is counted whether its inverted lists hold fewer pairs than it has itself, and if so the
tiles are made of each list, a pair counting only in the first list that both sets are in. What leaves a tile is a
number for each of its sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, blocks_of, release

#: Sets and shingles of one side of a tile; a set of more shingles has a tile side of its own.
SIDE, SHINGLES = 1024, 1 << 20
#: Bytes of shingles for each group of tiles.
GROUP_BYTES = 24_000_000
#: What a pair in a list costs, in pairs of a component.
LISTED = 1.0

_GROUP = ["label", "listed", "key"]
_TILE = [*_GROUP, "band", "i", "j", "up"]


class _Inverted:
    """Which of some sets hold each item."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.many = len(sets)
        self.item, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        self.owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[np.argsort(inverse, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(self.item)))])

    def shared(self, x: np.ndarray) -> np.ndarray:
        """How many items each of the sets has in common with x."""
        at = np.searchsorted(self.item, x)
        inside = at < len(self.item)
        at = at[inside]
        at = at[self.item[at] == x[inside]]
        if not len(at):
            return np.zeros(self.many, np.int64)
        return np.bincount(np.concatenate([self.owner[self.starts[k] : self.starts[k + 1]] for k in at.tolist()]), minlength=self.many)


def _tile_links(side: np.ndarray, among: bool, sets: list[np.ndarray], earlier: list[np.ndarray] | None, copies: np.ndarray, num: int, den: int) -> np.ndarray:
    """Links of each set of a tile: those of side 1 with those of side 0, or with each other in a tile of one part (`among`)."""
    links = np.zeros(len(sets), np.int64)
    outer = np.flatnonzero(side == 1)
    inner = outer if among else np.flatnonzero(side == 0)
    if not len(outer) or not len(inner):
        return links
    n = np.array([len(x) for x in sets])
    index = _Inverted([sets[i] for i in inner])
    before = _Inverted([earlier[i] for i in inner]) if earlier else None
    for k, i in enumerate(outer.tolist()):
        shared = index.shared(sets[i])
        fits = den * shared >= num * (n[i] + n[inner] - shared)
        if among:
            fits[: k + 1] = False
        if before is not None and fits.any():
            fits &= before.shared(earlier[i]) == 0
        j = inner[fits]
        links[i] += copies[j].sum()
        links[j] += copies[i]
    return links


def _counted(num: int, den: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.compute.sort_indices(t, [(c, "ascending") for c in _TILE]))
        parts = np.stack([t[c].cast(pa.int64()).to_numpy() for c in _TILE])
        cuts = np.concatenate([[0], np.flatnonzero((parts[:, 1:] != parts[:, :-1]).any(axis=0)) + 1, [len(t)]]) if len(t) else [0]
        side, copies, listed, key = t["side"].to_numpy(), t["copies"].to_numpy(), t["listed"].to_numpy(), t["key"].to_numpy()
        links = np.zeros(len(t), np.int64)
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["shingles"].slice(s, e - s)]
            earlier = None
            if listed[s]:
                earlier = [np.array(x, np.int64) for x in t["keys"].slice(s, e - s).to_pylist()]
                earlier = [x[x < key[s]] for x in earlier]
            _, _, _, _, i, j, up = parts[:, s]
            links[s:e] = _tile_links(side[s:e], i == j and not up, sets, earlier, copies[s:e], num, den)
        some = links > 0
        release()
        return pa.table([t["id"].filter(pa.array(some)), pa.array(links[some])], names=["id", "links"])

    return run


def tiles(rows: DataFrame, num: int, den: int) -> DataFrame:
    """The rows (group, id, n, ..) once for each tile that they are in.

    Groups beyond one tile are banded by size, and only the same and the next band can hold a partner. Tile (band, i, j, up)
    compares part i of the band with part j of the same (up = 0, i <= j) or the next one (up = 1).
    """
    long, shingles = F.count(F.lit(1)), F.sum("n")
    fits = (F.col("long") <= SIDE) & (F.col("shingles") <= SHINGLES)
    sizes = rows.groupBy(*_GROUP).agg(long.alias("long"), shingles.alias("shingles")).where("long > 1")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + F.lit(1e-9)).cast("int") if num < den else F.lit(0)
    rows = rows.join(sizes, _GROUP).withColumn("band", F.when(fits, 0).otherwise(band)).drop("long", "shingles")
    parts = rows.groupBy(*_GROUP, "band").agg(F.greatest(F.ceil(long / SIDE), F.ceil(shingles / SHINGLES)).cast("int").alias("parts"))
    parts = parts.groupBy(*_GROUP).agg(F.map_from_entries(F.collect_list(F.struct("band", "parts"))).alias("parts"))  # bounded by the bands
    of = lambda k: F.coalesce(F.try_element_at("parts", F.col("band") + F.lit(k)), F.lit(0))
    upto = lambda c: F.filter(F.sequence(F.lit(0), c), lambda x: x < c)
    part = F.col("part")
    tile = lambda b, i, j, up, side: F.struct(b.alias("band"), i.alias("i"), j.alias("j"), F.lit(up).alias("up"), F.lit(side).alias("side"))
    where = F.concat(
        F.transform(F.filter(upto(of(0)), lambda j: j >= part), lambda j: tile(F.col("band"), part, j, 0, 1)),
        F.transform(upto(part), lambda i: tile(F.col("band"), i, part, 0, 0)),
        F.transform(upto(of(1)), lambda j: tile(F.col("band"), part, j, 1, 1)),
        F.transform(upto(of(-1)), lambda i: tile(F.col("band") - F.lit(1), i, part, 1, 0)),
    )
    rows = rows.join(parts, _GROUP).withColumn("part", F.pmod(F.xxhash64("id"), of(0)).cast("int")).withColumn("tile", F.explode(where))
    return rows.drop("band", "part", "parts").select("*", "tile.*").drop("tile")


def link_counts(found: DataFrame, members: DataFrame, sets: DataFrame, copies: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """Rows (id, links): with how many documents of other sets each set of a component is linked.

    `found` has (node, component), `members` the inverted lists (key, id), `sets` (id, n, shingles), `copies` (id, copies).
    """
    own = found.select(F.col("node").alias("id"), F.col("component").alias("label"))
    own = scratch.keep(sets.select("id", "n").join(own, "id").join(copies, "id"))
    large = scratch.keep(own.groupBy("label").agg(F.count(F.lit(1)).alias("long")).where(F.col("long") > SIDE))
    whole = lambda df: df.select("label", F.lit(False).alias("listed"), F.lit(0).cast("long").alias("key"), "id", "n", "copies")
    keys = None
    if large.limit(1).count():
        of_large = scratch.keep(members.select("key", "id").join(own.join(large, "label"), "id"))
        listed = of_large.groupBy("label", "key").agg(F.count(F.lit(1)).alias("m"), F.first("long").alias("long")).groupBy("label").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("lists"), F.first("long").alias("long"))
        listed = scratch.keep(listed.where(F.col("lists") * LISTED < F.col("long").cast("double") * F.col("long")).select("label"))
        of_lists = scratch.keep(of_large.join(listed, "label", "left_semi"))
        keys = of_lists.groupBy("id").agg(F.collect_set("key").alias("keys"))  # bounded by a set's prefix
        rows = whole(own.join(listed, "label", "left_anti")).unionByName(of_lists.select("label", F.lit(True).alias("listed"), "key", "id", "n", "copies"))
    else:
        rows = whole(own)
    dealt = scratch.keep(tiles(rows, num, den))
    groups = blocks_of(8 * (dealt.agg(F.sum("n")).first()[0] or 0), GROUP_BYTES)
    dealt = dealt.join(sets.select("id", "shingles"), "id")
    dealt = dealt.join(keys, "id", "left") if keys is not None else dealt.withColumn("keys", F.lit(None).cast("array<long>"))
    dealt = dealt.select(F.pmod(F.xxhash64(*_TILE), F.lit(groups)).cast("int").alias("g"), *_TILE, "side", "id", "copies", "shingles", "keys")
    return dealt.groupBy("g").applyInArrow(_counted(num, den), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
