"""Greedy selection in order: of a key's spans the first is taken, then each that begins where the last one taken has ended.

One such fold needs a key's spans one after the other. A key of many spans is cut into slices of its order instead. In a slice every
span's fold is followed back from the last: where would the selection leave the slice if it came to this span? Few
different answers remain, since selections soon fall together. They are the nodes of a small graph, slice to slice; the
nodes that the key's beginning leads to are found by pointers that are doubled in rounds. Then each slice knows where it is
entered, and selects by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.sources.scratch import kept

#: Spans of a slice, about; a key with no more is folded as a whole.
SLICE_ROWS = 50_000


def _ends(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For spans in order: the next one that would be taken (their number: none), and the end with which the selection leaves the slice."""
    n = len(start)
    following = np.maximum(np.searchsorted(start, np.maximum(start, end), "left"), np.arange(1, n + 1))
    leaves = np.maximum(start, end)
    to = following.tolist()
    out = leaves.tolist()
    for i in range(n - 1, -1, -1):
        if to[i] < n:
            out[i] = out[to[i]]
    return following, np.array(out, np.int64)


def _ordered(t: pa.Table) -> pa.Table:
    return t.sort_by([("start", "ascending"), ("end", "ascending")])


def _numbers(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return t["start"].to_numpy(), t["end"].to_numpy()


def _taken(t: pa.Table, entry: int) -> pa.Table:
    following, _ = _ends(*_numbers(t))
    keep = []
    while entry < len(t):
        keep.append(entry)
        entry = int(following[entry])
    return t.take(pa.array(keep, pa.int64()))


def _code(key: Column) -> Column:
    """The key as a string that is never null, so that a null key is joined as any other."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("-"))


def chain(spans: DataFrame, slice_rows: int = SLICE_ROWS, begin: DataFrame | None = None) -> DataFrame:
    """The selected rows of spans (key, start, end, ...), start and end whole numbers that are not null.

    In order of start, then end, a span is taken if it begins where the last one taken has ended, or after. `begin` (key, from)
    says from where a key's first may begin; 0 otherwise. A span that ends before it begins counts as empty. Of rows with
    one start and end any order will do. A null key is a key of its own. The result has the columns of the input.
    """
    own = "own_key"
    while own in spans.columns:
        own += "_"
    out = _chain(spans.withColumn(own, F.col("key")).withColumn("key", _code(F.col("key"))), slice_rows, None if begin is None else begin.withColumn("key", _code(F.col("key"))))
    return out.withColumn("key", F.col(own)).select(*[f"`{c}`" for c in spans.columns])


def _chain(spans: DataFrame, slice_rows: int, begin: DataFrame | None) -> DataFrame:
    names = spans.columns
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.schema.fields)
    key = "string"
    x = spans.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})
    x = x.withColumn("from", F.lit(0).cast("long")) if begin is None else x.join(begin.select("key", F.col("from").cast("long").alias("from")), "key", "left").fillna({"from": 0})
    x = kept(x)
    sizes = x.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    large = kept(sizes.where(F.col("n") > slice_rows).select("key", "n"))

    def whole(t: pa.Table) -> pa.Table:
        t = _ordered(t)
        return _taken(t, int(np.searchsorted(t["start"].to_numpy(), t["from"][0].as_py(), "left"))).select(names)

    out = x.join(large, "key", "left_anti").groupBy("key").applyInArrow(whole, kind)
    if large.isEmpty():
        return out

    # slices of each large key, in order: what falls into one range of the order
    many = max(2, -(-int(large.agg(F.sum("n")).first()[0]) // slice_rows))
    big = x.join(large.select("key"), "key", "left_semi")
    big = kept(big.repartitionByRange(many, "key", "start", "end").withColumn("slice", F.spark_partition_id().cast("long")))

    def exits(t: pa.Table) -> pa.Table:
        t = _ordered(t)
        start, end = _numbers(t)
        found = np.unique(_ends(start, end)[1])
        n = len(found)
        return pa.table({"key": pa.repeat(t["key"][0], n), "slice": pa.repeat(t["slice"][0], n), "at": pa.array(found), "top": pa.repeat(pa.scalar(int(start[-1]), pa.int64()), n), "from": pa.repeat(t["from"][0], n)})

    left = kept(big.groupBy("key", "slice").applyInArrow(exits, f"key {key}, slice long, at long, top long, from long"))
    tops = left.groupBy("key", "slice").agg(F.max("top").alias("top"), F.max("from").alias("from"))
    first = tops.groupBy("key").agg(F.lit(-1).cast("long").alias("slice"), F.max("from").alias("at"))
    nodes = first.unionByName(left.select("key", "slice", "at"))
    # each node's next slice: the first behind its own whose last span begins at its end or later
    marks = tops.select("key", F.col("slice").alias("own"), F.col("top").alias("at"), F.lit(1).alias("mark")).withColumn("slice", F.lit(None).cast("long"))
    line = nodes.withColumn("own", F.lit(None).cast("long")).withColumn("mark", F.lit(0)).unionByName(marks)
    ahead = W.partitionBy("key").orderBy("at", "mark", "own").rowsBetween(0, W.unboundedFollowing)
    reach = line.withColumn("to", F.first("own", ignorenulls=True).over(ahead)).where("mark = 0 and to is not null")
    after = W.partitionBy("key").orderBy("slice")
    behind = tops.select("key", "slice", F.lead("slice").over(after).alias("after"))
    edge = reach.join(behind, ["key", "slice"], "left").select("key", "slice", "at", F.greatest("to", "after", F.when(F.col("slice") < 0, F.col("to"))).alias("to"), (F.col("slice") >= 0).alias("inner"), "after")
    edge = kept(edge.where("not inner or after is not null").select("key", "slice", "at", "to"))

    def through(t: pa.Table, asked: pa.Table) -> pa.Table:
        """For each node that leads into the slice: the node at which the selection leaves it."""
        if not len(t) or not len(asked):
            return pa.table({c: pa.array([], k) for c, k in (("key", asked.schema.field("key").type), ("slice", pa.int64()), ("at", pa.int64()), ("to", pa.int64()), ("leaves", pa.int64()), ("entry", pa.int64()))})
        t = _ordered(t)
        start, end = _numbers(t)
        entry = np.searchsorted(start, asked["at"].to_numpy(), "left")
        return pa.table({"key": asked["key"], "slice": asked["slice"], "at": asked["at"], "to": asked["to"], "leaves": pa.array(_ends(start, end)[1][entry]), "entry": pa.array(entry.astype(np.int64))})

    hop = big.groupBy("key", "slice").cogroup(edge.groupBy("key", "to")).applyInArrow(through, f"key {key}, slice long, at long, to long, leaves long, entry long")
    hop = kept(hop)
    node = F.struct("slice", "at")
    jump = hop.select("key", node.alias("node"), F.struct(F.col("to").alias("slice"), F.col("leaves").alias("at")).alias("next"))
    seen = kept(hop.where("slice = -1").select("key", node.alias("node")))
    while True:  # seen: what 2^k steps reach; jump: 2^k steps at once
        step = seen.join(jump, ["key", "node"]).select("key", F.col("next").alias("node"))
        now = kept(seen.unionByName(step).distinct())
        twice = jump.select("key", F.col("node").alias("next"), F.col("next").alias("last"))
        further = kept(jump.join(twice, ["key", "next"]).select("key", "node", F.col("last").alias("next")))
        seen, jump = now, further
        if jump.isEmpty():
            break
    entries = hop.join(seen.select("key", "node.slice", "node.at"), ["key", "slice", "at"], "left_semi").select("key", F.col("to").alias("slice"), "entry").distinct()

    def select(t: pa.Table, entry: pa.Table) -> pa.Table:
        t = _ordered(t)
        return _taken(t, entry["entry"][0].as_py() if len(entry) and len(t) else len(t)).select(names)

    return out.unionByName(big.groupBy("key", "slice").cogroup(entries.groupBy("key", "slice")).applyInArrow(select, kind))
