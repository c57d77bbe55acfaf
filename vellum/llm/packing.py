"""Packing: cutting-stock column generation over the histogram of piece lengths.

Documents longer than a sequence are cut into full pieces and a remainder. Lengths are counted in units, so the
linear program has one row for each class of lengths, however many documents there are: its columns (patterns
of lengths that fill a sequence) are priced by a knapsack dynamic program, its solution is rounded down, what
is left over is placed first-fit by counts. Documents are ranked within their class, and a document's rank
gives its place in the patterns.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, encoder, release, slices, with_end

CAPACITY, UNIT = 4096, 8
#: Most rounds of column generation; every round's basis is a feasible plan, so a bound only costs padding.
ROUNDS = 3000
#: About so many pieces of a class are ranked in one task.
RANKED = 50_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens) of the whole texts' ids with the end id.

    A null or empty text is one piece, the end id. Rows are cut each by itself, so repeated rows and rows without an id are
    documents of their own. Only doc_id and text are read; an empty table gives an empty result.
    """

    def run(batches):
        for b in batches:
            for s, e in slices(b["text"]):
                ids, n = encoder(tokenizer).encode(b["text"].slice(s, e - s).cast(pa.binary()).fill_null(b"").to_pylist())
                data, n = with_end(ids, n, end_id)
                at, rows = 0, []
                for i, long in enumerate(n.tolist()):
                    for p in range(0, long, capacity):
                        size = min(capacity, long - p)
                        rows.append((i, p, size, zlib.crc32(data[at + p : at + p + size].tobytes()), long))
                    at += long
                row, *cols = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(s, e - s).take(pa.array(row)), *map(pa.array, cols)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


# --------------------------------------------------------------------------- the plan, from the histogram alone


def knapsack(price: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of lengths 1..room: its value and how many of each length. price[i] is of length i + 1."""
    best, pick = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        v = price[:c] + best[c - 1 :: -1][:c]
        i = int(v.argmax())
        best[c], pick[c] = (v[i], i + 1) if v[i] > best[c - 1] else (best[c - 1], 0)
    count, c = np.zeros(room, np.int64), room
    while c > 0:
        if pick[c]:
            count[pick[c] - 1] += 1
            c -= pick[c]
        else:
            c -= 1
    return float(best[room]), count


def solve(demand: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used in the linear program: least sequences that hold the demand.

    Revised simplex from the patterns of one length each, with the inverse of the basis kept.
    """
    room = len(demand)
    have = np.flatnonzero(demand)
    if not len(have):
        return np.empty((0, room), np.int64), np.empty(0)
    fit = room // (have + 1)
    inverse, basis = np.diag(1.0 / fit), [(h, f) for h, f in zip(have, fit, strict=True)]
    patterns = np.zeros((len(have), room), np.int64)
    for k, (h, f) in enumerate(basis):
        patterns[k, h] = f
    x = demand[have] / fit
    for _ in range(rounds):
        price = np.full(room, -1.0)
        price[have] = np.maximum(inverse.sum(axis=0), 0)
        value, column = knapsack(price, room)
        if value <= 1 + 1e-7:
            break
        d = inverse @ column[have]
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        x = np.maximum(x - step * d, 0)
        x[out] = step
        row = inverse[out] / d[out]
        inverse = inverse - np.outer(d, row)
        inverse[out] = row
        patterns[out] = column
    return patterns, x


def plan(demand: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Whole uses of patterns that hold the demand, which counts pieces by length in units (index 0: one unit)."""
    demand = demand.astype(np.int64)
    patterns, x = solve(demand, rounds)
    left, out = demand.copy(), []
    for p, n in zip(patterns, np.floor(x + 1e-6).astype(np.int64), strict=True):
        if n > 0:
            out.append((p, int(n)))
            left -= p * n
    left = np.maximum(left, 0)
    # first fit by decreasing length; what is left is bounded by the patterns, not by the documents
    while left.any():
        p, room = np.zeros_like(left), len(left)
        for i in np.flatnonzero(left)[::-1]:
            k = min(int(left[i] - p[i]), room // (int(i) + 1))
            if k > 0:
                p[i] += k
                room -= k * (int(i) + 1)
        n = int((left[p > 0] // p[p > 0]).min())
        out.append((p, n))
        left -= p * n
    return out


def places(chosen: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each class, the runs of ranks that a pattern takes: first rank, first sequence, places in it, first place."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for p, n in chosen:
        place = 0
        for i in np.flatnonzero(p)[::-1]:
            k = int(p[i])
            runs.setdefault(int(i), []).append((taken.get(int(i), 0), sequence, k, place))
            taken[int(i)] = taken.get(int(i), 0) + k * n
            place += k
        sequence += n
    return {c: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for c, r in runs.items()}


# --------------------------------------------------------------------------- Spark


def pack(spark: SparkSession, cut: DataFrame, scratch: Scratch, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ids_crc32, doc_tokens, ...) of at most `capacity` tokens.

    The histogram that goes to the driver has capacity / unit numbers. Ranks within a class are made in parts, whose
    sizes are summed first, so that a length which very many documents have is not ranked in one task. Offsets are
    gapless from 0. Ties in rank fall to the smaller doc_id, start and crc; repeated rows are pieces of their own. An
    empty table gives an empty result. All columns of the input come back, whatever their names, but those that are named
    sequence_id or offset, which the new ones replace.
    """
    mine = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    own = {}  # names for the work that no column of the caller's has
    for c in ("class", "part", "rank", "before", "place", "n"):
        own[c] = c
        while own[c] in mine:
            own[c] += "_"
    cls, part, rank, before, place, n = own.values()
    cut = scratch.keep(cut.select(*(F.col(f"`{c}`") for c in mine)).withColumn(cls, F.ceil(F.col("length") / unit).cast("int") - 1))
    parts = max(1, -(-cut.count() // RANKED))
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    parted = cut.withColumn(part, F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)).cast("int"))
    sizes = parted.groupBy(cls, part).agg(F.count(F.lit(1)).alias(n))
    sizes = scratch.keep(sizes.withColumn(before, F.coalesce(F.sum(n).over(W.partitionBy(cls).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    demand = np.zeros(-(-capacity // unit), np.int64)
    for r in sizes.groupBy(cls).agg(F.sum(n).alias("n")).collect():  # at most capacity / unit rows
        demand[r[cls]] = r["n"]
    where = spark.sparkContext.broadcast(places(plan(demand)))  # at most patterns * lengths of a pattern numbers

    def placed(batches):
        for b in batches:
            kind, at = b[cls].to_numpy(), b[rank].to_numpy()
            seq, spot = np.empty(len(kind), np.int64), np.empty(len(kind), np.int64)
            for c in np.unique(kind):
                first, begin, each, start = where.value[int(c)]
                m = kind == c
                k = np.searchsorted(first, at[m], side="right") - 1
                r = at[m] - first[k]
                seq[m], spot[m] = begin[k] + r // each[k], start[k] + r % each[k]
            yield pa.RecordBatch.from_arrays([*(b[x] for x in mine), pa.array(seq), pa.array(spot)], names=[*mine, "sequence_id", place])

    inside = F.row_number().over(W.partitionBy(cls, part).orderBy(*order)) - 1
    ranked = parted.withColumn(rank, inside.cast("long")).join(sizes.select(cls, part, before), [cls, part])
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(before)).drop(part, before)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name in mine)
    out = ranked.select(*(F.col(f"`{c}`") for c in [*mine, cls, rank])).mapInArrow(placed, f"{kinds}, sequence_id long, `{place}` long")
    ahead = W.partitionBy("sequence_id").orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop(place)
