"""Suffix-array dedup of bytes: a sparse suffix sort whose comparisons are by prefix hashes.

Each string of `size` bytes picks one anchor in it by content: the place whose following GRAM bytes hash least.
Equal strings pick the same place, so two strings of `size` bytes are equal only if their anchors have the same
gram and agree far enough to both sides. Anchors of one gram meet; those whose whole surroundings are equal are
one class, and only one of a class takes part. The classes' right sides and reversed left sides are suffix-sorted:
prefix polynomial hashes and binary search find the common extension of two suffixes, mergesort runs on these
comparisons, and the bytes of neighbours are compared at last. The sorted common extensions say how far each
class agrees with another to both sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, blocks_of, mix, total_chars

#: Bytes of an anchor's gram (a power of two).
GRAM = 64
#: Bytes that are scanned for anchors at a time; characters of text for each group of grams.
CHUNK, GROUP_CHARS = 1 << 19, 4_000_000
#: Most different surroundings of one gram that are sorted in one task; grams with more are counted window by window.
MOST_SORTED = 20_000
#: Most grams of the second kind that are broadcast; there is at most one to MOST_SORTED anchors.
MOST_BROADCAST = 1_000_000
#: Odd bases of the hashes (fixed values; any odd numbers of good spread do) and the inverse of the second.
_GRAM_BASE = 0xD6E8FEB86659FD93
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


# --------------------------------------------------------------------------- anchors


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w."""
    n, have = len(x) - w + 1, 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x[:n]


def anchors(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors of all strings of `size` bytes in texts laid end to end."""
    if len(data) < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h, have = _BYTE[data], 1
    while have < GRAM:
        h = h[:-have] * np.uint64(pow(_GRAM_BASE, have, 1 << 64)) + h[have:]
        have *= 2
    h = mix(h)
    # the place is in the low bits, so that the first of equal hashes wins; it is known up to the window anyway
    tagged = (h & np.uint64(~0xFFFFF & (1 << 64) - 1)) | (np.arange(len(h), dtype=np.uint64) & np.uint64(0xFFFFF))
    low = _least(tagged, size - GRAM + 1)
    ok = np.ones(len(low), bool)
    for e in ends[:-1]:  # strings that cross from one text into the next are none
        ok[max(0, e - size + 1) : e] = False
    low = low[ok]
    if not len(low):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = (low[np.concatenate([[True], low[1:] != low[:-1]])] & np.uint64(0xFFFFF)).astype(np.int64)
    return at, h[at]


def text_anchors(texts: list[bytes], size: int):
    """Yields (number of text, places in it, gram hashes), whatever the texts' lengths."""
    group, n = [], 0
    for i, t in enumerate(texts):
        if len(t) > CHUNK:
            at, h = [], []
            for s in range(0, len(t) - size + 1, CHUNK):
                a, x = anchors(np.frombuffer(t[s : s + CHUNK + size - 1], np.uint8), np.array([0]), size)
                at.append(a + s)
                h.append(x)
            at, first = np.unique(np.concatenate(at), return_index=True)
            yield i, at, np.concatenate(h)[first]
        elif len(t) >= size:
            group.append(i)
            n += len(t)
            if n > CHUNK:
                yield from _laid(texts, group, size)
                group, n = [], 0
    yield from _laid(texts, group, size)


def _laid(texts: list[bytes], group: list[int], size: int):
    if not group:
        return
    ends = np.cumsum([len(texts[i]) for i in group])
    at, h = anchors(np.frombuffer(b"".join([texts[i] for i in group]), np.uint8), ends, size)
    cut = np.searchsorted(at, np.concatenate([[0], ends]))
    for k, i in enumerate(group):
        s, e = cut[k], cut[k + 1]
        yield i, at[s:e] - (ends[k] - len(texts[i])), h[s:e]


def find_anchors(docs: DataFrame, size: int) -> DataFrame:
    """Rows (gram, c1, c2, id, at, left, right): anchors with a 128-bit hash of their surroundings and how far these reach."""

    def run(batches):
        for b in batches:
            ids = b["id"].to_numpy()
            for s in range(0, b.num_rows, 512):
                texts = [(t or "").encode() for t in b["text"].slice(s, 512).to_pylist()]
                own, places, grams, hashes = [], [], [], []
                for i, at, h in text_anchors(texts, size):
                    t = texts[i]
                    own.append(np.full(len(at), ids[s + i]))
                    places.append(np.stack([at, np.minimum(at, size - GRAM), np.minimum(len(t) - at, size)]))
                    grams.append(h)
                    hashes.extend([xxhash.xxh3_128_digest(t[max(0, a - size + GRAM) : a + size]) for a in at.tolist()])
                if own:
                    c = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                    at, left, right = np.concatenate(places, axis=1)
                    cols = [np.concatenate(grams).view(np.int64), c[:, 0], c[:, 1], np.concatenate(own), at, left.astype(np.int32), right.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["gram", "c1", "c2", "id", "at", "left", "right"])

    return docs.mapInArrow(run, "gram long, c1 long, c2 long, id long, at long, left int, right int")


# --------------------------------------------------------------------------- suffix sort of the surroundings


class _Suffixes:
    """Strings laid end to end, with the prefix hashes by which their extensions are compared."""

    def __init__(self, strings: list[bytes]) -> None:
        self.long = np.array([len(s) for s in strings], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.long)[:-1]]).astype(np.int64)
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        n = len(self.data)
        with np.errstate(over="ignore"):
            power = np.full(n + 1, np.uint64(_BASE))
            power[0] = 1
            self.power = np.multiply.accumulate(power)
            back = np.full(n + 1, np.uint64(_INVERSE))
            back[0] = 1
            self.back = np.multiply.accumulate(back)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[self.data] * self.power[:n], dtype=np.uint64)])

    def _hash(self, begin: np.ndarray, long: np.ndarray) -> np.ndarray:
        return (self.sums[begin + long] - self.sums[begin]) * self.back[begin]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of strings i and j, by binary search on the hashes."""
        a, b = self.begin[i], self.begin[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.long[i], self.long[j])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self._hash(a, mid) == self._hash(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        c = self.common(i, j)
        ends_i, ends_j = c == self.long[i], c == self.long[j]
        last = len(self.data) - 1
        x, y = self.data[np.minimum(self.begin[i] + c, last)], self.data[np.minimum(self.begin[j] + c, last)]
        return np.where(ends_i, ~ends_j, ~ends_j & (x < y))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of the strings by group (ascending numbers, together), then suffix: mergesort of all groups at once."""
        order = np.arange(len(group))
        first = np.searchsorted(group, group)
        size = np.bincount(group)[group] if len(group) else group
        place = order - first
        run = 1
        while run < (size.max() if len(size) else 0):
            # each item's rank in the run beside its own, by binary search; equal items keep their order
            k = place // run
            beside = first + (k ^ 1) * run
            low = np.minimum(beside, first + size)
            high = np.minimum(low + run, first + size)
            base, right = low.copy(), (k & 1) == 1
            todo = np.flatnonzero(low < high)
            while len(todo):
                mid = (low[todo] + high[todo]) >> 1
                me, it = order[todo], order[mid]
                before = np.where(right[todo], ~self.less(me, it), self.less(it, me))
                low[todo] = np.where(before, mid + 1, low[todo])
                high[todo] = np.where(before, high[todo], mid)
                todo = todo[low[todo] < high[todo]]
            to = first + (k & ~1) * run + place % run + (low - base)
            new = np.empty_like(order)
            new[to] = order
            order, run = new, run * 2
        return order

    def neighbours(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Common extension of each string with the one before it in the order; -1 at the first of a group. Verified by bytes."""
        out = np.full(len(order), -1, np.int64)
        at = np.flatnonzero(group[1:] == group[:-1]) + 1
        if len(at):
            i, j = order[at - 1], order[at]
            c = self.common(i, j)
            for s in range(0, len(at), 65536):
                p, q, n = i[s : s + 65536], j[s : s + 65536], c[s : s + 65536]
                step = np.arange(int(n.max(initial=0)))
                inside = step < n[:, None]
                last = len(self.data) - 1
                wrong = (self.data[np.minimum(self.begin[p][:, None] + step, last)] != self.data[np.minimum(self.begin[q][:, None] + step, last)]) & inside
                c[s : s + 65536] = np.where(wrong.any(axis=1), wrong.argmax(axis=1), n)
            out[at] = c
        return out


def _reach(left: _Suffixes, right: _Suffixes, group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string of its group, how far to the left and right it agrees with another over `size` bytes or more in all."""
    by_left, by_right = left.sort(group), right.sort(group)
    lcp_left, lcp_right = left.neighbours(by_left, group), right.neighbours(by_right, group)
    far_left, far_right = np.full(len(group), -1, np.int64), np.full(len(group), -1, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.append(starts[1:], len(group))
    two = ends - starts == 2
    s = starts[two]
    li, ri = lcp_left[s + 1], lcp_right[s + 1]
    ok = li + ri >= size
    for k in (0, 1):
        far_left[s[ok] + k], far_right[s[ok] + k] = li[ok], ri[ok]
    for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
        ol, orr, ll, lr = by_left[s:e] - s, by_right[s:e] - s, lcp_left[s + 1 : e], lcp_right[s + 1 : e]
        for far, values, other in ((far_left, ll, "r"), (far_right, lr, "l")):
            done = np.full(e - s, -1, np.int64)
            for d in np.unique(values)[::-1]:
                if d < 0 or (done >= 0).all():
                    break
                need = max(size - d, 0)
                x, y = (d, need) if other == "r" else (need, d)
                cl, cr = np.empty(e - s, np.int64), np.empty(e - s, np.int64)
                cl[ol] = np.concatenate([[0], np.cumsum(ll < x)])
                cr[orr] = np.concatenate([[0], np.cumsum(lr < y)])
                _, inv, n = np.unique(cl * (e - s) + cr, return_inverse=True, return_counts=True)
                m = (n[inv] > 1) & (done < 0)
                done[m] = d
            far[s:e] = done
    return far_left, far_right


def _agree(size: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.compute.sort_indices(t, [("gram", "ascending"), ("c1", "ascending"), ("c2", "ascending")]))
        gram = t["gram"].to_numpy()
        _, group = np.unique(gram, return_inverse=True)
        near, at = t["near"].to_pylist(), t["left"].to_pylist()
        left = _Suffixes([x[:k][::-1] for x, k in zip(near, at, strict=True)])
        right = _Suffixes([x[k:] for x, k in zip(near, at, strict=True)])
        far_left, far_right = _reach(left, right, group, size)
        m = pa.array(far_left >= 0)
        return pa.table([t["gram"], t["c1"], t["c2"], pa.array(far_left.astype(np.int32)), pa.array(far_right.astype(np.int32))], names=["gram", "c1", "c2", "far_left", "far_right"]).filter(m)

    return run


# --------------------------------------------------------------------------- Spark


def _counted(near: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """What `_agree` gives, for grams whose surroundings are too many for one task: every string of `size` bytes around an
    anchor is counted by its 128-bit hash, and the outermost that start at two places tell how far a class reaches. Places
    count, not rows: where a gram comes again within `size` bytes of one text, each of its anchors lists the same string.
    Nothing is gathered."""

    def windows(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                back, start, one, two = [], [], [], []
                for at, left, t in zip(part["at"].to_pylist(), part["left"].to_pylist(), part["near"].to_pylist(), strict=True):
                    first = min(left, len(t) - size)  # strings that start later begin after the anchor or pass the text's end
                    back.append([left - p for p in range(first + 1)])
                    start.append([at - left + p for p in range(first + 1)])
                    h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(t[p : p + size]) for p in range(first + 1)]), np.int64).reshape(-1, 2)
                    one.append(h[:, 0])
                    two.append(h[:, 1])
                cols = [part["gram"], part["c1"], part["c2"], part["id"], pa.array(back, pa.list_(pa.int32())), *[pa.array(x, pa.list_(pa.int64())) for x in (start, one, two)]]
                yield pa.RecordBatch.from_arrays(cols, names=["gram", "c1", "c2", "id", "back", "start", "h1", "h2"])

    key = ["gram", "c1", "c2"]
    rows = near.select(*key, "id", "at", "left", "near").mapInArrow(windows, "gram long, c1 long, c2 long, id long, back array<int>, start array<long>, h1 array<long>, h2 array<long>")
    rows = rows.select(*key, "id", F.explode(F.arrays_zip("back", "start", "h1", "h2")).alias("w")).select(*key, "id", "w.back", "w.start", "w.h1", "w.h2")
    places = rows.groupBy("gram", "h1", "h2").agg(F.min("id").alias("id"), F.max("id").alias("last_id"), F.min("start").alias("start"), F.max("start").alias("last_start"))
    twice = scratch.keep(places.where("id < last_id or start < last_start").select("gram", "h1", "h2"))  # so that a frequent string's join can be split
    far = rows.join(twice, ["gram", "h1", "h2"]).groupBy(*key).agg(F.max("back").alias("far_left"), F.min("back").alias("least"))
    return far.select(*key, "far_left", (F.lit(size) - F.col("least")).cast("int").alias("far_right"))


def repeated_ranges(docs: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """Rows (id, ranges): byte ranges (start, end) of a text that strings of `size` bytes found elsewhere cover; they may overlap."""
    found = scratch.keep(find_anchors(docs, size))
    key = ["gram", "c1", "c2"]
    classes = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "at", "left", "right")).alias("one"))
    classes = scratch.keep(classes)
    grams = scratch.keep(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    hot = grams.where(F.col("kinds") > MOST_SORTED).select("gram")
    few = F.broadcast(hot) if hot.count() <= MOST_BROADCAST else hot  # so that no gram's classes meet in one task
    several = classes.join(few, "gram", "left_anti").join(grams.where(F.col("kinds") <= MOST_SORTED), "gram").select(*key, "one.*", F.lit(False).alias("many"))
    several = several.unionByName(classes.join(few, "gram").select(*key, "one.*", F.lit(True).alias("many")))
    wanted = several.groupBy("id").agg(F.collect_list(F.struct(*key, "at", "left", "right", "many")).alias("wanted"))  # bounded by the text

    def cut(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                rows = []
                for i, text, want in zip(part["id"].to_pylist(), part["text"].to_pylist(), part["wanted"].to_pylist(), strict=True):
                    t = (text or "").encode()
                    rows.extend((w["gram"], w["c1"], w["c2"], i, w["at"], w["left"], t[w["at"] - w["left"] : w["at"] + w["right"]], w["many"]) for w in want)
                kinds = [*[pa.int64()] * 5, pa.int32(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=[*key, "id", "at", "left", "near", "many"])

    near = docs.join(wanted, "id").select("id", "text", "wanted").mapInArrow(cut, "gram long, c1 long, c2 long, id long, at long, left int, near binary, many boolean")
    groups = blocks_of(total_chars(docs), GROUP_CHARS)
    if hot.limit(1).count():
        near = scratch.keep(near)
        counted = _counted(near.where("many"), scratch, size)
    else:
        counted = None
    sorted_ = near.where("not many").select(*key, "left", "near", F.pmod("gram", F.lit(groups)).cast("int").alias("g"))
    part = sorted_.groupBy("g").applyInArrow(_agree(size), "gram long, c1 long, c2 long, far_left int, far_right int")
    if counted is not None:
        part = part.unionByName(counted)
    none = F.lit(None).cast("int")
    whole = classes.where("n > 1").select(*key, none.alias("far_left"), none.alias("far_right"))  # all of the surroundings
    once = classes.where("n = 1").select(*key)
    reach = scratch.keep(part.join(once, key, "left_semi").unionByName(whole))
    hit = found.join(reach, key).select("id", F.struct((F.col("at") - F.coalesce("far_left", "left")).alias("s"), (F.col("at") + F.coalesce("far_right", "right")).alias("e")).alias("r"))
    return hit.groupBy("id").agg(F.collect_list("r").alias("ranges"))  # bounded by the text


def suffix_dedup(docs: DataFrame, scratch: Scratch, size: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each byte that a string of `size` bytes covers which also starts anywhere else: rows (id_col, n_bytes, n_removed, removed, kept).

    Texts are whole and UTF-8; matches don't cross documents, overlaps within one count. `removed` has the maximal
    removed runs as starts and ends by turns, `kept` the other bytes, which need not be valid UTF-8. A null text is
    empty; texts shorter than `size` keep all. Rows are matched to their text by id; of rows that share an id, or have
    none, each counts as a text of its own: they are told apart by a number of the row. Surroundings of 736 bytes that are
    equal by a 128-bit digest are one class; the common extensions of different classes are verified by their bytes. Other
    columns are not read and don't come back, whatever their names; an empty table gives an empty result.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    own = docs.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc is null").limit(1).count() > 0
    if own:
        docs = scratch.keep(docs.withColumn("id", F.monotonically_increasing_id()))
    else:
        docs = docs.withColumn("id", F.col("doc"))
    ranges = scratch.keep(repeated_ranges(docs.select("id", "text"), scratch, size))

    def apply(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                n, gone, runs, kept = [], [], [], []
                for text, rs in zip(part["text"].to_pylist(), part["ranges"].to_pylist(), strict=True):
                    t = (text or "").encode()
                    out: list[int] = []
                    for r in sorted((r["s"], r["e"]) for r in rs or ()):
                        if out and r[0] <= out[-1]:
                            out[-1] = max(out[-1], r[1])
                        else:
                            out.extend(r)
                    edges = [0, *out, len(t)]
                    kept.append(b"".join([t[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)]))
                    n.append(len(t))
                    gone.append(len(t) - len(kept[-1]))
                    runs.append(out)
                yield pa.RecordBatch.from_arrays([part["doc"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "n_removed", "removed", "kept"])

    return docs.join(ranges, "id", "left").select("doc", "text", "ranges").mapInArrow(apply, f"`{id_col}` long, n_bytes long, n_removed long, removed array<long>, kept binary")
