"""N-gram Jaccard join: size-aware, heavy-light.

Equal shingle sets are one class. Between classes, all tokens are ordered from rare to frequent; two sets of
similarity t or more share a token among the first n - ceil(t n) + 1 of either, and two tokens among one more.
Small sets enumerate the pairs (subsets of two) of that prefix; large sets are found by scanning the inverted
lists of single tokens. The boundary between small and large is where the counted cost of both is least.

Lists are not expanded into pairs: each member is first compared with the smallest of its list, and of the
lists in which more than one component is left only pairs of different components are compared, short lists
as rows, long ones in tiles of bounded size. For components a pair within one may be left out; no pair across two
is. The number of links, if asked for, comes from all pairs within the components (`ngram_links`).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, blocks_of, components, pack_sorted, release, rolling, slices, total_chars, unpack_sorted, word_hashes
from vellum.llm.ngram_links import link_counts

#: Characters of text in a block, and in a token range.
BLOCK_CHARS, RANGE_CHARS = 4_000_000, 16_000_000
#: Members of a list up to which its open pairs are made as rows; members of a tile beyond it.
SHORT_LIST, TILE = 48, 1024
#: What comparing a member with the first of its list costs, in rows.
COMPARED = 4

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Of each text the distinct hashes, ascending, of the word n-grams; of the whole sequence if it is shorter; none without words."""
    words, n = word_hashes([t.translate(_LOWER) for t in texts])
    all_, end = rolling(words, size), np.cumsum(n)
    return [np.unique(all_[e - k : e - size + 1]) if k >= size else rolling(words[e - k : e], k) if k else np.empty(0, np.uint64) for k, e in zip(n.tolist(), end.tolist(), strict=True)]


def _bytes(texts) -> list[bytes]:
    """A column of texts as UTF-8; null is empty."""
    return texts.cast(pa.binary()).fill_null(b"").to_pylist()


def set_sizes(docs: DataFrame, size: int = 5) -> DataFrame:
    """Rows (id, n, f1, f2): the size of each document's shingle set and a 128-bit fingerprint of the set."""

    def run(batches):
        for b in batches:
            n, fp = [], []
            for begin, end in slices(b["text"]):
                for s in shingle_sets(_bytes(b["text"].slice(begin, end - begin)), size):
                    n.append(len(s))
                    fp.append(xxhash.xxh3_128_digest(s.tobytes()))
            f = np.frombuffer(b"".join(fp), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(n, pa.int64()), pa.array(f[:, 0]), pa.array(f[:, 1])], names=["id", "n", "f1", "f2"])
        release()

    return docs.mapInArrow(run, "id long, n long, f1 long, f2 long")


# --------------------------------------------------------------------------- token frequencies


class _Block:
    """The shingle sets of a block's class representatives, and the block's distinct tokens by range."""

    def __init__(self, t: pa.Table, reps: set[int], size: int, ranges: int) -> None:
        t = t.filter(pa.compute.is_in(t["id"], pa.array(sorted(reps), pa.int64())))
        self.ids, self.sets = t["id"].to_pylist(), shingle_sets(_bytes(t["text"]), size)
        h = np.concatenate(self.sets or [np.empty(0, np.uint64)])
        r = ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        key = (r << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        self.keys, self.inverse, self.counts = np.unique(key, return_inverse=True, return_counts=True)
        self.cuts = np.searchsorted(self.keys >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))


_SENT = pa.schema([("range", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _frequencies(t: pa.Table) -> pa.Table:
    """Of one token range: for each block, in how many sets each of its tokens is, where that is over one."""
    keys = [unpack_sorted(x) for x in t["keys"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in t["counts"].to_pylist()])
    k = np.concatenate(keys)
    order = np.argsort(k)
    s = k[order]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    total = np.empty(len(k), np.uint32)
    total[order] = np.repeat(np.add.reduceat(counts[order].astype(np.int64), starts).clip(max=2**32 - 1), np.diff(np.append(starts, len(s))))
    many, ends = [], np.cumsum([len(x) for x in keys])
    for x, e in zip(keys, ends, strict=True):
        c = total[e - len(x) : e]
        many.append(np.packbits(c > 1).tobytes() + c[c > 1].tobytes())
    release()
    return pa.table([t["block"], t["range"], pa.array(many, pa.binary())], names=["block", "range", "many"])


def candidates(docs: DataFrame, reps: DataFrame, size: int, num: int, den: int, chars: int) -> DataFrame:
    """Rows (id, n, tokens, df, shingles) of the sets that can have a partner: prefix tokens with their frequencies.

    A set is left out if its whole prefix consists of tokens that no other set has.
    """
    blocks, ranges = blocks_of(chars, BLOCK_CHARS), blocks_of(chars, RANGE_CHARS)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int").alias("block")
    dealt = docs.where("id is not null").select(block(F.col("id")), "id", "text")
    own = reps.select(block(F.col("id")), "id", F.lit(None).cast("int").alias("range"), F.lit(None).cast("binary").alias("many"))

    def counted(t: pa.Table, mine: pa.Table) -> pa.Table:
        rows = []
        if len(t):
            b = _Block(t, set(mine["id"].to_pylist()), size, ranges)
            for r in np.flatnonzero(np.diff(b.cuts)).tolist():
                s, e = b.cuts[r], b.cuts[r + 1]
                rows.append((r, t["block"][0].as_py(), pack_sorted(b.keys[s:e] & np.uint64(0xFFFFFFFF)), b.counts[s:e].astype(np.uint32).tobytes()))
        release()
        return pa.Table.from_arrays([pa.array(list(c), f) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, _SENT.types, strict=True)], schema=_SENT)

    def prefixes(t: pa.Table, answers: pa.Table) -> pa.Table:
        mine = [i for i, r in zip(answers["id"].to_pylist(), answers["range"].to_pylist(), strict=True) if r is None]
        b = _Block(t, set(mine), size, ranges)
        df = np.ones(len(b.keys), np.uint32)
        for r, many in zip(answers["range"].to_pylist(), answers["many"].to_pylist(), strict=True):
            if r is not None:
                s, e = b.cuts[r], b.cuts[r + 1]
                w = (e - s + 7) // 8
                bits = np.unpackbits(np.frombuffer(many[:w], np.uint8), count=e - s).astype(bool)
                df[s:e][bits] = np.frombuffer(many[w:], np.uint32)
        df, at, rows = df[b.inverse], 0, []
        for i, x in zip(b.ids, b.sets, strict=True):
            d = df[at : at + len(x)]
            at += len(x)
            p = len(x) - -(-num * len(x) // den) + 1
            if len(x) and np.count_nonzero(d == 1) < p:
                order = np.lexsort((x, d))[: p + 1]
                order = order[d[order] > 1]
                rows.append((i, len(x), x[order].view(np.int64), d[order].astype(np.int64), x.tobytes(), p - np.count_nonzero(d == 1)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int32()]
        release()
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["id", "n", "tokens", "df", "shingles", "single"])

    sent = dealt.groupBy("block").cogroup(own.select("block", "id").groupBy("block")).applyInArrow(counted, "range int, block int, keys binary, counts binary")
    many = sent.groupBy("range").applyInArrow(_frequencies, "block int, range int, many binary")
    answers = many.select("block", F.lit(None).cast("long").alias("id"), "range", "many").unionByName(own.select("block", "id", "range", "many"))
    # single: how many of the tokens belong to the prefix for one shared token; the one more is for pairs
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(prefixes, "id long, n long, tokens array<long>, df array<long>, shingles binary, single int")


# --------------------------------------------------------------------------- candidate lists


def boundary(cands: DataFrame) -> int:
    """Set size up to which pairs of prefix tokens are enumerated: counted over all candidates, by powers of two.

    A small set costs the rows of its pairs; a large one the rows of its tokens, each of which is compared with the
    first of its list, so that lists cost in proportion to their length whatever it is.
    """
    t = F.col("single").cast("long")
    rows = cands.groupBy(F.floor(F.log2(F.col("n") + F.lit(0.5))).cast("int").alias("k")).agg(F.sum((t + 1) * t / 2).alias("pairs"), F.sum(t * F.lit(1 + COMPARED)).alias("lists")).collect()  # one row for each power of two
    by = {r["k"]: (float(r["pairs"]), float(r["lists"])) for r in rows}
    best, cost = 0, math.inf
    for cut in range(0, max(by, default=0) + 2):
        c = sum(p if k < cut else s for k, (p, s) in by.items())
        if c < cost:
            best, cost = cut, c
    return 2**best - 1


def lists(cands: DataFrame, small: int, num: int, den: int) -> DataFrame:
    """Rows (key, id, n): members of the lists. Pairs of tokens for small sets; single tokens for large sets and those near enough in size."""
    pairs = cands.where(F.col("n") <= small).select(
        F.explode(F.flatten(F.transform("tokens", lambda x, i: F.transform(F.slice("tokens", i + 2, F.size("tokens")), lambda y: F.xxhash64(x, y))))).alias("key"), "id", "n"
    )
    near = cands.where(F.col("n") * F.lit(den) > F.lit(num * small))
    single = near.where("single > 0").select(F.explode(F.slice("tokens", F.lit(1), F.col("single"))).alias("key"), "id", "n")
    return pairs.unionByName(single)


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of distinct pairs (a, b), those whose sets have den * |both| >= num * |either|."""

    def run(batches):
        for t in batches:
            a, b = t["sa"], t["sb"]
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num, den) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([t["a"], t["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * shared >= num * (len(both) - shared)


def _tile_edges(num: int, den: int):
    """In one tile of a long list: edges between its outer sets (side 1) and its inner ones (side 0) of other labels."""

    def run(t: pa.Table) -> pa.Table:
        ids, label, side = t["id"].to_numpy(), t["label"].to_numpy(), t["side"].to_numpy()
        outer, inner = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        edges: list[tuple[int, int]] = []
        if len(outer) and len(inner):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["shingles"]]
            n = np.array([len(x) for x in sets])
            token, inverse = np.unique(np.concatenate([sets[i] for i in inner]), return_inverse=True)
            owner = np.repeat(np.arange(len(inner)), n[inner])
            order = np.argsort(inverse, kind="stable")
            starts = np.searchsorted(inverse[order], np.arange(len(token) + 1))
            owner = owner[order]
            root: dict[int, int] = {}

            def top(x):
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            for i in outer.tolist():
                at = np.minimum(np.searchsorted(token, sets[i]), len(token) - 1)
                at = at[token[at] == sets[i]]
                if not len(at):
                    continue
                shared = np.bincount(np.concatenate([owner[starts[k] : starts[k + 1]] for k in at.tolist()]), minlength=len(inner))
                fits = (den * shared >= num * (n[i] + n[inner] - shared)) & (label[inner] != label[i])
                for j in inner[fits].tolist():
                    x, y = top(label[i]), top(label[j])
                    if x != y:
                        root[x] = y
                        edges.append((int(ids[i]), int(ids[j])))
        release()
        a, b = zip(*edges, strict=True) if edges else ([], [])
        return pa.table([pa.array(list(a), pa.int64()), pa.array(list(b), pa.int64())], names=["a", "b"])

    return run


def tiled(known: DataFrame, sets: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """Edges (a, b) between sets of different labels in long lists; `known` has (key, id, n, label).

    Sets are banded by size, and only the same and the next band can hold a partner. Of a list and band, the members
    outside the list's most frequent label are outer and dealt to tiles; all members of near bands are inner. So a
    list in which one component is nearly all costs its length times the few others' tiles, not its square.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + F.lit(1e-9)).cast("int") if num < den else F.lit(0)
    known = scratch.keep(known.withColumn("band", band))
    most = known.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("most"))
    outer = known.join(most, "key").where("label <> most").select("key", "band", "id", "n", "label")
    parts = outer.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("outers"))
    near = known.select("key", "id", "n", "label", F.explode(F.array(*[F.col("band") + F.lit(k) for k in (-1, 0, 1)])).alias("band"))
    sizes = near.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("inners"))
    parts = scratch.keep(parts.join(sizes, ["key", "band"]))
    dealt = lambda c: F.pmod(F.xxhash64("id"), c).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    out_rows = outer.join(parts, ["key", "band"]).select("key", "band", dealt(F.col("outers")).alias("i"), upto("inners").alias("j"), F.lit(1).alias("side"), "id", "label")
    in_rows = near.join(parts, ["key", "band"]).select("key", "band", upto("outers").alias("i"), dealt(F.col("inners")).alias("j"), F.lit(0).alias("side"), "id", "label")
    rows = out_rows.unionByName(in_rows).join(sets, "id").select("key", "band", "i", "j", "side", "id", "label", "shingles")
    return rows.groupBy("key", "band", "i", "j").applyInArrow(_tile_edges(num, den), "a long, b long").distinct()


def linked(cands: DataFrame, scratch: Scratch, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows (node, component) of the sets that are linked with another, and the members (key, id, n) of the lists."""
    sets = cands.select("id", "shingles")
    members = scratch.keep(lists(cands, boundary(cands), num, den))
    fits = F.least("n", "m") * F.lit(den) >= F.greatest("n", "m") * F.lit(num)
    first = members.groupBy("key").agg(F.min(F.struct("id", "n")).alias("f"), F.count(F.lit(1)).alias("long")).where("long > 1").select("key", "long", F.col("f.id").alias("a"), F.col("f.n").alias("m"))
    first = scratch.keep(first)
    star = members.join(first, "key").where("id <> a").where(fits).select("a", F.col("id").alias("b")).distinct()
    edges = scratch.keep(verified(star, sets, num, den))
    label = scratch.keep(components(edges, scratch).select(F.col("node").alias("id"), F.col("component").alias("label")))
    # of lists of three or more, those in which more than one component is left
    known = members.join(first.where("long > 2").select("key"), "key").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    known = scratch.keep(known.select("key", "id", "n", "label"))
    mixed = known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("long")).where("lo <> hi").select("key", "long")
    mixed = scratch.keep(mixed)
    left = known.join(mixed.where(F.col("long") <= SHORT_LIST), "key")
    right = left.select("key", F.col("id").alias("b"), F.col("n").alias("m"), F.col("label").alias("l2"))
    short = left.join(right, "key").where("id < b and label <> l2").where(fits).select(F.col("id").alias("a"), "b").distinct().join(star, ["a", "b"], "left_anti")
    more = scratch.keep(verified(short, sets, num, den))
    long = known.join(mixed.where(F.col("long") > SHORT_LIST).select("key"), "key")
    tiles = scratch.keep(tiled(long, sets, scratch, num, den))
    return components(edges.unionByName(more).unionByName(tiles), scratch), members


def _joined(docs: DataFrame, scratch: Scratch, size: int, num: int, den: int, id_col: str, text_col: str, with_links: bool) -> DataFrame:
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    chars = total_chars(docs)
    sized = scratch.keep(set_sizes(docs, size))
    full = sized.where("n > 0 and id is not null")
    names = None
    if full.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").limit(1).count():
        # rows are told apart by a number; the names come back at the end
        docs = scratch.keep(docs.select(F.col("id").alias("doc"), F.when(F.col("id").isNotNull(), F.monotonically_increasing_id()).alias("id"), "text"))
        names, docs = docs.select("id", "doc"), docs.select("id", "text")
        sized = scratch.keep(set_sizes(docs, size))
        full = sized.where("n > 0 and id is not null")
    classes = scratch.keep(full.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    cands = scratch.keep(candidates(docs, classes.select(F.col("rep").alias("id")), size, num, den, chars))
    found, members = linked(cands, scratch, num, den)
    found = scratch.keep(found)
    top = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    if with_links:
        copies = classes.select(F.col("rep").alias("id"), "copies")
        links = link_counts(found, members, cands, copies, scratch, num, den)
        top = top.join(links.withColumnRenamed("id", "rep"), "rep", "left")
    else:
        top = top.withColumn("links", F.lit(None).cast("long"))
    top = top.select("f1", "f2", F.coalesce("component", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    none = sized.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component"), F.lit(0).cast("long").alias("links"))
    out = full.join(top, ["f1", "f2"]).select("id", "n", "component", "links").unionByName(none)
    if names is not None:
        out = scratch.keep(out.join(names, "id", "left"))
        least = out.groupBy("component").agg(F.min("doc").alias("least"))
        out = out.join(least, "component", "left").select(F.col("doc").alias("id"), "n", F.col("least").alias("component"), "links")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").alias("n_links"))


def ngram_components(docs: DataFrame, scratch: Scratch, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups of all documents: rows (id_col, n_shingles, component_id).

    Words are lower-cased (A-Z) runs without ASCII white space; a set holds the distinct shingles of `size` words, or the
    whole sequence if it is shorter. Two sets link if den * |intersection| >= num * |union|. Null and blank texts have an
    empty set and link with nothing; so does a row without an id, whose component is null. Repeated rows are
    copies; rows that share an id but not the text are each judged by their own text. Shingles are compared by 64-bit
    hashes. Other columns are not read and don't come back, whatever their names; an empty table gives an empty result. A
    document is one row of a task, however long.
    """
    return _joined(docs, scratch, size, num, den, id_col, text_col, False).drop("n_links")


def ngram_join(docs: DataFrame, scratch: Scratch, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The join whole: what `ngram_components` gives, and n_links, the number of other rows that a row is linked with.

    Rows of equal sets are linked with each other, repeated rows and rows that share an id among them; a row with an
    empty set or without an id has 0 links. Other columns don't come back.
    """
    return _joined(docs, scratch, size, num, den, id_col, text_col, True)
