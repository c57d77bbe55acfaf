"""Substring dedup: Rabin-Karp hashes of every token window, counted in Spark, merged into removal intervals.

Documents are dealt to blocks by a hash of their id. Each block hashes all its windows and sends, for each
hash range, its distinct hashes and the smallest document of each. A hash range compares what all blocks sent
and answers with one bit for each hash: does a smaller document of another block have it? The block then
marks the covered words. Block and range counts grow with the corpus, a block sends a repeated window once,
and so neither frequent passages nor large groups of copies gather anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import SECOND_BASE, blocks_of, pack_sorted, release, rolling, total_chars, unpack_sorted, word_hashes

#: Characters of text in a block, and in a hash range: what a task holds. A block sends a row to each range that it
#: has a hash of, so beyond some terabytes both should grow with the executors' memory, lest rows hold few hashes each.
BLOCK_CHARS, RANGE_CHARS = 4_000_000, 8_000_000

class _Block:
    """The windows of a block's documents, sorted by hash: 64 bits, and 24 of a second hash beside them."""

    def __init__(self, ids: pa.ChunkedArray, texts: list[bytes], size: int, ranges: int) -> None:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy().astype(np.int64)
        rank = np.argsort(self.ids, kind="stable")  # so that the first of equal windows is of the smallest document
        words, n = word_hashes([texts[i] for i in rank.tolist()])
        self.n = np.empty(len(texts), np.int64)
        self.n[rank] = n
        first, second = rolling(words, size), (rolling(words, size, SECOND_BASE) >> _SHIFT).astype(np.uint32)
        windows = np.where(known[rank], np.maximum(n - size + 1, 0), 0)  # none crosses into the next document
        self.owner = np.repeat(rank, windows)
        self.at = np.arange(len(self.owner)) - np.repeat(np.cumsum(windows) - windows, windows)  # first word in its document
        where = self.at + np.repeat(np.cumsum(n) - n, windows)
        first, second = first[where], second[where]
        self.order = _sorted(first, second)
        h, g = first[self.order], second[self.order]
        self.first = np.ones(len(h), bool)
        self.first[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        self.distinct, self.second = h[self.first], g[self.first]
        self.least = self.owner[self.order[self.first]]
        cuts = ((self.distinct >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        self.cuts = np.searchsorted(cuts, np.arange(ranges + 1, dtype=np.uint64))

    def sent(self, block: int) -> pa.Table:
        rows = []
        for r in np.flatnonzero(np.diff(self.cuts)).tolist():
            s, e = self.cuts[r], self.cuts[r + 1]
            ids, at = np.unique(self.ids[self.least[s:e]], return_inverse=True)
            at = at.astype(np.uint16 if len(ids) < 65536 else np.uint32)
            low = int(ids[0])
            more = self.second[s:e].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
            rows.append((r, block, low, pack_sorted(self.distinct[s:e]), more, pack_sorted((ids - low).astype(np.uint64)), at.tobytes()))
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, _SENT.types, strict=True)], schema=_SENT)


_SHIFT = np.uint64(40)
_SENT = pa.schema([("range", pa.int32()), ("block", pa.int32()), ("low", pa.int64()), ("hashes", pa.binary()), ("second", pa.binary()), ("ids", pa.binary()), ("at", pa.binary())])
_SENT_SQL = "range int, block int, low long, hashes binary, second binary, ids binary, at binary"
_BITS = pa.schema([("block", pa.int32()), ("range", pa.int32()), ("bits", pa.binary())])


def _sorted(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """A stable order by both hashes; the second is looked at only where the first alone does not part what it parts."""
    order = np.argsort(h, kind="stable")
    s, t = h[order], g[order]
    return np.lexsort((g, h)) if ((s[1:] == s[:-1]) & (t[1:] != t[:-1])).any() else order


def _compare(t: pa.Table) -> pa.Table:
    """Of one hash range: for each block, a bit for each hash that a smaller document of another block has."""
    blocks = t["block"].to_pylist()
    hashes = [unpack_sorted(x) for x in t["hashes"].to_pylist()]
    second, least = [], []
    for low, more, ids, at in zip(t["low"].to_pylist(), t["second"].to_pylist(), t["ids"].to_pylist(), t["at"].to_pylist(), strict=True):
        wide = np.zeros((len(more) // 3, 4), np.uint8)
        wide[:, :3] = np.frombuffer(more, np.uint8).reshape(-1, 3)
        second.append(wide.reshape(-1).view("<u4"))
        ids = unpack_sorted(ids).astype(np.int64) + low
        least.append(ids[np.frombuffer(at, np.uint16 if len(ids) < 65536 else np.uint32)])
    h, g, own = np.concatenate(hashes), np.concatenate(second), np.concatenate(least)
    order = _sorted(h, g)
    s, x = h[order], g[order]
    starts = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (x[1:] != x[:-1])]))
    low = np.minimum.reduceat(own[order], starts)
    bit = np.empty(len(h), bool)
    bit[order] = np.repeat(low, np.diff(np.append(starts, len(s)))) < own[order]
    ends = np.cumsum([len(x) for x in hashes])
    bits = [np.packbits(bit[e - len(x) : e]).tobytes() for x, e in zip(hashes, ends, strict=True)]
    out = pa.table([pa.array(blocks, pa.int32()), t["range"].combine_chunks().cast(pa.int32()), pa.array(bits, pa.binary())], schema=_BITS)
    release()
    return out


def _removed(block: _Block, answers: pa.Table, size: int) -> dict[int, np.ndarray]:
    """For each document of which words go, which of its words a repeated window covers."""
    flag = np.zeros(len(block.distinct), bool)
    for r, bits in zip(answers["range"].to_pylist(), answers["bits"].to_pylist(), strict=True):
        s, e = block.cuts[r], block.cuts[r + 1]
        flag[s:e] = np.unpackbits(np.frombuffer(bits, np.uint8), count=e - s)
    entry = np.cumsum(block.first) - 1
    hit = np.zeros(len(entry), bool)
    if len(entry):
        hit[block.order] = flag[entry] | (block.ids[block.owner[block.order]] > block.ids[block.least[entry]])
    hit = np.flatnonzero(hit)
    hit = hit[np.argsort(block.owner[hit], kind="stable")]
    owner, cut = np.unique(block.owner[hit], return_index=True)
    out = {}
    for i, s, e in zip(owner.tolist(), cut.tolist(), np.append(cut, len(hit))[1:].tolist(), strict=True):
        step = np.zeros(int(block.n[i]) + 1, np.int32)
        np.add.at(step, block.at[hit[s:e]], 1)
        np.add.at(step, block.at[hit[s:e]] + size, -1)
        out[i] = np.cumsum(step[:-1]) > 0
    return out


def _bytes(texts: pa.ChunkedArray) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return texts.cast(pa.binary()).fill_null(b"").to_pylist()


def spans(mask: np.ndarray) -> np.ndarray:
    """Starts and ends, by turns, of the runs that are set."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))


def substring_dedup(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", keep_unchanged: bool = False, block_chars: int = BLOCK_CHARS, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Removes each word that a window of `size` words covers whose words also start in a document of smaller id.

    Words are runs without ASCII white space. Returns (id_col, n_words, n_removed, removed, kept, rest): `removed`
    holds the maximal removed intervals as starts and ends of words by turns, `kept` the other words joined by a
    space, `rest` the other columns of the input as a struct, so that no name of theirs can clash. With `keep_unchanged`
    a text of which nothing is removed comes back as it is, white space included.

    Null and empty texts have no words and come back as empty. Documents shorter than a window keep all words. A
    row without an id is no smaller nor larger than any: it keeps all and removes nothing. Rows with one id do not
    remove each other's windows. Windows are compared by 88 bits of two Rabin-Karp hashes over 64-bit hashes of the
    words: with n distinct windows some n^2 / 2^89 false matches are to be expected, less than one at 100 TB. A task holds
    a block, one document at least: some twelve bytes to each byte of text.
    """
    chars = total_chars(docs, text_col)
    blocks, ranges = blocks_of(chars, block_chars), blocks_of(chars, range_chars)
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    dealt = docs.select(
        # the text takes part, so that rows without an id, or with one and the same, are spread as well
        F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.lit(blocks)).cast("int").alias("block"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
        F.struct(*([F.col(f"`{c}`") for c in rest] or [F.lit(True).alias("none")])).alias("rest"),
    )

    def hashed(t: pa.Table) -> pa.Table:
        out = _Block(t["id"], _bytes(t["text"]), size, ranges).sent(t["block"][0].as_py())
        release()
        return out

    def applied(t: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _bytes(t["text"])
        block = _Block(t["id"], texts, size, ranges)
        gone, kept = _removed(block, answers, size), []
        for i, x in enumerate(texts):
            if i in gone:
                words = x.split()
                kept.append(b" ".join([words[k] for k in np.flatnonzero(~gone[i]).tolist()]))
            else:
                kept.append(x if keep_unchanged else b" ".join(x.split()))
        none = np.zeros(0, bool)
        others = t["rest"].cast(pa.struct([pa.field(f.name, f.type) for f in t["rest"].type]))  # all nullable
        n_removed = [int(gone[i].sum()) if i in gone else 0 for i in range(len(texts))]
        runs = pa.array([spans(gone.get(i, none)) for i in range(len(texts))], pa.list_(pa.int64()))
        cols = [t["id"], pa.array(block.n), pa.array(n_removed, pa.int64()), runs, pa.array(kept, pa.binary()).cast(pa.string()), others]
        release()
        return pa.table(cols, names=[id_col, "n_words", "n_removed", "removed", "kept", "rest"])

    answers = dealt.groupBy("block").applyInArrow(hashed, _SENT_SQL).groupBy("range").applyInArrow(_compare, "block int, range int, bits binary")
    kind = dealt.schema["rest"].dataType.simpleString()
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(applied, f"`{id_col}` long, n_words long, n_removed long, removed array<long>, kept string, rest {kind}")
