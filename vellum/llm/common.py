"""What the operators share: scratch tables, components, word hashing, cached tokenizers."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: its allocator keeps what it keeps
    _libc = None


# --------------------------------------------------------------------------- scratch tables


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is set and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "root" not in _own:
        _own["root"] = tempfile.mkdtemp(prefix="spark-")
    return _own["root"]


class Scratch:
    """Tables written to the shared folder to cut lineage; `keep` rereads, `drop` frees what no later step reads."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.n = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            path = getattr(df, "_scratch_path", None)
            if path:
                remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# --------------------------------------------------------------------------- connected components


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable node of every node that has an edge: rows (node, component).

    Alternates the large-star and small-star steps of distributed connected components; each step is one
    grouped minimum and one join, so no component and no neighbourhood is ever gathered in one task. An
    empty edge table gives an empty result.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = scratch.keep(pairs)
    while True:
        # large star: of all neighbours, the larger ones move to the smallest of the closed neighbourhood
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        new = scratch.keep(small)
        same = _signature(new) == _signature(pairs)
        scratch.drop(pairs)
        pairs = new
        if same:
            break
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)


def _signature(pairs: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(h)).first())


# --------------------------------------------------------------------------- words and rolling hashes

#: Odd multiplier of the polynomial hash (fixed value, any odd number of good spread does).
BASE = np.uint64(0x9E3779B97F4A7C15)


#: Another odd multiplier, for the bits that a second hash adds.
SECOND_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes that part words, and the bytes that are hashed at a time; longer words are hashed by the library.
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_GROUP, _LONG_WORD = 1 << 18, 64
_SPACE_AFTER = re.compile(rb"[\t-\r ]")


class _Powers:
    """Powers of the multiplier and of its inverse, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.back = np.empty(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            made = []
            for base in (int(BASE), pow(int(BASE), -1, 1 << 64)):
                x = np.full(n, np.uint64(base))
                x[0] = 1
                made.append(np.multiply.accumulate(x))
            if n > 2 * _GROUP:
                return tuple(made)  # a word of such a length is rare: not kept
            self.up, self.back = made
        return self.up, self.back


_powers = _Powers()
_byte_values: list[np.ndarray] = []


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of all words: differences of one running sum of byte values times powers."""
    x = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(x) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[x]
    edge = np.diff(inside)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not _byte_values:
        _byte_values.append(mix(np.arange(1, 257, dtype=np.uint64) * BASE))
    up, back = _powers.of(max(len(x), _GROUP))
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_byte_values[0][x] * up[: len(x)], out=sums[1:])
    h = mix((sums[end] - sums[begin]) * back[begin])
    for k in np.flatnonzero(end - begin > _LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[begin[k] : end[k]])
    return h, begin


def _in_groups(texts: list[bytes]):
    """Yields (texts joined by a space, their numbers, their first bytes in it); a long text comes in several parts, cut between words."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if len(t) > _GROUP:
            at = 0
            while at < len(t):
                end = len(t)
                if end - at > _GROUP:
                    gaps = np.flatnonzero(_IS_SPACE[np.frombuffer(t, np.uint8, _GROUP, at)])
                    after = None if len(gaps) else _SPACE_AFTER.search(t, at + _GROUP)
                    end = at + int(gaps[-1]) + 1 if len(gaps) else after.start() if after else len(t)
                yield t[at:end], [i], [0]
                at = end
            continue
        if size + len(t) > _GROUP:
            yield b" ".join([texts[k] for k in group]), group, np.cumsum([0] + [len(texts[k]) + 1 for k in group[:-1]])
            group, size = [], 0
        group.append(i)
        size += len(t) + 1
    if group:
        yield b" ".join([texts[k] for k in group]), group, np.cumsum([0] + [len(texts[k]) + 1 for k in group[:-1]])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, text after text, and the number of words of each text.

    Words are runs of bytes other than ASCII white space. Nothing is kept per word but its hash.
    """
    of: dict[int, list[np.ndarray]] = {}
    n = np.zeros(len(texts), np.int64)
    parts: list[tuple[list[int], np.ndarray]] = []
    for data, numbers, first in _in_groups(texts):
        h, begin = _hash_words(data)
        cut = np.append(np.searchsorted(begin, first), len(h))
        n[numbers] += np.diff(cut)
        if len(numbers) == 1:
            of.setdefault(numbers[0], []).append(h)
        parts.append((numbers, h))
    if of:  # parts of long texts lie between groups of short ones: bring them into the order of the texts
        at = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(int(at[-1]), np.uint64)
        for numbers, h in parts:
            if len(numbers) > 1:
                k = 0
                for i in numbers:
                    out[at[i] : at[i + 1]] = h[k : k + n[i]]
                    k += n[i]
        for i, hs in of.items():
            out[at[i] : at[i + 1]] = np.concatenate(hs)
        return out, n
    return np.concatenate([h for _, h in parts] or [np.empty(0, np.uint64)]), n


def release() -> None:
    """Gives memory that a group of rows needed back to the system: the worker lives on with other stages' tasks."""
    pa.default_memory_pool().release_unused()
    if _libc:
        _libc.malloc_trim(0)


def rolling(h: np.ndarray, size: int, base: np.uint64 = BASE) -> np.ndarray:
    """Rabin-Karp hash of every window of `size` items, mixed so that all its bits are even."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, size):
        out *= base
        out += h[j : j + n]
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending unsigned integers as byte planes of their differences; planes of zeros are left out."""
    if not len(x):
        return b"\0"
    d = np.diff(x, prepend=x.dtype.type(0)).astype("<u8")
    first, d[0] = d[0], 0
    width = max(1, (int(d.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + int(first).to_bytes(8, "little") + planes.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    width = data[0]
    if not width:
        return np.empty(0, np.uint64)
    planes = np.frombuffer(data, np.uint8, offset=9).reshape(width, -1)
    d = np.zeros((planes.shape[1], 8), np.uint8)
    d[:, :width] = planes.T
    x = d.reshape(-1).view("<u8")
    x[0] = int.from_bytes(data[1:9], "little")
    return np.cumsum(x, dtype=np.uint64)


def blocks_of(chars: int, each: int) -> int:
    """How many parts of about `each` characters the corpus has: grows with the input, at least one."""
    return max(1, -(-int(chars or 0) // each))


def total_chars(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0


# --------------------------------------------------------------------------- tokenizers

#: Unicode White_Space, Latin letters, and the ASCII characters that are no letters (fixed values).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATIN, NO_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", "\0-@\\[-`{-\x7f"
#: A run of letters with the space before it, where an ASCII character that is no letter follows; else all up to white space.
_WITH_SPACE = re.compile(f" ?[{LATIN}]+(?=[{NO_LETTER}]|\\Z)|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: The same for tokenizers that drop white space.
_NO_SPACE = re.compile(f"[{LATIN}]+(?=[{NO_LETTER}]|\\Z)|[^{SPACE}]+")


#: Byte-level alphabet: bytes that print stand for themselves, the others for characters from 256 on.
_BYTE_ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}
_BYTE_SPACE = chr(_BYTE_ALPHABET[32])


#: Bytes of UTF-8: ASCII letters, and the bytes that white space beyond ASCII begins with.
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_LEAD = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
#: Bytes of a chunk that its key holds, and what of them counts at each length.
_KEY = 16
_KEEP = np.array([[(1 << 8 * min(max(n - k, 0), 8)) - 1 for k in (0, 8)] for n in range(_KEY + 1)], np.uint64)


class Encoder:
    """Token ids by the tokenizers library, remembering the ids of chunks already seen.

    Both public tokenizers split texts before their merges so that no token crosses from a non-space into a
    following space, nor from a run of letters into what is no letter; the text is cut there, every new chunk is
    encoded once by the library, and the ids of a text are put together from its chunks. Cutting, looking up and putting
    together are done in numpy for many texts at once; chunks of up to 16 bytes are found by these bytes in an
    open-addressed table, longer ones in a dictionary. The memory is bounded by `most` chunks.
    """

    def __init__(self, path: str, most: int = 600_000) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.most = most
        one, two = (self.lib.encode(x, add_special_tokens=False).ids for x in ("b", " b"))
        self.spaced = one != two
        self.chunks = (_WITH_SPACE if self.spaced else _NO_SPACE).findall
        self.lower = self.lib.normalizer is not None and self.lib.normalizer.normalize_str("A") == "a"
        self.word = re.compile(f" ?[{LATIN}]+").fullmatch
        self._reset()

    def _reset(self) -> None:
        size = 1 << (2 * self.most).bit_length()
        self.low, self.high = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.long, self.number = np.zeros(size, np.uint8), np.zeros(size, np.int32)
        self.others: dict[bytes, int] = {}
        self.flat, self.at = np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int32)
        self.known = 0

    def _learn(self, new: list[bytes]) -> None:
        """Encodes new chunks, which get the next numbers."""
        model, word = self.lib.model.tokenize, self.word
        gc.disable()  # only ids are made there, no cycles
        for s in range(0, len(new), 8192):
            texts = [c.decode() for c in new[s : s + 8192]]
            ids = [None] * len(texts)
            rest = []
            for i, c in enumerate(texts):
                if c.isascii() and (c.isalpha() or c[1:].isalpha() and c[0] == " ") or word(c):  # one word to both tokenizers
                    if self.lower:
                        c = c.lower()
                    # the library's model takes it in its byte alphabet, in which only the space of an ASCII word differs
                    c = c.replace(" ", _BYTE_SPACE) if c.isascii() else c.encode().decode("latin-1").translate(_BYTE_ALPHABET)
                    ids[i] = [t.id for t in model(c)]
                else:
                    rest.append(i)
            for i, e in zip(rest, self.lib.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
                ids[i] = e.ids
            long = np.fromiter(map(len, ids), np.int32, len(ids))
            ends = self.at[self.known] + np.cumsum(long, dtype=np.int32)
            if self.known + len(ids) >= len(self.at):
                self.at = np.concatenate([self.at, np.zeros(len(self.at) + len(ids), np.int32)])
            if ends[-1] > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), int(ends[-1])), np.int32)])
            self.flat[self.at[self.known] : ends[-1]] = np.fromiter(chain.from_iterable(ids), np.int32, int(long.sum()))
            self.at[self.known + 1 : self.known + 1 + len(ids)] = ends
            self.known += len(ids)
        gc.enable()

    def _cut(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last bytes of the chunks of texts that zeros part: as `chunks` gives them where white space is ASCII."""
        space, gap, letter = _IS_SPACE[x], x == 0, _LETTER[x]
        two = np.flatnonzero(x == 0xC3)  # Latin letters beyond ASCII
        two = two[(x[two + 1] != 0x97) & (x[two + 1] != 0xB7)]
        letter[two] = letter[two + 1] = True
        solid = ~(space | gap)
        first = np.zeros(len(x), bool)
        if self.spaced:  # white space goes with what follows
            first[1:] = (space[1:] & ~space[:-1]) | (solid[1:] & gap[:-1])
            marks = np.flatnonzero(first | gap)
            here = first[marks[:-1]]
            begin, end = marks[:-1][here], marks[1:][here]
            word = begin + ((x[begin] == 32) & letter[begin + 1])
        else:
            edge = np.diff(solid.view(np.int8))
            begin, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
            word = begin
        run_ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        stop = end.copy()
        lettered = np.flatnonzero(letter[word])
        if len(lettered):
            e = run_ends[np.searchsorted(run_ends, word[lettered], "right")]
            stop[lettered] = np.where(x[e] < 128, e, end[lettered])
        rest = stop < end
        begins, ends = np.concatenate([begin, stop[rest]]), np.concatenate([stop, end[rest]])
        order = np.argsort(begins, kind="stable")
        return begins[order], ends[order]

    def _place(self, low: np.ndarray, high: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(low * BASE ^ (high + long.astype(np.uint64)) * SECOND_BASE)
        return h, (h & np.uint64(len(self.low) - 1)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray, long: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Numbers of keys, -1 for those that are new."""
        out = np.full(len(low), -1, np.int32)
        todo, at = np.arange(len(low)), place
        while len(todo):
            here = self.long[at]
            same = (here == long[todo]) & (self.low[at] == low[todo]) & (self.high[at] == high[todo])
            out[todo[same]] = self.number[at[same]]
            on = ~same & (here != 0)
            todo, at = todo[on], at[on] + 1 & len(self.low) - 1
        return out

    def _store(self, low: np.ndarray, high: np.ndarray, long: np.ndarray, number: np.ndarray) -> None:
        held = np.flatnonzero(self.long)
        if 2 * (len(held) + len(low)) > len(self.low):  # one long text may bring more than the table was made for
            low, high, long, number = (np.concatenate([x[held], y]) for x, y in ((self.low, low), (self.high, high), (self.long, long), (self.number, number)))
            size = 1 << (2 * len(low)).bit_length()
            self.low, self.high, self.long, self.number = (np.zeros(size, x.dtype) for x in (self.low, self.high, self.long, self.number))
        todo, at = np.arange(len(low)), self._place(low, high, long)[1]
        while len(todo):
            free = np.flatnonzero(self.long[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            k, p = todo[won], at[won]
            self.low[p], self.high[p], self.long[p], self.number[p] = low[k], high[k], long[k], number[k]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, at = todo[left], at[left]
            at = np.where(self.long[at] != 0, at + 1 & len(self.low) - 1, at)

    def _numbers(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of each chunk; new ones are learned."""
        out = np.full(len(begin), -1, np.int32)
        long = end - begin
        short = np.flatnonzero(long <= _KEY)
        n = long[short]
        key = np.lib.stride_tricks.sliding_window_view(x, _KEY)[begin[short]].view("<u8") & _KEEP[n]
        low, high = np.ascontiguousarray(key[:, 0]), np.ascontiguousarray(key[:, 1])
        h, place = self._place(low, high, n)
        found = self._find(low, high, n, place)
        fresh = np.flatnonzero(found < 0)
        _, one, back = np.unique(h[fresh], return_index=True, return_inverse=True)
        like = fresh[one][back]
        clash = (low[fresh] != low[like]) | (high[fresh] != high[like]) | (n[fresh] != n[like])  # equal hashes of other bytes
        new = [x[begin[i] : end[i]].tobytes() for i in short[fresh[one]].tolist()]
        known = self.known
        found[fresh] = known + back.astype(np.int32)
        found[fresh[clash]] = -1
        out[short] = found
        others = np.flatnonzero(out < 0).tolist()
        for i in others:
            c = x[begin[i] : end[i]].tobytes()
            at = self.others.get(c)
            if at is None:
                at = self.others[c] = known + len(new)
                new.append(c)
            out[i] = at
        if new:
            k = fresh[one]
            self._learn(new)
            self._store(low[k], high[k], n[k].astype(np.uint8), known + np.arange(len(k), dtype=np.int32))
        return out

    def encode(self, texts: list[str] | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of ids of each text."""
        if self.known > self.most:
            self._reset()
        raw = [t.encode() if isinstance(t, str) else t for t in texts]
        x = np.frombuffer(b"\0" + b"\0".join(raw) + bytes(_KEY + 1), np.uint8)
        first = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in raw])[:-1]]).astype(np.int64) if raw else np.zeros(0, np.int64)
        a = np.flatnonzero(_LEAD[x])
        p, q, r = x[a], x[a + 1], x[a + 2]
        wide = ((p == 0xC2) & ((q == 0x85) | (q == 0xA0))) | ((p == 0xE1) & (q == 0x9A) & (r == 0x80)) | ((p == 0xE3) & (q == 0x80) & (r == 0x80))
        wide |= (p == 0xE2) & (((q == 0x80) & ((r <= 0x8A) | (r == 0xA8) | (r == 0xA9) | (r == 0xAF))) | ((q == 0x81) & (r == 0x9F)))
        odd = {i for i, t in enumerate(raw) if 0 in t} | set((np.searchsorted(first, a[wide], "right") - 1).tolist())
        number = of = None
        if odd:  # texts with other white space or with zeros are cut by the pattern
            x = x.copy()
            chunks, own = [], []
            for i in sorted(odd):
                x[first[i] : first[i] + len(raw[i])] = 0
                mine = [c.encode() for c in self.chunks(raw[i].decode())]
                chunks += mine
                own += [i] * len(mine)
            long = np.array([len(c) for c in chunks], np.int64)  # none at all if the texts are white space
            ends = np.cumsum(long)
            y = np.frombuffer(b"".join(chunks) + bytes(_KEY), np.uint8)
            number, of = self._numbers(y, ends - long, ends), np.array(own, np.int64)
        begin, end = self._cut(x)
        chunk, owner = self._numbers(x, begin, end), np.searchsorted(first, begin, "right") - 1
        if odd:
            owner = np.concatenate([owner, of])
            order = np.argsort(owner, kind="stable")
            chunk, owner = np.concatenate([chunk, number])[order], owner[order]
        begin = self.at[chunk]
        long = self.at[chunk + 1] - begin
        bounds = np.concatenate([np.zeros(1, np.int32), np.cumsum(long, dtype=np.int32)])
        ids = self.flat[np.repeat(begin - bounds[:-1], long) + np.arange(bounds[-1], dtype=np.int32)]
        return ids, np.diff(bounds[np.searchsorted(owner, np.arange(len(raw) + 1))])


def with_end(ids: np.ndarray, n: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts with the end id after each, and their new numbers."""
    out = np.full(len(ids) + len(n), end_id, np.int32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(n + 1) - 1] = False
    out[keep] = ids
    return out, n + 1


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process: another tokenizer's goes."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(texts: list | pa.Array, most_chars: int = 1_500_000) -> list[tuple[int, int]]:
    """Ranges of a list or column of texts with about so many characters (bytes) each, one text at least."""
    long = pc.fill_null(pc.binary_length(texts), 0).to_pylist() if isinstance(texts, pa.Array) else [len(t or "") for t in texts]
    out, start, chars = [], 0, 0
    for i, n in enumerate(long):
        if i > start and chars + n > most_chars:
            out.append((start, i))
            start, chars = i, 0
        chars += n
    if start < len(long):
        out.append((start, len(long)))
    return out
