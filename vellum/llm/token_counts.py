"""Token counts of every prefix of a text, by dynamic programming over the prefixes of its chunks.

The encoding of a prefix is the encoding of a shorter prefix and one last token, and of the tokens that end there just one
fits: the one that the tokenizer leaves apart from the shorter prefix's last token. So a table of last tokens, filled from left to
right, holds the exact count at every prefix. Texts consist of chunks that tokens don't cross: each different chunk is worked
out once, and a text's table is its chunks' tables one after the other. What is stored are the differences from one
character to the next, mostly a byte each: sums of them answer how many tokens a cut text has, or where to cut it for a budget.
"""

from __future__ import annotations

import re
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from vellum.llm.common import _BYTE_ALPHABET, SPACE, Encoder, release, slices

_SPACES = re.compile(f"[{SPACE}]+")
#: Endings that the tokenizer's pattern takes as one only when complete (fixed values).
_ENDINGS = ("'re", "'ve", "'ll")
_ALPHABET = [chr(_BYTE_ALPHABET.get(b, b)) for b in range(256)]
#: Pairs of tokens, and numbers in chunks' tables, that a worker remembers.
_MOST_PAIRS, _MOST_NUMBERS = 1_000_000, 40_000_000


class PrefixCounter(Encoder):
    """For each byte of a text how the token count changes there; 0 within a character, so that sums are of whole characters.

    Takes byte-level tokenizers only. Special strings are one token each, as is the library's default; before its last
    character such a string is counted as ordinary text, as the library counts a text that ends there.
    """

    def __init__(self, path: str, most: int = 600_000) -> None:
        super().__init__(path, most)
        if not self.spaced or self.lib.normalizer is not None or "ByteLevel" not in repr(self.lib.pre_tokenizer):
            raise ValueError(f"{path} is no byte-level tokenizer without a normalizer")
        self.vocabulary = self.lib.get_vocab(with_added_tokens=False)
        self.token = {i: t for t, i in self.vocabulary.items()}
        self.ending = ahocorasick.Automaton()  # gives the tokens that end at each place
        for t, i in self.vocabulary.items():
            self.ending.add_word(t, (i, len(t)))
        self.ending.make_automaton()
        added = self.lib.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError(f"{path} has special strings that take in what stands beside them")
        self.special = [t.content.encode() for t in added]
        self.specials = re.compile(b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or b"(?!)")
        self.pairs: dict[int, bool] = {}

    # ------------------------------------------------------------------ the table of a chunk

    def _apart(self, key: int) -> bool:
        """Whether the tokenizer leaves two tokens as they are when one follows the other; without the first: whether the second stays one token."""
        if len(self.pairs) > _MOST_PAIRS:
            self.pairs.clear()
        a, b = (key >> 32) - 1, key & 0xFFFFFFFF
        want = [b] if a < 0 else [a, b]
        found = self.pairs[key] = [t.id for t in self.lib.model.tokenize("".join(map(self.token.__getitem__, want)))] == want
        return found

    def prefixes(self, piece: str) -> list[int]:
        """Counts at every byte of a piece in the byte alphabet, from 0 bytes on. The piece is merged by itself."""
        n = len(piece)
        count, last = [0] * (n + 1), [-1] * (n + 1)
        done, pairs = -1, self.pairs
        for end, (t, size) in self.ending.iter(piece):
            if end == done:
                continue
            at = end + 1 - size
            key = last[at] + 1 << 32 | t
            fits = pairs.get(key)
            if fits or fits is None and self._apart(key):
                done, last[end + 1], count[end + 1] = end, t, count[at] + 1
        return count

    def at_characters(self, chunk: str) -> list[int]:
        """Tokens of the chunk's first character, of its first two, and so on.

        The library cuts a chunk into pieces before it merges. A cut chunk has the same pieces but for two cases: white space at
        its end is one piece, and an incomplete ending such as that of `'re` is an apostrophe and a letter.
        """
        out, before = [], 0
        for piece, (s, e) in self.lib.pre_tokenizer.pre_tokenize_str(chunk):
            counts, at = self.prefixes(piece), 0
            for c in chunk[s:e]:
                at += len(c.encode())
                out.append(before + counts[at])
            if piece in _ENDINGS:
                out[s + 1] = before + self.prefixes(piece[0])[-1] + self.prefixes(piece[1])[-1]
            before += counts[-1]
        for m in _SPACES.finditer(chunk):
            before, at = out[m.start() - 1] if m.start() else 0, 0
            counts = self.prefixes("".join(_ALPHABET[b] for b in m[0].encode()))
            for k, c in enumerate(m[0], m.start()):
                at += len(c.encode())
                out[k] = before + counts[at]
        return out

    def _learn(self, new: list[bytes]) -> None:
        """Works out the tables of new chunks, which get the next numbers."""
        at, flat = [int(self.at[self.known])], []
        for c in new:
            if c.isascii() and (c.isalpha() or c[1:].isalpha() and c[:1] == b" "):  # one piece
                counts = self.prefixes(c.decode().replace(" ", _ALPHABET[32]))
                flat += [b - a for a, b in zip(counts, counts[1:], strict=False)]
            else:
                text, before = c.decode(), 0
                if self.word(text):  # one piece
                    counts = self.prefixes(text.encode().decode("latin-1").translate(_BYTE_ALPHABET))
                    ends = accumulate(1 if char < "\x80" else 2 for char in text)
                    found = [counts[k] for k in ends]
                else:
                    found = self.at_characters(text)
                for char, n in zip(text, found, strict=True):
                    flat += [0] * (len(char.encode()) - 1) + [n - before]
                    before = n
            at.append(int(self.at[self.known]) + len(flat))
        if self.known + len(new) >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros(len(self.at) + len(new), np.int32)])
        if at[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), at[-1]), np.int32)])
        self.flat[at[0] : at[-1]] = flat
        self.at[self.known + 1 : self.known + 1 + len(new)] = at[1:]
        self.known += len(new)

    # ------------------------------------------------------------------ texts

    def changes(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text the change of its token count at each of its characters."""
        if len(self.flat) > _MOST_NUMBERS:
            self._reset()
        parts, of, ends = [], [], {}
        for i, t in enumerate(texts):
            at = 0
            if any(s in t for s in self.special):
                for m in self.specials.finditer(t):
                    ends[len(parts)] = len(m[0])
                    parts.append(t[at : m.end()])
                    of.append(i)
                    at = m.end()
            parts.append(t[at:])
            of.append(i)
        flat, n = self.encode(parts)
        bounds = np.concatenate([[0], np.cumsum(n)])
        for k, size in ends.items():  # with its last character the special string becomes one token
            end = bounds[k + 1]
            flat[end - 1] = 1 - flat[end - size : end - 1].sum()
        whole = np.frombuffer(b"".join(texts) + b" ", np.uint8)
        last = (whole[1:] & 0xC0) != 0x80
        byte_bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        return [flat[s:e][last[s:e]] for s, e in zip(byte_bounds[:-1], byte_bounds[1:], strict=True)]


def packed(changes: np.ndarray) -> bytes:
    """A table as stored: the width of a number in bytes, then the changes, little-endian."""
    width = 1 if not len(changes) or (changes.min() >= -128 and changes.max() < 128) else 4
    return bytes([width]) + changes.astype(f"<i{width}").tobytes()


def counts(table: bytes) -> np.ndarray:
    """Tokens of the text's first character, of its first two, and so on."""
    return np.cumsum(np.frombuffer(table, f"<i{table[0]}", offset=1), dtype=np.int64)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One per worker process."""
    if path not in _counters:
        _counters.clear()
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefix_tables(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_bytes, n_chars, prefix_counts, rest): the table of token counts at every character of each whole text.

    `rest` holds the other columns of the input as a struct, so that no name of theirs can clash. A null or empty text has an empty
    table, 0 bytes and 0 tokens. Every row is worked out by itself: repeated rows and rows without an id come back as they
    are, an empty table gives an empty result. A task needs some thirty bytes to each byte of its longest text.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*([F.col(f"`{c}`") for c in rest] or [F.lit(True).alias("none")])).alias("rest"))

    def run(batches):
        for b in batches:
            for s, e in slices(b["text"]):
                part = b.slice(s, e - s)
                texts = part["text"].cast(pa.binary()).fill_null(b"").to_pylist()
                found = counter(tokenizer).changes(texts)
                sizes = [pa.array([len(t) for t in texts], pa.int64()), pa.array([len(x) for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([part["id"], *sizes, pa.array([packed(x) for x in found], pa.binary()), part["rest"]], names=[id_col, "n_bytes", "n_chars", "prefix_counts", "rest"])
        release()

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"`{id_col}` {kind['id']}, n_bytes long, n_chars long, prefix_counts binary, rest {kind['rest']}")


def _answers(f):
    """A function of a table and a number, over columns; null if either is null."""

    @F.arrow_udf(LongType())
    def asked(table: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([None if t is None or k is None else int(f(t, k)) for t, k in zip(table.to_pylist(), n.to_pylist(), strict=True)], pa.int64())

    return lambda table, n: asked(F.col(table) if isinstance(table, str) else table, (n if isinstance(n, Column) else F.lit(n)).cast("long"))


def _at(table: bytes, n: int) -> int:
    part = np.frombuffer(table, f"<i{table[0]}", offset=1)
    return part[: max(n, 0)].sum(dtype=np.int64)


def _within(table: bytes, budget: int) -> int:
    fits = np.flatnonzero(counts(table) <= budget)
    return fits[-1] + 1 if len(fits) else 0


#: Tokens of a text that is cut after its first n characters (n beyond its end: of the whole text; below 0: none).
tokens_at = _answers(_at)
#: Most characters to which a text can be cut so that it has no more than n tokens.
characters_within = _answers(_within)


def token_counts(tables: DataFrame, limit: int) -> DataFrame:
    """Adds to prefix tables n_tokens, over_limit (more than `limit` tokens) and fit_chars (where to cut for `limit` tokens)."""
    found = tables.withColumns({"n_tokens": tokens_at("prefix_counts", F.col("n_chars")), "fit_chars": characters_within("prefix_counts", limit)})
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
