"""Language ID: multinomial naive Bayes over hashed character n-grams, scored in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, release, slices

#: Orders of the character n-grams, and the bits of a hash bucket: with L languages the model is 4 * L * BUCKETS bytes.
ORDERS, BITS = (1, 2, 3), 15
BUCKETS = 1 << BITS
#: Most languages of a model; it bounds what is broadcast (32 MB). More languages make several models, one after the other.
MOST_LANGUAGES = 256
UNKNOWN = "und"
_CHUNK = 1024
#: Characters that are taken apart at a time, and numbers that are weighed at a time.
PIECE, CELLS = 500_000, 1 << 22


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the lower-cased texts, and the number of n-grams of each text.

    Texts are set apart by as many line ends as the longest n-gram has, and a run counts its n-grams with the
    line end after it; so an n-gram never holds letters of two texts.
    """
    gap = "\n" * max(ORDERS)
    lower = [t.lower() for t in texts]
    x = np.frombuffer((gap.join(lower) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(x) - max(ORDERS) + 1
    out = np.empty((max(n, 0), len(ORDERS)), np.int32)
    for k, order in enumerate(ORDERS):
        h = x[:n].copy()
        for j in range(1, order):
            h *= np.uint32(0x9E3779B1)
            h += x[j : j + n]
        h += np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)
        h *= np.uint32(0xC2B2AE35)
        out[:, k] = h >> np.uint32(32 - BITS)
    long = np.array([len(t) + len(gap) for t in lower], np.int64)
    if len(long):
        long[-1] = n - int(long[:-1].sum())
    return out, long


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def cut(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The small letters of the texts in pieces of bounded length, the text of each piece, and how many places begin an n-gram of its own.

    A piece goes on into the next one as far as its last n-grams reach. A text's last piece has a place more, its line end.
    """
    pieces, own, places = [], [], []
    for i, t in enumerate(texts):
        t = t.lower()
        for s in range(0, max(len(t), 1), PIECE):
            pieces.append(t[s : s + PIECE + max(ORDERS) - 1])
            own.append(i)
            places.append(PIECE if s + PIECE < len(t) else len(t) - s + 1)
    return pieces, np.array(own, np.int64), np.array(places, np.int64)


def sparse(texts: list[str]):
    """Yields (rows, buckets, counts) of the sparse matrix of n-gram counts; a text's cells may come in several parts."""
    pieces, own, places = cut(texts)
    for s, e in slices(pieces, PIECE):
        f, long = features(pieces[s:e])
        place = np.arange(len(f)) - np.repeat(np.cumsum(long) - long, long)
        keep = place < np.repeat(places[s:e], long)
        cell, n = np.unique(np.repeat(own[s:e], long)[keep, None] * BUCKETS + f[keep], return_counts=True)
        yield cell // BUCKETS, cell % BUCKETS, n


def counts(labelled: DataFrame) -> DataFrame:
    """Rows (lang, part, n): counts of the n-gram buckets of each language, 1024 buckets to a row."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b["lang"].to_pylist(), b["text"].to_pylist()
            for lang in set(langs):
                for _, bucket, n in sparse([t for t, la in zip(texts, langs, strict=True) if la == lang]):
                    c = np.bincount(bucket, n, BUCKETS).astype(np.int64)
                    total[lang] = total[lang] + c if lang in total else c
        release()
        for lang, c in total.items():
            parts = c.reshape(-1, _CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())], names=["lang", "part", "n"])

    def added(t: pa.Table) -> pa.Table:
        n = np.sum([np.frombuffer(x, "<i8") for x in t["n"].to_pylist()], axis=0)
        return pa.table([t["lang"][:1], t["part"][:1], pa.array([n.astype("<i8").tobytes()], pa.binary())], names=["lang", "part", "n"])

    schema = "lang string, part int, n binary"
    return labelled.mapInArrow(run, schema).groupBy("lang", "part").applyInArrow(added, schema)


def languages(labelled: DataFrame) -> list[str]:
    """The names of all languages that can be learned, in code point order: one row to each comes to the driver."""
    return sorted(r[0] for r in labelled.where("lang is not null and text is not null").select("lang").distinct().collect())


def train(labelled: DataFrame, smoothing: float = 0.5, langs: list[str] | None = None) -> tuple[list[str], np.ndarray]:
    """Languages (all, or those that are named) and the matrix (bucket, language) of log probabilities; rows of `labelled` are (text, lang).

    All rows are counted. What comes to the driver is the model: one row for each language and 1024 buckets.
    """
    seen = labelled.where("lang is not null and text is not null")
    if langs is None:
        langs = languages(labelled)
    else:
        seen = seen.where(F.col("lang").isin(langs))
    n = np.full((len(langs), BUCKETS), smoothing)
    at = {lang: i for i, lang in enumerate(langs)}
    for r in counts(seen).collect() if langs else []:  # at most languages * 32 rows
        n[at[r["lang"]], r["part"] * _CHUNK : (r["part"] + 1) * _CHUNK] += np.frombuffer(r["n"], "<i8")
    return langs, np.log(n / n.sum(axis=1, keepdims=True)).T.astype(np.float32) if langs else np.empty((BUCKETS, 0), np.float32)


def predict(spark: SparkSession, docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", told: bool = False) -> DataFrame:
    """Adds lang_pred and score, the posterior of lang_pred under equal priors.

    A null text, one without a letter, and any text under an empty model get `und` and score 0. The name of an input
    column that is lang_pred or score is replaced. The whole text is scored: a text's n-grams are counted in a sparse
    matrix, in pieces of PIECE characters, whose cells are weighed CELLS numbers at a time, so that neither a long text nor
    many languages need more memory. Ties fall to the first language in code point order. With `told`, a column lang_top
    comes as well, the log probability of lang_pred, for models that are put together.
    """
    langs, logp = model
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(logp))
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "lang_top")]

    def run(batches):
        for b in batches:
            texts, m = b[text_col].to_pylist(), shared.value
            lang, score, top = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
            use = [i for i, t in enumerate(texts) if len(langs) and has_letter(t)]
            picked = [texts[i] for i in use]
            total = np.zeros((len(use), max(len(langs), 1)))
            for row, bucket, n in sparse(picked):
                step = max(1, CELLS // max(len(langs), 1))
                for s in range(0, len(row), step):
                    r = row[s : s + step]
                    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                    total[r[first]] += np.add.reduceat(m[bucket[s : s + step]] * n[s : s + step, None], first, axis=0, dtype=np.float64)
            best = total.argmax(axis=1)
            p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            for i, k, q, t in zip(use, best.tolist(), p.tolist(), total.max(axis=1).tolist(), strict=True):
                lang[i], score[i], top[i] = langs[k], q, t
            more = [("lang_pred", pa.array(lang, pa.string())), ("score", pa.array(score, pa.float64())), *([("lang_top", pa.array(top, pa.float64()))] if told else [])]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *(x for _, x in more)], names=[*keep, *(c for c, _ in more)])
        release()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep)
    return docs.select(*[f"`{c}`" for c in keep]).mapInArrow(run, f"{kinds}, lang_pred string, score double" + (", lang_top double" if told else ""))


def predict_by_parts(spark: SparkSession, docs: DataFrame, labelled: DataFrame, parts: list[list[str]]) -> DataFrame:
    """`predict` for any number of languages: each part is trained and asked on its own, and the answers are put together.

    Of each text the best language so far, its log probability and the sum of all probabilities relative to it go on to the next part; a
    part's documents are written before the next, so that one model at a time is with the workers.
    """
    held = "lang_so_far"
    while held in docs.columns:
        held += "_"
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "lang_top")]
    scratch = Scratch(spark, "langid")
    out = docs.select(*[f"`{c}`" for c in names], F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(None).cast("double").alias("top"), F.lit(0.0).alias("all")).alias(held))
    for part in parts:
        x = predict(spark, out, train(labelled, langs=part), told=True)
        old, top, mass = F.col(held), F.col("lang_top"), 1 / F.col("score")  # mass: all of the part's probabilities, the best being 1
        wins = old["top"].isNull() | (top > old["top"])
        now = F.when(top.isNull(), old).otherwise(
            F.struct(
                F.when(wins, F.col("lang_pred")).otherwise(old["lang"]).alias("lang"),
                F.when(wins, top).otherwise(old["top"]).alias("top"),
                F.when(old["top"].isNull(), mass).when(wins, mass + old["all"] * F.exp(old["top"] - top)).otherwise(old["all"] + mass * F.exp(top - old["top"])).alias("all"),
            )
        )
        done, out = out, scratch.keep(x.withColumn(held, now).select(*[f"`{c}`" for c in names], held))
        scratch.drop(done)
    return out.select(*[f"`{c}`" for c in names], F.col(held)["lang"].alias("lang_pred"), F.when(F.col(held)["all"] > 0, 1 / F.col(held)["all"]).otherwise(0.0).alias("score"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Trains on the labelled rows that are not held out and predicts all: docs with lang_pred and score.

    A row without doc_id is not held out; a row without lang or text isn't learned from. Any number of languages can be learned.
    """
    labelled = docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("text", "lang")
    langs = languages(labelled)
    if len(langs) <= MOST_LANGUAGES:
        return predict(spark, docs, train(labelled, langs=langs))
    return predict_by_parts(spark, docs, labelled, [langs[s : s + MOST_LANGUAGES] for s in range(0, len(langs), MOST_LANGUAGES)])
