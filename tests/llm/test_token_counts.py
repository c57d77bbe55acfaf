"""Token counts at every prefix against the library's count of that prefix."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vellum.llm import token_counts as tc
from vellum.llm.queries import TOKEN_LIMIT, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "e", "lt", "s", " ", "   ", "\n", "\t", "'", "'re", "'ll", "'ve", "'s", "1", "23", "!", "...", "é", "ß", "Д", "日本", " ", "　", "<|endoftext|>", "<|endo"]
ODD += ["😀", "\x00", "_", "hello", " the", "\r\n", "\x1c", "\x85", "’", "ſ", "²", "aaaaaaaa", "========"]


LIBRARY = Tokenizer.from_file(PATH)


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_every_prefix_of_odd_texts():
    rnd = random.Random(7)
    texts = ["".join(rnd.choices(ODD, k=rnd.randint(0, 30))) for _ in range(600)] + ["", " ", "'re", "we'rex", "<|endoftext|><|endoftext|> x", "a <|endoftext|>"]
    for t, x in zip(texts, tc.counter(PATH).changes([t.encode() for t in texts]), strict=True):
        assert np.cumsum(x).tolist() == library([t[:k] for k in range(1, len(t) + 1)]), repr(t)


def test_memory_is_bounded_and_forgetting_changes_nothing():
    small, texts = tc.PrefixCounter(PATH, most=10), ["one two three four five six", "seven, eight; nine (ten) eleven!", "ünïcödé wörds añadidos"] * 3
    for t in texts:
        assert small.changes([t.encode()])[0].sum() == library([t])[0]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tc.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_rows(spark):
    long = "A very long text, isn't it? " * 40_000
    texts = [None, "", "Hello  world<|endoftext|>", "Hello  world<|endoftext|>", long, "x" * 50_000, "word " * 512, "word " * 600]
    rows = [(None if i == 1 else min(i, 3), t, f"n{i}", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, rest int")  # names clash
    tables = tc.prefix_tables(docs, PATH)
    got = {r["rest"]["rest"]: r for r in tc.token_counts(tables, 512).collect()}
    want = library([t or "" for t in texts])
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["doc_id"], r["rest"]["n_bytes"], r["n_bytes"], r["n_chars"], r["n_tokens"], r["over_limit"]) == (rows[i][0], f"n{i}", len((t or "").encode()), len(t or ""), want[i], want[i] > 512)
        cut = library([(t or "")[: r["fit_chars"]], (t or "")[: r["fit_chars"] + 1]])
        assert cut[0] <= 512 and (r["fit_chars"] == len(t or "") or cut[1] > 512)
    assert tc.prefix_tables(docs.where("false"), PATH).count() == 0


def test_questions_need_no_text(spark):
    docs = spark.createDataFrame([(1, "don't  stop <|endoftext|>now"), (2, ""), (3, None)], "id long, body string")
    tables = tc.prefix_tables(docs, PATH, "id", "body").cache()
    at = {(r["id"], r["k"]): r["n"] for k in (-1, 0, 3, 4, 7, 24, 25, 99) for r in tables.selectExpr("*", f"{k} as k").withColumn("n", tc.tokens_at("prefix_counts", k)).collect()}
    text = "don't  stop <|endoftext|>now"
    assert all(at[1, k] == library([text[: max(k, 0)]])[0] and at[2, k] == at[3, k] == 0 for k in (-1, 0, 3, 4, 7, 24, 25, 99))
    for budget in range(9):
        got = {r["id"]: r["c"] for r in tables.withColumn("c", tc.characters_within("prefix_counts", budget)).collect()}
        assert got == {1: max(k for k in range(len(text) + 1) if library([text[:k]])[0] <= budget), 2: 0, 3: 0}


def test_query(spark, tmp_path):
    texts = [None, "", "Some text.", "word " * 700, "日本 <|endoftext|>"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries()["op11_token_counts"](spark, str(tmp_path)).collect()}
    n = library([t or "" for t in texts])
    assert {i: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for i, r in got.items()} == {i: (len((t or "").encode()), n[i], n[i] > TOKEN_LIMIT) for i, t in enumerate(texts)}
