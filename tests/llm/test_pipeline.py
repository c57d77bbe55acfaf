"""Null and repeated ids in the pipeline, stage by stage."""

from collections import Counter

import corpus_pipeline as P
import pytest

WORDS = {s: " ".join(f"{s}{i}word" for i in range(40)) for s in "abcdefgh"}


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t else None) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_one_of_each_group(spark):
    rows = [(None, WORDS["a"], "x"), (4, WORDS["b"], "x"), (4, WORDS["b"], "x"), (4, WORDS["c"], "x"), (None, WORDS["d"], "x"), (None, WORDS["d"], "x"), (7, WORDS["e"], "x"), (None, WORDS["e"], "x"), (9, WORDS["e"], "x"), (None, None, "x"), (5, None, "x")]
    got = Counter((r.doc_id, r.text) for r in P.keep_one_of_each_group(spark, documents(spark, rows), "").collect())
    assert got == Counter({(None, WORDS["a"]): 1, (4, WORDS["b"]): 1, (4, WORDS["c"]): 1, (None, WORDS["d"]): 1, (7, WORDS["e"]): 1, (None, None): 1, (5, None): 1})


def test_passages_keep_every_row(spark):
    rows = [(None, WORDS["a"], "x"), (None, WORDS["a"], "x"), (1, WORDS["b"], "x"), (1, WORDS["b"], "x"), (2, WORDS["b"] + " end", "x")]
    got = Counter((r.doc_id, r.text) for r in P.remove_repeated_passages(spark, documents(spark, rows), "").collect())
    assert got == Counter({(None, WORDS["a"]): 2, (1, WORDS["b"]): 2, (2, "end"): 1})


def test_mix_takes_null_and_repeated_ids(spark):
    # weights 5, 2: x is below its target and is taken three times, y gets the rest
    rows = [(None, WORDS["a"], "x"), (1, WORDS["b"], "x"), (1, WORDS["b"], "x"), *((100 + i, WORDS["c"], "y") for i in range(20))]
    got = Counter((r.doc_id, r.text) for r in P.mix_sources(spark, documents(spark, rows), "").collect() if r.source == "x")
    assert got == Counter({(None, WORDS["a"]): 3, (1, WORDS["b"]): 6})


@pytest.mark.parametrize("known", [False, True])
def test_rows_are_numbered_once(spark, known):
    docs = documents(spark, [(None, "a", "x"), (None, "a", "x"), (1, "b", None)])
    docs = P.with_rows(docs, P.Scratch(spark, "t")) if known else docs
    assert P.with_rows(docs, P.Scratch(spark, "t")).select(P.ROW).distinct().count() == 3


def test_pipeline_runs(spark):
    assert P.run(spark, "/root/testdata/sf0.001").count() > 0
