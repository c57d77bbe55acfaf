"""Literal goldens of the text rules."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import graph, layout, runs
from vellum.operators.labels import font_labels


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr).first()[0]


def cuts(spark, text):
    out, at = [], 0
    for p in one(spark, T.sentence_pieces(F.col("t")), t=text)[:-1]:
        at += len(p)
        out.append(at)
    return out


@pytest.mark.parametrize(
    "text,want",
    [
        ("See Fig. 3. It works.", [9, 12]),
        ("J. Smith et al. found it.", [16]),
        ("word.Next one", [5]),
        ("U.S.A policy", []),
        ("v3.14 is out", []),
        ("End. ", []),
        ("はい。次へ", [3]),
        ('He said "no." Then left.', [14]),
    ],
)
def test_cuts(spark, text, want):
    assert cuts(spark, text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("Fig. 3 shows eight", None),
        ("fig. 4a to 4c are", None),
        ("<b>Fig. 2</b> | x", None),
        ("Fig. 3. Cells", ("Fig.", "figure", "3")),
        ("Figure 6 Comparison of", ("Figure", "figure", "6")),
        ("Table S1: data", ("Table", "table", "S1")),
        ("図 3：abc", ("図", "figure", "3")),
        ("Supplementary Fig. 4a. z", ("Fig.", "figure", "4a")),
        ("Tab 2", ("Tab", "table", "2")),
    ],
)
def test_caption_head(spark, text, want):
    got = one(spark, T.caption_head(F.col("t")), t=text)
    assert (tuple(got) if got else None) == want


def test_untranslated(spark):
    rows = [("Hello world", "Bonjour", "ja", True), ("Guten Tag", "Good day", "de", False), ("<b>Abstract</b>", "abstract", "fr", True)]
    df = spark.createDataFrame(rows, "t string, s string, lang string, want boolean")
    assert all(r[0] == r[1] for r in df.select("want", T.untranslated(F.col("t"), F.col("s"), F.col("lang"))).collect())


@pytest.mark.parametrize("n,want", [(0, 800), (1200, 800), (3000, 2000), (20000, 8000)])
def test_output_budget(spark, n, want):
    assert one(spark, T.output_budget(F.col("n"), 800, 8000), n=n) == want


def test_citations(spark):
    tag = lambda a, b: one(spark, T.citation(F.lit(3), F.lit(12), F.lit(a).cast("int"), F.lit(b).cast("int")), x=1)
    assert [tag(None, None), tag(10, 10), tag(10, 12)] == ["[P3S12]", "[P3S12:L10]", "[P3S12:L10-12]"]


@pytest.mark.parametrize("src,long,want", [(10, 130, False), (10, 131, True)])
def test_hallucination(spark, src, long, want):
    assert one(spark, T.hallucinated(F.col("t"), F.lit(src)), t="x" * long) is want


@pytest.mark.parametrize("x,want", [([1.0, 2.0, 3.0, 4.0], 3.0), ([5.0], 5.0)])
def test_upper_median(spark, x, want):
    assert spark.createDataFrame([(v,) for v in x], "x double").agg(layout.upper_median(F.col("x"))).first()[0] == want


@pytest.mark.parametrize("lines,want", [(["small-", "molecule"], "small-molecule"), (["A-", "Beta"], "A- Beta"), (["3-", "fold"], "3- fold"), (["pre--", "x"], "pre-- x")])
def test_dehyphenation(spark, lines, want):
    df = spark.createDataFrame([(1, 0, 0, i, t) for i, t in enumerate(lines)], "doc_id long, column int, p int, i int, text string")
    assert layout.joined_text(df).first()["joined"] == want


def test_sections_and_references(spark):
    a = spark.createDataFrame([(1, "===BLOCK 0===\nA\n===BLOCK 1===\nB")], "conv_id long, text string")
    assert {r.block: r.text for r in runs.sections(a).collect()} == {0: "A", 1: "B"}
    assert {r.block: r.text for r in runs.sections(a, True).collect()} == {0: "A"}
    rows = [("Introduction", "heading"), ("t", None), ("References", "heading"), ("r1", None), ("r2", "caption"), ("Methods 19, 1116 (2022).", None), ("Methods", "heading"), ("m1", None)]
    df = spark.createDataFrame([(1, i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, i int, text string, label string")
    got = [r.label for r in runs.reference_section(df).orderBy("i").collect()]
    assert got == ["heading", None, "heading", "references", "caption", "references", "heading", None]


def test_guarded_merge(spark):
    def roots(pairs):
        nodes = spark.createDataFrame([(1, i) for i in range(6)], "doc_id long, node long")
        edges = spark.createDataFrame([(1, a, b) for a, b in pairs], "doc_id long, a long, b long")
        return [r.root for r in graph.guarded_merge(graph.merge_roots(spark, nodes, edges)).orderBy("node").collect()]

    assert roots([(1, 2), (2, 3)]) == [0, 1, 1, 1, 4, 5]
    assert roots([(0, 1), (1, 2), (2, 3), (3, 4)]) == [0, 1, 2, 3, 4, 5]


def test_labels(spark):
    rows = [("Abstract", 1.0, False, "abstract_heading"), ("Results and Discussion", 1.0, False, "heading"), ("Figure 2. Cells", 1.2, True, "caption"), ("A title", 1.1, False, "title"), ("Cell growth", 1.0, True, "subheading"), ("It was grown", 1.0, True, None), ("mail me@x.org", 1.0, False, "contact"), ("*Department of Physics, University of X", 1.0, False, "affiliation"), ("Ann Lee¹, Bob Ray², Carl Fox³", 1.0, False, "authors"), ("", 1.0, True, None)]
    df = spark.createDataFrame(rows, "t string, r double, b boolean, want string")
    assert [r[0] for r in df.select(font_labels(F.col("t"), F.col("r"), F.col("b"))).collect()] == [r[3] for r in rows]
