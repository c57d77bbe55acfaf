"""Search for many questions, spreading captions, legends, regions, aligners and greedy chains against plain loops."""

import random
import re
import time

import pytest

from vellum.operators import align, captions, greedy, layout, runs, search, tables

# --------------------------------------------------------------------------- search


def grams(t):
    t = t.lower()
    return {t[k : k + 2] for k in range(len(t) - 1) if not re.fullmatch(r"[぀-ゟ\s\W]{2}", t[k : k + 2])}


@pytest.mark.parametrize("block,batch,probe", [(4_000_000, 4096, 20_000), (300, 3, 40), (1000, 1, 1)])
def test_best_sentences(spark, block, batch, probe):
    r = random.Random(4)
    words = ["alpha", "beta", "Gamma", "delta", "これは", "文です", "漢字", "a_b", "x-y", "--", "éé", "12"]
    sents = [(i % 30, i, " ".join(r.choices(words, k=r.randint(1, 25)))) for i in range(400)] + [(3, 900, None), (4, 901, ""), (None, 902, "alpha"), (5, 903, "q")]
    asked = [(q, " ".join(r.choices(words, k=r.randint(1, 9)))) for q in range(9)] + [(50, None), (51, ""), (52, "です"), (53, "zzzz"), (None, "alpha")]
    got = search.best_sentences(spark.createDataFrame(sents, "doc_id long, k long, sentence string").repartition(3), spark.createDataFrame(asked, "q long, question string"), 8, block, batch, probe).collect()
    want = set()
    for q, t in asked:
        if q is not None:
            found = [(-len(grams(t or "") & grams(s or "")), d, k) for d, k, s in sents if d is not None]
            want |= {(q, n, d, k, -score) for n, (score, d, k) in enumerate(sorted(x for x in found if x[0])[:8], 1)}
    assert {(x.q, x["rank"], x.doc_id, x.k, x.score) for x in got} == want and len(got) == len(want)


def test_no_sentences_or_no_questions(spark):
    s, q = spark.createDataFrame([(1, 1, "some words")], "doc_id long, k long, sentence string"), spark.createDataFrame([(1, "some words")], "q long, question string")
    assert search.best_sentences(s.where("false"), q).count() == 0 and search.best_sentences(s, q.where("false")).count() == 0


def test_sentences_are_sent_once_whatever_the_batches(spark):
    """Each sentence was sent once to a batch of questions, and each question once to a block of sentences."""
    s = spark.range(300).selectExpr("id doc_id", "id k", "concat('some words ', id) sentence")
    q = spark.range(20).selectExpr("id q", "concat('words ', id) question")
    found = search.best_sentences(s, q, 2, 500, 3, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "explode" not in plan
    assert found.count() == 40


# --------------------------------------------------------------------------- captions


def plain_spread(sentences):
    """The rules read one after the other, on dictionaries."""
    paras = {}
    for s in sentences:
        paras.setdefault(s["p"], []).append(s)
    middle = lambda p: sorted(x["size"] for x in paras[p])[len(paras[p]) // 2]
    page, order = max(s["right"] for s in sentences), list(paras)
    for n, p in enumerate(order):
        if not any(s["label"] == "caption" for s in paras[p]):
            continue
        for s in paras[p]:
            s["label"] = "caption" if s["label"] in (None, "", "title", "subheading") else s["label"]
        free = [middle(q) for q in order if not any(s["label"] for s in paras[q])]
        smaller = middle(p) < (max(free) if free else middle(p)) - 0.5
        for q in order[n + 1 :]:
            off = middle(q) - middle(p)
            if any(s["label"] for s in paras[q]) or off > 0.6 or (abs(off) <= 0.6 and not smaller) or (off < -0.6 and max(s["width"] for s in paras[q]) < page * 0.4):
                break
            for s in paras[q]:
                s["label"] = "caption"
    return sentences


def test_captions_spread(spark):
    r = random.Random(2)
    rows = []
    for page in range(120):
        p = 0
        for i in range(r.randint(1, 40)):
            p += r.random() < 0.5
            rows.append({"doc_id": page, "i": i, "p": p, "label": r.choices([None, "", "caption", "title", "heading", "subheading"], [9, 3, 2, 1, 0.4, 1])[0], "size": r.choice([7.0, 8.0, 8.5, 9.0, 10.0, 12.0]), "width": r.choice([50.0, 150.0, 400.0]), "right": 500.0})
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "doc_id long, i long, p long, label string, size double, width double, right double").repartition(5)
    want = {(x["doc_id"], x["i"]): x["label"] for page in range(120) for x in plain_spread([x for x in rows if x["doc_id"] == page])}
    assert {(x.doc_id, x.i): x.label for x in captions.spread_captions(df).collect()} == want
    assert sum(v == "caption" for v in want.values()) > sum(x == "caption" for x in df.toPandas()["label"])


def test_legends(spark):
    rows = [
        (1, 1, 0, 0, "See Fig. 3 for it.", None), (1, 1, 1, 1, "<b>Fig. 3.</b> Cells", "TR 3"), (1, 1, 2, 1, "grow <i>fast</i>.", None), (1, 1, 3, 1, "", "x"), (1, 1, 4, 1, "Fig. 4a: Other", None), (1, 1, 5, 2, "Body.", None),
        (1, 2, 0, 2, "Fig. 3. Again, later", None), (1, 2, 1, 3, "Supplementary Figure 3. Extra", ""), (1, 2, 2, 3, "more", "  "), (1, 2, 3, 3, "Table 3. Not a figure", None), (1, 2, 4, 3, "tail", None),
        (2, 1, 0, 0, "Table S2", None), (2, 1, 1, 0, "cells", None), (2, 1, 2, 0, "表 2：数", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, page_no long, i long, p long, src string, tgt string").repartition(4)
    asked = [(d, n, k) for d in (1, 2) for n in ("3", "4", "S3", "s2", "2", "9", None) for k in ("figure", "table")]
    got = {(x.doc_id, x.num, x.kind): x.legend for x in captions.legends_of(df, spark.createDataFrame(asked, "doc_id long, num string, kind string")).collect()}
    assert got == {
        (1, "3", "figure"): "TR 3 grow fast. x", (1, "4", "figure"): "Fig. 4a: Other", (1, "S3", "figure"): "Supplementary Figure 3. Extra Table 3. Not a figure tail",
        (1, "3", "table"): "Table 3. Not a figure tail", (2, "s2", "table"): "Table S2 cells", (2, "2", "table"): "表 2：数",
    }


def test_all_legends(spark):
    rows = [(1, 0, "Legends. Fig. 1. One a. Fig 1b: longer than one. Table 1: t"), (1, 1, "Supplementary Figure S2a. x 図 3：あ"), (1, 2, None), (2, 0, "nothing, Fig. 3 shows"), (1, 3, "Fig. 1: longer than ONE.")]
    got = {(x.doc_id, x.kind, x.number): x.legend for x in captions.all_legends(spark.createDataFrame(rows, "doc_id long, b long, text string")).collect()}
    assert got == {(1, "figure", "1"): "Fig 1b: longer than one.", (1, "table", "1"): "Table 1: t", (1, "figure", "s2"): "Supplementary Figure S2a. x", (1, "figure", "3"): "図 3：あ"}


# --------------------------------------------------------------------------- regions


def test_boxes_meet_once(spark):
    r = random.Random(6)
    box = lambda i: (1 + i % 2, (i, *(lambda x, y: (x, y, x + r.choice([0.0, 3.0, 90.0, 700.0]), y + r.choice([0.0, 2.0, 64.0, 300.0])))(r.uniform(-50, 500), r.choice([0.0, 64.0, r.uniform(0, 900)]))))
    a, b = [box(i) for i in range(80)], [box(i) for i in range(90)] + [(1, (99, None, 1.0, 2.0, 3.0)), (1, (98, 9.0, 1.0, 2.0, 3.0))]
    kind = "doc_id long, {} struct<n: long, x0: double, y0: double, x1: double, y1: double>"
    got = [(x.doc_id, x.a.n, x.b.n) for x in tables.meeting_boxes(spark.createDataFrame(a, kind.format("a")), spark.createDataFrame(b, kind.format("b"))).collect()]
    want = {(d, u[0], v[0]) for d, u in a for e, v in b if d == e and v[0] < 98 and max(u[1], v[1]) <= min(u[3], v[3]) and max(u[2], v[2]) <= min(u[4], v[4])}
    assert len(got) == len(want) and set(got) == want


def test_near_pairs_of_any_size(spark):
    r = random.Random(8)
    boxes = [(1, i, x, y, x + w, y + h) for i in range(150) for x, y, w, h in [(r.uniform(0, 600), r.uniform(0, 600), r.choice([0.0, 5.0, 200.0]), r.choice([0.0, 0.5, 10.0, 250.0]))]]
    df = spark.createDataFrame(boxes, "doc_id long, line_no long, x0 double, y0 double, x1 double, y1 double")

    def near(a, b):
        h = max(min(a[5] - a[3], b[5] - b[3]), 1.0)
        return max(a[3], b[3]) - min(a[5], b[5]) <= 0.8 * h and max(a[2], b[2]) - min(a[4], b[4]) <= 1.5 * h

    want = {(a[1], b[1]) for a in boxes for b in boxes if a[1] < b[1] and near(a, b)}
    got = [(x.a, x.b) for x in layout.near_pairs(df).collect()]
    assert len(got) == len(want) and set(got) == want


def test_tables_stop_for_each_reason(spark):
    page = lambda n, **how: {"doc_id": 1, "page_no": n, "caption": False, "x0": 70.0, "y0": 20.0, "x1": 500.0, "y1": 700.0, "top": 0.0, "height": 800.0, "rule_x0": 70.0, "rule_x1": 500.0, "tabular": False} | how
    ok = {2: {}, 3: {}, 4: {"caption": True}, 6: {"x0": None}, 8: {"y0": 201.0}, 10: {"x1": 521.0}, 12: {"rule_x0": None}, 14: {"rule_x1": None, "tabular": True}, 15: {}}
    rows = [page(n, **ok.get(n, {})) for n in range(1, 16)] + [page(n) for n in range(100, 130)]
    kind = "doc_id long, page_no long, caption boolean, x0 double, y0 double, x1 double, y1 double, top double, height double, rule_x0 double, rule_x1 double, tabular boolean"
    begun = [(1, n, 72.0, 499.0) for n in (1, 2, 4, 6, 9, 11, 13, 100)]
    got = {x.page_no: (x.pages, x.stopped, [b["at"] for b in x.boxes]) for x in tables.continuations(spark.createDataFrame(begun, "doc_id long, page_no long, x0 double, x1 double"), spark.createDataFrame([tuple(r.values()) for r in rows], kind)).collect()}
    assert got == {1: (2, "caption", [2, 3]), 2: (1, "caption", [3]), 4: (1, "empty", [5]), 6: (1, "low", [7]), 9: (0, "width", []), 11: (0, "prose", []), 13: (2, "end", [14, 15]), 100: (20, "limit", list(range(101, 121)))}


# --------------------------------------------------------------------------- aligners


def plain_places(copied, text):
    out, begin = [], 0
    for i, part in enumerate(p for p in copied.split("|") if p.strip()):
        probe = re.sub(r"\s+", " ", part.lstrip()[:30]).strip()
        at = text.find(probe, begin)
        if at < 0:
            k = re.sub(r"\s+", " ", text[begin:]).find(probe)
            at = begin + k if k >= 0 else k
        if at < 0 and len(probe) >= 5:
            at = text.find(probe[:5], begin)
        if at >= 0 and (at := 0 if i == 0 else at) < len(text):
            out.append(at)
            begin = at + max(1, len(probe))
    return out


@pytest.mark.parametrize("near", [0, 7, 2000])
def test_parts_are_found_as_by_plain_search(monkeypatch, near):
    monkeypatch.setattr(align, "_NEAR", near)
    r = random.Random(near)
    for _ in range(400):
        words = r.choices(["ab", "abc", "a", "bca", "cab.", "  ", "\n", "\t x", "é😀", "zz"], k=r.randint(0, 60))
        text = "".join(w + r.choice(["", " ", "  ", "\n"]) for w in words)
        copied = "|".join(r.choice(["".join(words[i : i + r.randint(1, 9)]), "lost", "ab lost", " "]) for i in sorted(r.choices(range(len(words) or 1), k=8)))
        assert align.part_places(copied, text) == plain_places(copied, text), (copied, text)


def test_long_texts_take_seconds():
    r = random.Random(1)
    sentences = [f"S{i} " + " ".join(r.choices(["the", "result", "of", "this", "model", "shows", "that", "x1"], k=12)) for i in range(150_000)]
    text, t = "  ".join(sentences), time.time()
    copied = "|".join(s if i % 10 else f"Q{i} is nowhere in the text at all" for i, s in enumerate(sentences))
    found = align.part_places(copied, text)
    assert len(text) > 10_000_000 and len(found) > 120_000 and time.time() - t < 60


def test_lines_of_a_paragraph(spark):
    para = [(1, 0, "one two three and a long line that goes on here one two", [(1, "one  two"), (2, "\tthree"), (3, " "), (4, "and a long line that goes off here"), (5, None), (6, "gone"), (7, "one two")]), (1, 1, None, [(8, "x")]), (2, 0, "x", None)]
    df = spark.createDataFrame(para, "doc_id long, p long, joined string, lines array<struct<line_no: long, text: string>>")
    got = sorted(tuple(x) for x in align.lines_in_paragraphs(df).collect())
    assert got == [(1, 0, 1, 0, 7), (1, 0, 2, 8, 13), (1, 0, 4, 14, 48), (1, 0, 7, 48, 55)]


# --------------------------------------------------------------------------- greedy chains


def plain_chain(rows, begin=None):
    out = []
    for key in {r[0] for r in rows}:
        at = (begin or {}).get(key, 0)
        for r in sorted((x for x in rows if x[0] == key), key=lambda x: x[1:]):
            if r[1] >= at:
                out.append(r)
                at = max(r[1], r[2])
    return sorted(map(repr, out))


@pytest.mark.parametrize("slice_rows,longest", [(50_000, 9), (7, 9), (5, 60), (3, 2), (4, 0)])
def test_chains_in_slices(spark, slice_rows, longest):
    r = random.Random(slice_rows + longest)
    rows = list({(k, s, s + r.randint(-1, longest), f"t{s}") for k in (1, None, 3) for s in r.sample(range(-5, 400), 90 if k != 3 else 4)})
    df = spark.createDataFrame(rows, "key long, start long, end long, tag string").repartition(4)
    assert sorted(repr(tuple(x)) for x in greedy.chain(df, slice_rows).collect()) == plain_chain(rows)
    begin = spark.createDataFrame([(1, 100), (3, -3)], "key long, from long")
    assert sorted(repr(tuple(x)) for x in greedy.chain(df, slice_rows, begin).collect()) == plain_chain(rows, {1: 100, 3: -3})


def test_one_key_of_a_million_spans(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr("7L as key", "id * 3 as start", "id * 3 + 2 + (id * 7919) % 400 as end", "id as tag")
    got = runs.first_spans(df)
    at, want = 0, []
    for i in range(n):
        if i * 3 >= at:
            at = i * 3 + 2 + (i * 7919) % 400
            want.append(i)
    assert sorted(x.tag for x in got.select("tag").collect()) == want
    assert got.rdd.getNumPartitions() > 1


def test_throttle(spark):
    rows = [(1, t, t) for t in (0, 3, 4, 5, 9, 10, 14, 15, 16)] + [(1, 9, 2), (2, None, 1), (2, 8, 1), (2, 12, 1), (2, 13, 1)]
    got = sorted(tuple(x) for x in runs.throttled(spark.createDataFrame(rows, "key long, at long, n long"), 5).collect())
    assert got == [(1, 5, 5), (1, 10, 10), (1, 15, 15), (2, 13, 1)]
