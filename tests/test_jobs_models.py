"""Job documents, bundles and model calls."""

import json

import pytest

from pyspark.sql import functions as F

from vellum.operators import align, models
from vellum.sources import jobs


def state(i, status, **more):
    block = {"i": 0, "orig_i": 0, "p": 0, "src": "Hello.", "ja": "", "rects_px": [[0.0, 1.0, 2.0, 3.0]]}
    return json.dumps({"id": i, "filename": f"{i}.pdf", "status": status, "pages": [{"index": 0, "page_no": 1, "status": "processing", "blocks": [block], "figures": []}], **more})


def test_job_states(spark, tmp_path):
    for i, text in (("a", state("a", "running", created_at=2.0)), ("b", state("b", "done", lang="fr")), ("c", "{broken")):
        (tmp_path / i).mkdir()
        (tmp_path / i / "state.json").write_text(text)
    got = jobs.read_states(spark, f"{tmp_path}/*/state.json").cache()
    assert {r.id: (r.status, r.pages[0].status) for r in got.collect()} == {"a": ("cancelled", "pending"), "b": ("done", "pending")}
    assert [(r.id, r.lang) for r in jobs.listing(got).collect()] == [("a", "ja"), ("b", "fr")]
    assert {(r.doc_id, r.src, r.tgt) for r in jobs.sentences(got).collect()} == {("a", "Hello.", None), ("b", "Hello.", None)}
    out = f"{tmp_path}/out"
    jobs.replace_jobs(got, out)
    jobs.replace_jobs(got.where("id = 'b'"), out)
    assert jobs.read_states(spark, out).count() == 2


def test_bundles():
    data = jobs.export_bundle(b"{}", "job1", {"p.jpg": b"x", "d.pdf": b"y"})
    assert jobs.open_bundle(data) == ("job1", {"state.json": b"{}", "p.jpg": b"x", "d.pdf": b"y"})
    for name, files in (("..", {}), ("ok", {"../x": b""}), ("bad id", {})):
        with pytest.raises(ValueError):
            jobs.open_bundle(jobs.export_bundle(b"{}", name, files))


def test_models(spark):
    rows = spark.createDataFrame([(1, 0, "Guten Tag", None), (1, 1, "boom", None), (1, 2, "[1] ref", "references"), (2, 0, "x", None)], "doc_id long, k long, p string, label string")

    def rule(p):
        if "boom" in p:
            raise ValueError("no")
        return "JOIN: 2, 3" if p.startswith("Which") else p.split("\n", 1)[1].upper()

    backend = models.Replay(rule=rule)
    got = {(r.doc_id, r.k): r.target for r in models.translate(rows, backend, "English").collect()}
    assert got == {(1, 0): "GUTEN TAG", (1, 1): "[translation failed]", (1, 2): "[1] ref", (2, 0): "X"}
    assert [(r.doc_id, r.joins) for r in models.split_by_model(rows.where("p <> 'boom'"), backend).collect()] == [(1, [2, 3])]
    done = rows.selectExpr("doc_id", "k", "p", "label", "case when k = 0 then p else 'はい' end target")
    again = {(r.doc_id, r.k): r.target for r in models.retranslate(done, models.Replay(rule=lambda p: "はい"), "ja", "Japanese").collect()}
    assert set(again.values()) == {"はい"}


def test_page_structure_drops_what_it_cannot_read(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (3, 0, "boom")], "doc_id long, k long, p string")

    def rule(p):
        if "boom" in p:
            raise ValueError("no")
        return 'So: {"exclude": [1, 9, -1], "merge": [[0, 1], [0], [1, 7]], "join": null}' if "] b" in p else "no object here"

    got = {r.doc_id: (r.exclude, r.merge, r.join, r.error is None) for r in models.page_structure(rows, models.Replay(rule=rule)).collect()}
    assert got == {1: ([1], [[0, 1]], [], True), 2: ([], [], [], True), 3: ([], [], [], False)}


def test_figure_numbers(spark):
    rows = spark.createDataFrame([(1, "S3-A"), (2, "none"), (3, "")], "c long, text string")
    answer = models.Replay(rule=lambda p: "no idea" if p.endswith("none") else json.dumps({"figure_number": p.split("\n")[1]}))
    assert {r.c: r.number for r in models.figure_numbers(rows, answer, "c").collect()} == {1: "s3a", 2: None, 3: None}


def test_chosen_sentences_keep_their_target_when_the_call_fails(spark):
    rows = spark.createDataFrame([(1, 0, "a", "old"), (1, 1, "b", "old"), (1, 2, "c", None)], "doc_id long, k long, p string, target string")
    backend = models.Replay(known={"Translate into French.\nx = y\nDo not answer as before: old\na": " new "})
    got = {r.k: r.target for r in models.retranslate_chosen(rows, rows, {"x": "y"}, backend, "French").collect()}
    assert got == {0: "new", 1: "old", 2: None}


@pytest.mark.parametrize(
    "text,copied,places",
    [
        ("One is here. Two is there. One is here.", "One is here.|Two is there.|One is here.", [0, 13, 27]),
        ("  One is here. Two.", "One is here.|  |Two.", [0, 15]),
        ("One is. Two  is\nthere now.", "One is.|Two is there now.", [0, 8]),
        ("One is. Twofold are they.", "One is.|Twofo was it.|Three.", [0, 8]),
        ("One.", "Nothing.|One.", [0]),
        ("", "", []),
        (None, "a", None),
    ],
)
def test_realigned(spark, text, copied, places):
    row = spark.createDataFrame([(copied, text)], "copied string, text string").select(align.realigned(F.col("copied"), F.col("text")).alias("x")).first()
    assert (row.x or None) == (places or None)
