"""Joins on pages against plain comparisons of all pairs, labels branch by branch, bundles, and commits that survive a restart."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum import plans
from vellum.operators import graph, labels, layout
from vellum.sources import jobs


def is_near(a, b):
    h = max(min(a[5] - a[3], b[5] - b[3]), 1.0)
    return max(a[3], b[3]) - min(a[5], b[5]) <= 0.8 * h and max(a[2], b[2]) - min(a[4], b[4]) <= 1.5 * h


def test_near_boxes_of_any_height(spark):
    rng = random.Random(2)
    rows = [(0, 0, 0.0, 0.0, 50.0, 300.0), (0, 1, 0.0, 500.0, 50.0, 800.0), (0, 2, 0.0, 1100.0, 10.0, 1100.0)]
    rows += [(1, i, x, y, x + rng.uniform(0, 60), y + rng.choice([0.0, 3.0, 40.0, 400.0])) for i in range(80) for x, y in [(rng.uniform(0, 900), rng.choice([64.0, 128.0, rng.uniform(0, 2000)]))]]
    df = spark.createDataFrame(rows, "doc_id long, line_no long, x0 double, y0 double, x1 double, y1 double")
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and is_near(a, b))
    assert sorted(map(tuple, layout.near_pairs(df).collect())) == want and (0, 0, 1) in want


def test_overlaps_meet_once(spark):
    rng = random.Random(4)
    make = lambda n: [(d, i, s, s + rng.randint(1, 900)) for d in (1, 2) for i in range(n) for s in [rng.randint(0, 3000)]]
    a, b = make(40), make(30)
    x, y = spark.createDataFrame(a, "doc_id long, i long, s long, e long"), spark.createDataFrame(b, "doc_id long, k long, ls long, le long")
    got = layout.overlapping(x, y, "doc_id", "s", "e", "ls", "le", 200).select("doc_id", "i", "k").collect()
    assert sorted(map(tuple, got)) == sorted((p[0], p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[3] > q[2] and p[2] < q[3])


def test_roots_of_any_edges(spark):
    rng = random.Random(9)
    edges = [(d, rng.randrange(200), rng.randrange(210)) for d in ("a", "b") for _ in range(150)]
    want = {}
    for d in ("a", "b"):
        root = {i: i for i in range(200)}
        for _ in range(200):
            for x, a, b in edges:
                if x == d and b < 200:
                    root[a] = root[b] = min(root[a], root[b])
        want |= {(d, i): r for i, r in root.items()}
    nodes = spark.createDataFrame([(d, i) for d in ("a", "b") for i in range(200)], "doc_id string, node long")
    got = graph.merge_roots(spark, nodes, spark.createDataFrame(edges, "doc_id string, a long, b long"))
    assert {(r.doc_id, r.node): r.root for r in got.collect()} == want


@pytest.mark.parametrize(
    "text,ratio,bold,want",
    [
        ("Abstract.", 1.0, False, "abstract_heading"), ("要旨", 1.0, False, "abstract_heading"), ("Data availability", 1.3, True, "heading"), ("参考文献", 1.0, False, "heading"),
        ("Fig. 3. Cells", 1.2, True, "caption"), ("A title", 1.05, True, "title"), ("A title", 1.10, False, "title"), ("A title", 1.09, False, None),
        ("Short bold line", 1.0, True, "subheading"), ("Short bold line.", 1.0, True, None), ("Results should follow", 1.0, True, None), ("結果を示す", 1.0, True, "subheading"), ("A part 示 B", 1.0, True, None),
        ("Correspondence: Ann", 1.0, False, "contact"), ("write to a.b@c.org", 1.0, False, "contact"), ("¹ University of X", 1.0, False, "affiliation"), ("1. University of X", 1.0, False, None),
        ("†Faculté de Y", 1.0, False, "affiliation"), ("Ann Foo¹, Bo Bar², Cy Baz³", 1.0, False, "authors"), ("Table encodes Foo¹, Bar², Baz³", 1.0, False, None),
        ("Foo¹ Should², Bar², Baz³", 1.0, False, "authors"), ("foo¹, bar², baz³", 1.0, False, None), ("", 1.0, False, None),
    ],
)
def test_labels(spark, text, ratio, bold, want):
    df = spark.createDataFrame([(text, ratio, bold)], "text string, ratio double, bold boolean")
    assert df.select(labels.font_labels(F.col("text"), F.col("ratio"), F.col("bold"))).first()[0] == want


def test_all_labels_occur(spark):
    got = {r.label for r in plans.queries()["h10_heading_labels"](spark, "/root/testdata/sf0.001").select("label").distinct().collect()}
    assert got == {None, "abstract_heading", "heading", "caption", "title", "subheading", "contact", "affiliation", "authors"}


def test_harness_lines(spark):
    rows = [(1, 1, "boldly told", "Times-Bold", 12.0), (1, 1, "x", "Times", 8.0), (1, 1, " ", "Times", 99.0), (1, 2, "abc", "Times", 9.0), (1, 2, "abc", "TimesBOLD", 10.0), (1, 3, " ", "Bold", 10.0)]
    got = layout.plain_lines(spark.createDataFrame(rows, "doc_id long, line_no long, text string, font string, size double")).collect()
    assert sorted((r.line_no, r.size, r.bold, r.italic) for r in got) == [(1, 10.0, True, False), (2, 9.5, False, False)]


def bundle(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def test_bundle_id_is_the_states_own():
    state = json.dumps({"id": "own"})
    assert jobs.open_bundle(bundle(**{"job1/state.json": state, "job1/p.jpg": "x", "beside.txt": "y"})) == ("own", {"state.json": state.encode(), "p.jpg": b"x"})
    assert jobs.open_bundle(bundle(**{"state.json": state}))[0] == "own"
    assert jobs.open_bundle(bundle(**{"job1/state.json": "{}"}))[0] == "job1"
    for bad in ({"state.json": "{}"}, {"a/b/state.json": state}, {"a/state.json": state, "b/state.json": state}, {"a/state.json": state, "a/../../x": "y"}, {"state.json": "{"}, {"state.json": json.dumps({"id": "../x"})}):
        with pytest.raises(ValueError):
            jobs.open_bundle(bundle(**bad))


def test_commits_survive_a_restart(spark, tmp_path):
    """Each micro-batch of pages replaces the jobs that it has; a stream that starts again goes on behind the last commit."""
    source, target, seen = tmp_path / "pages", tmp_path / "jobs", []
    source.mkdir()
    put = lambda name, rows: (source / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))

    def commit(batch, number):
        seen.append(number)
        jobs.replace_jobs(batch.select("id", "filename", "status"), str(target))

    def go():
        stream = spark.readStream.schema("id string, filename string, status string").option("maxFilesPerTrigger", 1).json(str(source))
        q = stream.writeStream.foreachBatch(commit).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    put("1", [{"id": "a", "filename": "a.pdf", "status": "running"}, {"id": "b", "filename": "b.pdf", "status": "running"}])
    go()
    put("2", [{"id": "a", "filename": "a.pdf", "status": "done"}])
    go()
    go()
    got = {(r.id, r.status) for r in spark.read.schema("id string, status string").json(str(target)).select("id", "status").collect()}
    assert got == {("a", "done"), ("b", "running")} and seen == [0, 1]
