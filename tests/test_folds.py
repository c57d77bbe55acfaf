"""Order-dependent folds, which have no SQL form."""

from vellum.operators import layout, runs


def test_first_spans(spark):
    rows = [(1, 0, 10, "a"), (1, 5, 20, "b"), (1, 12, 15, "c"), (1, 15, 16, "d"), (2, 3, 4, "e")]
    df = spark.createDataFrame(rows, "key long, start long, end long, tag string")
    # b overlaps a and is skipped; c overlaps only the skipped b and stays
    assert sorted(r.tag for r in runs.first_spans(df).collect()) == ["a", "c", "d", "e"]


def test_boxes_merge_to_a_fixpoint(spark):
    boxes = [(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 60.0, 0.0, 70.0, 10.0), (1, 2, 20.0, 0.0, 50.0, 10.0), (1, 3, 0.0, 90.0, 10.0, 100.0), (2, 0, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(boxes, "doc_id long, line_no long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.doc_id, r.first_line, r.boxes, r.x0, r.x1) for r in layout.merge_near_boxes(df).collect())
    assert got == [(1, 0, 3, 0.0, 70.0), (1, 3, 1, 0.0, 10.0), (2, 0, 1, 0.0, 1.0)]


def test_near_pairs(spark):
    boxes = [(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 12.0, 0.0, 20.0, 10.0), (1, 2, 0.0, 19.0, 10.0, 29.0)]
    df = spark.createDataFrame(boxes, "doc_id long, line_no long, x0 double, y0 double, x1 double, y1 double")
    assert [(r.a, r.b) for r in layout.near_pairs(df).collect()] == [(0, 1)]
