"""Queries over texts longer than the bounds that they once had: nothing of a long document is left out."""

from vellum import plans
from vellum.operators import layout


def run(spark, tmp_path, name, **tables):
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
    return plans.queries()[name](spark, str(tmp_path))


def documents(spark, *texts):
    return spark.createDataFrame([(i, t, "en", f"src{i % 2}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_components_of_all_lines(spark, tmp_path):
    docs = documents(spark, "\n".join(["abc"] * 100), "\n".join(["abcd"] * 90 + ["abc"] * 10))
    got = {(r.doc_id, r.node): r.root for r in run(spark, tmp_path, "g7_components", documents=docs).collect()}
    assert got == {(0, i): 0 for i in range(100)} | {(1, i): min(i, 90) for i in range(100)}
    got = {(r.doc_id, r.node): r.root for r in run(spark, tmp_path, "g7_guarded_merge", documents=docs).collect()}
    # the whole first page would be one component, so its merge is ignored
    assert got == {(0, i): i for i in range(100)} | {(1, i): min(i, 90) for i in range(100)}


def test_boxes_of_all_lines(spark, tmp_path):
    got = run(spark, tmp_path, "g8_box_clusters", documents=documents(spark, "\n".join(["a" * 90] * 100))).collect()
    assert [(r.first_line, r.boxes, r.y1) for r in got] == [(0, 100, 82.0 + 49 * 14.0 + 10.0)]


def test_boxes_like_pairwise_merging(spark):
    import random

    def near(a, b):
        h = max(min(a[3] - a[1], b[3] - b[1]), 1.0)
        return max(a[1], b[1]) - min(a[3], b[3]) <= 0.8 * h and max(a[0], b[0]) - min(a[2], b[2]) <= 1.5 * h

    rng, rows, want = random.Random(3), [], []
    for doc in range(20):
        page = []
        for i in range(60):
            x, y = rng.uniform(0, 900), rng.uniform(0, 900)
            page.append((x, y, x + rng.uniform(1, 40), y + rng.uniform(0.5, 30), i, 1))
            rows.append((doc, i, *page[-1][:4]))
        while pair := next(((a, b) for a in page for b in page if a is not b and near(a, b)), None):
            a, b = pair
            page = [p for p in page if p is not a and p is not b] + [(min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), min(a[4], b[4]), a[5] + b[5])]
        want += [(doc, *p[4:], *p[:4]) for p in page]
    df = spark.createDataFrame(rows, "doc_id long, line_no long, x0 double, y0 double, x1 double, y1 double")
    assert sorted(map(tuple, layout.merge_near_boxes(df).collect())) == sorted(want) and len(want) > 100


def test_all_pieces(spark, tmp_path):
    first = [f"Sentence {i} is here. " for i in range(30)]
    second = [f"Other {i} is there. " for i in range(30)]
    docs = documents(spark, "".join(first), "".join(second))
    events = spark.createDataFrame([(0, 9), (1, 3)], "event_id long, user_id long")
    ask = lambda name, **more: run(spark, tmp_path, name, documents=docs, **more).collect()
    # the last piece ends with the text
    assert {r.doc_id: r.text for r in ask("d21_ordered_text")} == {0: "|".join(first), 1: "|".join(second)}
    assert {r.doc_id: r.listing for r in ask("h2_piece_listing")} == {i: "\n".join(f"[{k + 1}] {p.strip()}" for k, p in enumerate(ps)) for i, ps in enumerate((first, second))}
    assert {(r.doc_id, r.k): r.glued for r in ask("c16_join_set", events=events)} == {(i, k): (i, k) in {(0, 2), (1, 3)} for i in (0, 1) for k in range(30)}
    assert {(r.doc_id, r.k): r.target for r in ask("c8_stitch_write_back")} == {(0, k): p for k, p in enumerate(first)} | {(1, k): p for k, p in enumerate([first[0], *second[1:]])}


def test_pairs_of_the_whole_text(spark, tmp_path):
    from vellum.plans.texts import QUESTION, SCORE

    docs = documents(spark, "z" * 900 + QUESTION.upper() + "z" * 900, "z" * 900, "", "zz how zz")
    docs = docs.unionByName(docs.limit(1).selectExpr("9L doc_id", "cast(null as string) text", "lang", "source", "n_chars"))
    got = {r.doc_id: r.shared for r in run(spark, tmp_path, "g5_bigram_sets", documents=docs).collect()}
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    assert got == {0: len(SCORE), 1: 0, 2: 0, 3: len(set(SCORE) & grams("zz how zz")), 9: 0}


def test_all_jobs_newest_first(spark, tmp_path):
    events = spark.createDataFrame([(i, None if i % 5 == 0 else float(i * 37 % 101)) for i in range(300)], "event_id long, value double")
    got = [(r.event_id, r["rank"]) for r in run(spark, tmp_path, "f3_jobs_newest_first", events=events.repartition(4)).collect()]
    at = lambda i: float(i * 37 % 101) if i % 4 and i % 5 else 0.0
    assert got == [(i, n) for n, i in enumerate(sorted(range(300), key=lambda i: (-at(i), i)), 1)]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_signatures_see_every_row(spark, tmp_path):
    rows = [(i, "t", "en", f"src{i % 2}", 5) for i in range(40)]
    ask = lambda rows: {r.source: r.signature for r in run(spark, tmp_path, "h30_signature", documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)).collect()}
    first = ask(rows)
    assert ask(rows[::-1]) == first
    changed = [ask([*rows[:4], (4, "t", "en", "src0", n), *rows[5:]]) for n in (6, None)] + [ask([*rows, rows[0], rows[0]]), ask(rows[1:])]
    assert all(c["src0"] != first["src0"] and c["src1"] == first["src1"] for c in changed[:2] + changed[3:]) and changed[2]["src0"] != first["src0"]
    assert "collect_list" not in plan_of(plans.queries()["h30_signature"](spark, str(tmp_path)))


def test_appended_pages_are_numbered_in_ranges(spark, tmp_path):
    docs = documents(spark, *["t"] * 101)
    df = run(spark, tmp_path, "g2_append_renumbered", documents=docs.repartition(4))
    assert {r.doc_id: r.page_no for r in df.collect()} == {2 * i + 1: 101 + i for i in range(50)}
    assert "book" not in plan_of(df)


def test_first_spans_of_a_hot_key(spark):
    import random

    from vellum.operators import runs

    rng = random.Random(5)
    rows = [(k, s, s + rng.randrange(0, 9), rng.choice("abc")) for k in (1, 2, None) for s in (rng.randrange(200) for _ in range(600))]
    want = []
    for k in (1, 2, None):
        at = 0
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:]):
            if r[1] >= at:
                at = r[2]
                want.append(r)
    df = runs.first_spans(spark.createDataFrame(rows, "key long, start long, end long, tag string"))
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
    assert "collect_list" not in plan_of(df)
