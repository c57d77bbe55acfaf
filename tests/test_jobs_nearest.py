"""Neighbours in an order of names, folders of jobs that are stopped half-way, JSON in answers."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import nearest
from vellum.sources.jobs import JobFolder


def common(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("keys,seed", [(["a"], 1), (["a", "b", "c", "d"], 2)])
def test_longest_prefix(spark, keys, seed):
    """One key over several ranges, and several keys to a range; ties fall to the first name, then the least item."""
    r = random.Random(seed)
    name = lambda: "".join(r.choices("abc", k=r.randint(0, 6)))
    listed = [(r.choice(keys), name(), i) for i in range(40)]
    asked = [(r.choice([*keys, "none"]), name(), i) for i in range(80)]
    got = nearest.longest_prefix(spark.createDataFrame(asked, "key string, name string, id long").repartition(3), spark.createDataFrame(listed, "key string, name string, item long")).collect()
    want = {}
    for k, n, i in asked:
        best = min(((-common(n, m), m, item) for kk, m, item in listed if kk == k), default=None)
        want[i] = (best[2], -best[0]) if best else (None, None)
    assert {x.id: (x.item, x.shared) for x in got} == want and len(got) == len(asked)


def test_folders(spark):
    asked = spark.createDataFrame([(1, "m/a/q4", "net-7b"), (2, "m/a", "net-7b"), (3, "m/b/q4", "net"), (4, "m", "x"), (5, "z", "y"), (6, "a/b/c", "x")], "id long, folder string, name string")
    listed = spark.createDataFrame([("m/a", "net-7", 10), ("m/a", "net-13b", 11), ("m", "zzz", 12), ("m/a/q4", "other", 13)], "key string, name string, item long")
    got = {x.id: (x.item, x.tier) for x in nearest.best_in_folders(asked, listed).collect()}
    assert got == {1: (13, 0), 2: (10, 0), 3: (None, None), 4: (12, 0), 5: (None, None), 6: (None, None)}
    up = {x.id: (x.item, x.tier) for x in nearest.best_in_folders(asked, listed.where("item <> 13")).collect()}
    assert up[1] == (10, 1)
    assert nearest.best_in_folders(asked.where("false"), listed).count() == 0
    assert nearest.best_in_folders(asked, listed.where("false")).where("item is null").count() == 6


# --------------------------------------------------------------------------- jobs

KIND = "job string, n long"


def rows(folder):
    return sorted((x.job, x.n) for x in folder.read("n long").collect())


def test_jobs_are_replaced_and_deleted(spark, tmp_path):
    f = JobFolder(spark, str(tmp_path / "jobs"))
    f.replace(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], KIND))
    f.replace(spark.createDataFrame([("b", 30), ("d", 5)], KIND))
    f.delete(["c", "unknown"])
    f.recover()
    assert rows(f) == [("a", 1), ("a", 2), ("b", 30), ("d", 5)]
    for wrong in ("../x", "", "a/b"):
        with pytest.raises(ValueError):
            f.delete([wrong])
    with pytest.raises(ValueError):
        f.replace(spark.createDataFrame([(None, 1)], KIND))
    f.replace(spark.createDataFrame([], KIND))
    assert len(rows(f)) == 4


class Stop(Exception):
    pass


@pytest.mark.parametrize("moves", range(6))
def test_a_stop_between_any_two_moves(spark, tmp_path, moves):
    """Of a complete run every job is the new one after recovery; other jobs are as they were."""
    f = JobFolder(spark, str(tmp_path / "jobs"))
    f.replace(spark.createDataFrame([("a", 1), ("b", 2), ("z", 9)], KIND))
    left, move = [moves], f._move

    def stopping(source, target):
        if not left[0]:
            raise Stop
        left[0] -= 1
        move(source, target)

    f._move = stopping
    new = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30)], KIND)
    if moves < 5:  # two moves for a and b each, one for c
        with pytest.raises(Stop):
            f.replace(new)
    else:
        f.replace(new)
    seen = {j for j, _ in rows(f)} if (tmp_path / "jobs").exists() else set()
    assert "z" in seen
    again = JobFolder(spark, str(tmp_path / "jobs"))
    again.recover()
    assert rows(again) == [("a", 10), ("b", 20), ("c", 30), ("z", 9)]
    assert sorted(p.name for p in (tmp_path / "jobs").iterdir() if p.name.startswith("_") and p.name != "_SUCCESS") == []


def test_a_stop_while_writing_or_deleting(spark, tmp_path):
    f = JobFolder(spark, str(tmp_path / "jobs"))
    f.replace(spark.createDataFrame([("a", 1), ("b", 2)], KIND))
    spark.createDataFrame([("a", 7)], KIND).write.partitionBy("job").parquet(f"{f.path}/_staged/half")
    (tmp_path / "jobs/_staged/half/_SUCCESS").unlink()  # as if the writer had been stopped
    f._purge = lambda: (_ for _ in ()).throw(Stop())
    with pytest.raises(Stop):
        f.delete(["b"])
    assert rows(f) == [("a", 1)]  # gone at once, whatever is left aside
    again = JobFolder(spark, f.path)
    again.recover()
    assert rows(again) == [("a", 1)]


def test_json_answers(spark):
    texts = {
        'x {"a": 1} y': 1, '{"a": 2} and {"a": 3}': 2, '{"a": {"a": 4} oops': 4, "{broken}": None, "none": None, "": None, None: None, '{bad} {"a": 5}': None, '```json\n{"a":\n 6}\n```': 6, '{"l": [{"a": 1}], "a": 7}': 7,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.try_variant_get(T.json_answer(F.col("t")), "$.a", "long").alias("a"))
    assert {x.t: x.a for x in df.collect()} == texts
