"""Neighbours in long ranges of names."""

import random

from vellum.operators import nearest


def test_every_window_looks_back(spark):
    """A frame to the end of a range is read anew for each row, with the square of the range's rows."""
    asked = spark.createDataFrame([("a", "m", 1)], "key string, name string, id long")
    listed = spark.createDataFrame([("a", "n", 1)], "key string, name string, item long")
    plan = nearest.beside(asked, listed)._jdf.queryExecution().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_neighbours_of_equal_names(spark):
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 4)))
    asked = [(rng.choice("xyz"), name(), i) for i in range(300)]
    listed = [(rng.choice("xy"), name(), rng.randint(0, 9)) for _ in range(60)]
    got = nearest.beside(spark.createDataFrame(asked, "key string, name string, id long"), spark.createDataFrame(listed, "key string, name string, item long")).collect()
    pair = lambda r: tuple(r) if r else None
    of = lambda key: sorted((n, i) for k, n, i in listed if k == key)
    want = {i: (max((x for x in of(k) if x[0] < n), default=None), min((x for x in of(k) if x[0] >= n), default=None)) for k, n, i in asked}
    assert {r.id: (pair(r.below), pair(r.above)) for r in got} == want
