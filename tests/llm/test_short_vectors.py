"""Embedding near-dedup of vectors with fewer components than blocks."""

import math
import random

import pytest

from vellum.llm.common import Scratch
from vellum.llm.near_vectors import near_vectors


@pytest.mark.parametrize("dims", [(1, 2, 3), (4, 5, 6, 7)])
def test_links_of_short_vectors(spark, dims):
    rng, rows = random.Random(11), []
    for dim in dims:
        for _ in range(12):
            base = [rng.gauss(0, 1) for _ in range(dim)]
            for _ in range(4):
                rows.append((len(rows), "a", [x + rng.gauss(0, 0.12) for x in base]))
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    cos = lambda a, b: sum(x * y for x, y in zip(unit(a), unit(b), strict=True))
    want = {i: sum(j != i and len(v) == len(w) and cos(v, w) >= 0.98 for j, _, w in rows) for i, _, v in rows}
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    assert {r.vec_id: r.n_links for r in near_vectors(df, Scratch(spark, "short")).collect()} == want
