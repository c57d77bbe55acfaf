"""The n-gram join's links against a count over all pairs of rows."""

import random

import pytest

from vellum.llm import ngram_join, ngram_links
from vellum.llm.common import Scratch


def shingles(text):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    w = (text or "").encode().translate(low).split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Of each row its id, set size, component and links; rows without an id or words link with nothing."""
    sets = [shingles(t) if i is not None else set() for i, t in rows]
    linked = lambda a, b: bool(sets[a]) and a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    near = [[b for b in range(len(rows)) if linked(a, b)] for a in range(len(rows))]
    least, before = [i for i, _ in rows], None
    while least != before:
        before, least = least, [min([least[a], *(least[b] for b in near[a])]) if near[a] else least[a] for a in range(len(rows))]
    return sorted(((i, len(shingles(t)), least[k], len(near[k])) for k, (i, t) in enumerate(rows)), key=lambda r: tuple(-1 if x is None else x for x in r))


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = ngram_join.ngram_join(df, Scratch(spark, "t"))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    return sorted((tuple(r) for r in out.collect()), key=lambda r: tuple(-1 if x is None else x for x in r))


def families(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    texts = [None, "", " \t", "one", "One", "a b c d"]
    for size in (9, 40, 150):
        base = [word() for _ in range(size)]
        for k in range(14):
            t = list(base)
            for _ in range(k % 5):
                t[r.randrange(size)] = word()
            texts += [" ".join(t[: size - k // 3])] * r.choice([1, 1, 3])
    base = [f"c{k}" for k in range(120)]  # a chain: neighbours are similar, ends are not
    for k in range(12):
        texts.append(" ".join(f"z{j}" if j % 9 == 4 and j // 9 < k else w for j, w in enumerate(base)))
    r.shuffle(texts)
    return [(7 * k + 3, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("side,shingles,cost", [(1024, 1 << 20, 1.0), (3, 1 << 20, 0.0), (2, 1 << 20, 1e9), (4, 200, 1.0)])
def test_links(spark, monkeypatch, side, shingles, cost):
    """In one tile, in tiles of lists, in tiles of components by size band, and with sides cut by their shingles."""
    for name, value in (("SIDE", side), ("SHINGLES", shingles), ("LISTED", cost), ("GROUP_BYTES", 5000)):
        monkeypatch.setattr(ngram_links, name, value)
    rows = families(side)
    assert got(spark, rows) == brute(rows)


def test_links_of_repeated_and_missing_ids(spark):
    t = [" ".join(f"w{k}" if k != cut else "x" for k in range(60)) for cut in (99, 59, 58, 30)]
    rows = [(5, t[0]), (5, t[0]), (5, t[1]), (5, "something else"), (None, t[0]), (None, None), (9, t[3]), (2, "something  ELSE"), (8, None), (8, "")]
    assert got(spark, rows) == brute(rows)


def test_links_of_nothing(spark):
    assert got(spark, []) == []
