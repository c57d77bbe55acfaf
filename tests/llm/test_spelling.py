"""Spelling variants against all pairs on small tables: anagrams, repeated letters, chains, ties, long words, nulls."""

import random

import pytest

from vellum.llm import spelling
from vellum.llm.common import Scratch
from vellum.llm.queries import queries


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, times=2):
    forms, out = {}, {}
    for w, n in counts.items():
        around = [(-counts[v], v) for v in counts if near(w, v)]
        best = min(around, default=None)
        forms[w] = best[1] if best and n > 0 and -best[0] >= times * n else None
        out[w] = (len(around), -best[0] if forms[w] else None)
    rows = set()
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.add((w, forms[w], root, n, *out[w]))
    return rows


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, "word string, n long, key string").repartition(3)  # a name that clashes
    return [tuple(r) for r in spelling.variants(df, Scratch(spark, "t"), **how).collect()]


@pytest.mark.parametrize("letters,longest,many,seed", [("ab", 6, 120, 1), ("abc", 7, 400, 2), ("aéÿz", 5, 300, 3), ("a", 40, 40, 4), ("a😀b一", 5, 200, 5)])
def test_all_pairs(spark, letters, longest, many, seed):
    r = random.Random(seed)
    counts = {"".join(r.choice(letters) for _ in range(r.randint(1, longest))): r.choice([1, 1, 2, 3, 4, 8, 16, 33]) for _ in range(many)}
    got = found(spark, [(w, n, "x") for w, n in counts.items()])
    assert len(got) == len(counts) and set(got) == brute(counts)


def test_nulls_repeats_chains_and_long_words(spark):
    long = "ab" * 6_000
    rows = [(None, 5, "x"), ("", 5, "x"), ("cat", 1, "x"), ("cat", 2, "x"), ("cats", 6, "x"), ("carts", 12, "x"), ("carets", 24, "x"), ("dog", None, "x"), ("dogs", 4, "x"), (long, 2, "x"), (long + "c", 9, "x"), (long[::-1], 1, "x")]
    counts = {"cat": 3, "cats": 6, "carts": 12, "carets": 24, "dog": 0, "dogs": 4, long: 2, long + "c": 9, long[::-1]: 1}
    got = found(spark, rows)
    assert len(got) == len(counts) and set(got) == brute(counts)
    assert {w: root for w, _, root, *_ in got}["cat"] == "carets"
    assert found(spark, [], times=3) == []
    with pytest.raises(ValueError):
        found(spark, [], times=1)


def test_many_anagrams_meet_by_their_halves(spark):
    """All orders of seven letters: one key, 5040 words, and no word near another but through the words that are added."""
    from itertools import permutations

    words = ["".join(p) for p in permutations("abcdefg")]
    near_rows = spelling.near_words(spark.createDataFrame([(w, 1) for w in [*words, "abcdef", "abcdefh"]], "word string, n int").withColumn("key", spelling.anagram_key(spelling.F.col("word"))))
    assert sorted((r["word"], r["near"]) for r in near_rows.collect()) == sorted(
        [("abcdef", w) for w in words + ["abcdefh"] if near("abcdef", w)] + [(w, "abcdef") for w in words + ["abcdefh"] if near("abcdef", w)] + [("abcdefh", w) for w in words if near("abcdefh", w)] + [(w, "abcdefh") for w in words if near("abcdefh", w)]
    )


def test_query(spark, tmp_path):
    import re
    import zlib
    from collections import Counter

    r = random.Random(9)
    words = ["Garden", "garden", "gardens", "Übung", "übung", "éclair", "eclair", "house", "horse", "tiny", "mother", "smother"]
    rows = [(None if i % 50 == 0 else i, None if i % 9 == 0 else "" if i % 10 == 0 else ", ".join(r.choices(words, k=30))) for i in range(300)]
    rows += [rows[5], (400, "garden " * 3000), (401, "z" * 70_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            k = h % len(w)
            counts[w[:k] + w[k + 1 :] if h % 97 == 0 else w] += 1
    got = [tuple(x) for x in queries()["op13_spelling_variants"](spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    assert len(got) == len(want) and set(got) == want


def test_nothing_listed_is_gathered_to_be_sent_around(spark):
    """Spark sizes exploded rows by the table they come from: on check_l it broadcast 2.2 GB that it took for less than 10 MB."""
    words = spark.sql("select * from values ('house', 3L), ('horse', 4L) as t(word, n)").withColumn("key", spelling.anagram_key(spelling.F.col("word")))
    plan = spelling.near_words(words)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
