"""The manifest against a plain recursion: several levels, nulls, ties, repeated rows, names that clash, wrong records."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vellum.llm import manifest as m
from vellum.llm.common import Scratch
from vellum.llm.queries import queries

SCHEMA = "id long, grp string, hash string, rest string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def tree(hashes, fanout):
    """The top hash, and for each leaf the hashes left and right of its own, level by level."""
    paths, own = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        runs = [hashes[k : k + fanout] for k in range(0, len(hashes), fanout)]
        for i, at in enumerate(own):
            run, k = runs[at // fanout], at % fanout
            paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            own[i] = at // fanout
        hashes = ["".join(r) for r in runs]
        hashes = [sha(x) for x in hashes]
    return hashes[0], paths


def brute(rows, fanout):
    groups = {}
    for i, g, h, rest in rows:
        groups.setdefault(g, []).append((i is not None, i or 0, h, str(rest)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    done = {g: tree([x[2] for x in sorted(groups[g])], fanout) for g in names}
    root, above = tree([done[g][0] for g in names], fanout)
    out = []
    for k, g in enumerate(names):
        for x, path in zip(sorted(groups[g]), done[g][1], strict=True):
            out.append((x[1] if x[0] else None, g, x[2], done[g][0], root, path + above[k]))
    return sorted(out, key=repr)


def spark_rows(spark, rows, **how):
    df = spark.createDataFrame([(i, g, h, g) for i, g, h, _ in rows], SCHEMA).repartition(3)
    got = m.manifest(df, Scratch(spark, "t"), **how).collect()
    return sorted(((r["id"], r["rest"], r["hash"], r["subroot"], r["root"], [tuple(p) for p in r["path"]]) for r in got), key=repr)


def records(seed, n, groups, spread):
    r = random.Random(seed)
    return [(None if r.random() < 0.05 else r.choice(spread(r)), r.choice(groups), sha(str(r.randrange(n))), None) for _ in range(n)]


@pytest.mark.parametrize(
    "rows,how",
    [
        (records(1, 90, [None, "", "a", "é", "z", "="], lambda r: range(200)), {"fanout": 3, "most": 4}),
        (records(2, 60, ["a"], lambda r: [-(2**63), 2**63 - 1, 0, 5]), {"fanout": 2, "most": 3}),
        (records(3, 40, ["a", "b"], lambda r: [7]), {"fanout": 16, "most": 2}),  # equal ids: ranked by hash
        ([(1, "a", sha("x"), None)] * 30 + [(2, "b", sha("x"), None)], {"fanout": 16, "most": 5}),  # equal rows: ranked by number
        ([(5, f"s{k}", sha(str(k)), None) for k in range(40)], {"fanout": 4, "most": 2}),  # lone leaves, many groups
        ([(9, None, sha("x"), None)], {}),
    ],
)
def test_trees(spark, rows, how):
    assert spark_rows(spark, rows, **how) == brute(rows, how.get("fanout", 16))


def test_empty_and_fanout(spark):
    assert m.manifest(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0
    with pytest.raises(ValueError):
        m.manifest(spark.createDataFrame([], SCHEMA), Scratch(spark, "t"), fanout=1)


def test_records_and_folding(spark):
    df = spark.createDataFrame([(1, "é:", None)], "a long, b string, c string")
    assert df.select(m.record(F.col("a"), F.col("b"), F.col("c"))).first()[0] == sha("1:1" + "3:é:" + "-")
    path = [("a", "b"), ("", ""), ("", "c")]
    got = spark.createDataFrame([("h", path)], f"h string, p {m._PATH}").select(m.folded(F.col("h"), F.col("p")), m.siblings(F.col("p"))).first()
    assert tuple(got) == (sha(sha(sha("ahb")) + "c"), "abc")


def test_query_finds_changed_texts(spark, tmp_path):
    """Nulls in every column, a very long text; the query's rows against the recursion."""
    import zlib

    rows = [(i, None if i % 7 == 0 else f"Text {i}" if i % 3 else f"text {i}", "en" if i % 4 else None, "s" if i % 5 else None, i if i % 6 else None) for i in range(60)]
    rows += [(None, "Without an id", "en", "s", 1), (70, "Long " * 200_000, "de", "", 1), (71, "", "de", "", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, t: sha("".join(map(field, (r[0], r[3], r[2], r[4], t))))
    want = {x[0]: x for x in brute([(r[0], r[3], leaf(r, r[1]), None) for r in rows], 16)}
    got = queries()["op12_merkle_manifest"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r[0]: r for r in rows}
    for g in got:
        r, (_, _, h, subroot, root, path) = by[g["doc_id"]], want[g["doc_id"]]
        other = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        h2 = leaf(r, r[1].lower() if other and r[1] is not None else r[1])
        for left, right in path:
            h2 = sha(left + h2 + right)
        assert (g["leaf"], g["subroot"], g["root"], g["proof_sha256"]) == (h, subroot, root, sha("".join(a + b for a, b in path)))
        assert (g["folded_root"], g["verified"]) == (h2, h2 == root)
    assert {r["verified"] for r in got} == {True, False}
