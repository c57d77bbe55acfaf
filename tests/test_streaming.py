"""Streaming folds against their batch forms."""

import tempfile
import time

import pytest

from vellum import streaming
from vellum.streaming import snapshots


def test_visible_over_chunk_ends():
    carry, thinking, out = "", False, []
    for c in ["ab<thi", "nk>secret</th", "ink>cd"]:
        text, carry, thinking = streaming.visible(carry, thinking, c)
        out.append(text)
    assert "".join(out) + carry == "abcd"


def test_latest_on_a_stream(spark):
    src, schema = tempfile.mkdtemp(prefix="spark-"), "seq long, key long, value string"
    spark.createDataFrame([(1, 1, "a"), (3, 1, "c"), (2, 2, "b"), (2, 1, "x")], schema).write.mode("append").parquet(src)
    events = spark.readStream.schema(schema).parquet(src)
    q = streaming.latest(events, ["key"], "seq", "value").writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.key: r.value for r in spark.sql("select * from latest").collect()} == {1: "c", 2: "b"}


def test_think_filter_on_a_stream(spark):
    src, schema = tempfile.mkdtemp(prefix="spark-"), "conv_id long, seq long, chunk string"
    chunks = [(1, 0, "ab<thi"), (1, 1, "nk>secret</th"), (1, 2, "ink>cd<"), (1, 3, None), (2, 0, "plain")]
    spark.createDataFrame(chunks, schema).coalesce(1).write.mode("append").parquet(src)
    q = streaming.think_filter(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("append").format("memory").queryName("seen").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).start()
    q.processAllAvailable()
    q.stop()
    rows = sorted((r.conv_id, r.seq, r.text) for r in spark.sql("select * from seen").collect())
    assert "".join(t for c, _, t in rows if c == 1) == "abcd<" and rows[-1] == (2, 0, "plain")


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


KIND = "key long, seq long, kind string, value string"


def batch(spark, folder, part, snaps, forget_ms):
    """One micro-batch of a query that goes on from its checkpoint."""
    spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    q = snapshots.follow(spark.readStream.schema(KIND).parquet(f"{folder}/in"), snaps, forget_ms)
    q = q.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").start(f"{folder}/out")
    end = time.time() + 120  # a query that forgets runs on without data
    while not any(p.numInputRows for p in q.recentProgress):
        assert time.time() < end and q.exception() is None
        time.sleep(0.2)
    q.stop()


@pytest.mark.parametrize("forget_ms", [None, 3_600_000])
def test_snapshots_then_deltas_over_restarts(rocks, tmp_path, forget_ms):
    """Three micro-batches, the query started anew for each: the rows of the batch form."""
    spark = rocks
    snaps = spark.createDataFrame([(1, 5, "running", "s1"), (1, 3, "running", "older"), (2, 2, "done", "s2"), (4, 9, "running", "never heard of"), (None, 1, "x", "y"), (6, 1, "running", None)], KIND)
    parts = [
        [(1, 4, "token", "old"), (1, 6, "token", "a"), (1, 7, "token", "b"), (2, 3, "token", "no"), (3, 1, "token", "c"), (None, 1, "token", "x"), (5, None, "token", "x")],
        [(1, 7, "token", "b"), (1, 9, "done", "e"), (1, 10, "token", "too late"), (3, 2, "token", "d"), (3, 2, "token", "e"), (6, 4, "token", None)],
        [(1, 11, "token", "no"), (3, 3, "error", None), (3, 4, "done", "no"), (6, 4, "token", None), (6, 5, "cancelled", "z"), (7, 1, "token", "f")],
    ]
    for part in parts:
        batch(spark, tmp_path, part, snaps, forget_ms)
    got = sorted(map(repr, map(tuple, spark.read.parquet(f"{tmp_path}/out").select("key", "n", "seq", "kind", "value").collect())))
    whole = sorted(map(repr, map(tuple, snapshots.snapshot_then_deltas(spark.createDataFrame(sum(parts, []), KIND), snaps).collect())))
    assert got == whole and len(got) == 12
    assert "(1, 3, 9, 'done', 'e')" in got and "(2, 0, 2, 'snapshot', 's2')" in got and not any("(4," in x or "late" in x for x in got)


def test_forgotten_keys_begin_anew(rocks, tmp_path):
    snaps = rocks.createDataFrame([(1, 5, "running", "s")], KIND)
    batch(rocks, tmp_path, [(1, 6, "done", "a")], snaps, 1_000)
    time.sleep(3)
    batch(rocks, tmp_path, [(1, 6, "token", "b")], snaps, 1_000)
    assert sorted((r.n, r.kind) for r in rocks.read.parquet(f"{tmp_path}/out").collect()) == [(0, "snapshot"), (0, "token"), (1, "done")]
