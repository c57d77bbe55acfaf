"""A saved state of each key, then what has changed since, until the key's last event; in batch and on a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

#: Kinds of events after which a key is closed (fixed values).
TERMINAL = ("done", "error", "cancelled")
_STATE = StructType([StructField("seq", LongType()), StructField("value", StringType()), StructField("n", LongType()), StructField("shown", BooleanType()), StructField("closed", BooleanType())])
_OUT = "n long, seq long, kind string, value string"


def snapshot_then_deltas(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows (key, n, seq, kind, value) of events (key, seq, kind, value) after snapshots (key, seq, kind, value), n from 0.

    A key that has events shows its snapshot first, as kind `snapshot`, then its events of a higher seq, up to and with the first whose kind is
    terminal. A snapshot whose kind is terminal is closed: nothing follows. Of events with one seq one counts, the least kind and value. A
    key without a snapshot shows its events from the beginning. Rows without a key or a seq are left out.
    """
    one = events.where("key is not null and seq is not null").groupBy("key", "seq").agg(F.min(F.struct("kind", "value")).alias("e"))
    known = snapshots.where("key is not null and seq is not null").groupBy("key").agg(F.max(F.struct("seq", "kind", "value")).alias("s"))
    x = one.join(known, "key", "left").select("key", "seq", "e", "s", F.coalesce(F.col("s.kind").isin(*TERMINAL), F.lit(False)).alias("closed"))
    news = x.where(~F.col("closed") & (F.col("s").isNull() | (F.col("seq") > F.col("s.seq")))).select("key", "seq", "e.kind", "e.value", F.col("s").isNotNull().cast("long").alias("base"))
    order = W.partitionBy("key").orderBy("seq")
    ended = F.max(F.col("kind").isin(*TERMINAL).cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1))
    news = news.withColumn("ended", F.coalesce(ended, F.lit(0))).where("ended = 0").withColumn("n", F.row_number().over(order).cast("long") - 1 + F.col("base"))
    first = x.where("s is not null").groupBy("key").agg(F.first("s").alias("s")).select("key", F.lit(0).cast("long").alias("n"), "s.seq", F.lit("snapshot").alias("kind"), "s.value")
    return first.unionByName(news.select("key", "n", "seq", "kind", "value"))


class _Follow(StatefulProcessor):
    def __init__(self, forget_ms: int | None) -> None:
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", _STATE, self.forget_ms)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        old = self.state.get() if self.state.exists() else None
        if old is None or (initialState.seq, initialState.kind, initialState.value) > (old[0], "", ""):
            self.state.update((initialState.seq, initialState.value, 0, False, initialState.kind in TERMINAL))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        seq, value, n, shown, closed = tuple(self.state.get()) if self.state.exists() else (None, None, 0, True, False)
        was = (seq, n, shown, closed)
        if not shown:
            yield Row(key=key[0], n=n, seq=seq, kind="snapshot", value=value)
            n, shown = n + 1, True
        if not closed:
            for r in sorted(rows, key=lambda r: (r.seq, r.kind is not None, r.kind or "", r.value is not None, r.value or "")):
                if seq is not None and r.seq <= seq:
                    continue
                yield Row(key=key[0], n=n, seq=r.seq, kind=r.kind, value=r.value)
                seq, value, n, closed = r.seq, r.value, n + 1, r.kind in TERMINAL
                if closed:
                    break
        if (seq, n, shown, closed) != was:
            self.state.update((seq, value if not closed else None, n, shown, closed))

    def close(self) -> None:
        pass


def follow(events: DataFrame, snapshots: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """`snapshot_then_deltas` on a stream of events, in append mode: the same rows if each key's events come in order of seq over the micro-batches.

    The snapshots are the initial state; a key shows its own with its first event. An event that comes again, or late, is not shown twice.
    A closed key keeps a few numbers, so that nothing more is shown of it; with `forget_ms` a key of which nothing was heard for so
    long is forgotten. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    kind = events.schema["key"].dataType.simpleString()
    begun = snapshots.where("key is not null and seq is not null").groupBy("key").agg(F.max(F.struct("seq", "kind", "value")).alias("s")).select("key", "s.seq", "s.kind", "s.value")
    rows = events.where("key is not null and seq is not null").select("key", "seq", "kind", "value")
    mode = "none" if forget_ms is None else "processingTime"
    return rows.groupBy("key").transformWithState(_Follow(forget_ms), f"key {kind}, {_OUT}", "append", mode, begun.groupBy("key"))
