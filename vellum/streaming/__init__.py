"""Structured Streaming forms: the event fold and the think filter on chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPEN, CLOSE = "<think>", "</think>"


def latest(events: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """The value of the highest order number of each key; the same fold in batch and, in update mode, on a stream."""
    return events.groupBy(*key).agg(F.max(F.struct(order, value)).alias("m")).select(*key, f"m.{order}", f"m.{value}")


def before_terminal(events: DataFrame, key: str, order: str, kind: str, ends: tuple[str, ...]) -> DataFrame:
    """I4: events up to and with the first terminal one of each key."""
    end = events.where(F.col(kind).isin(*ends)).groupBy(key).agg(F.min(order).alias("last"))
    return events.join(end, key, "left").where(F.col("last").isNull() | (F.col(order) <= F.col("last"))).drop("last")


def _held(text: str, mark: str) -> int:
    """How many last characters may be the beginning of a mark."""
    return next((n for n in range(min(len(text), len(mark) - 1), 0, -1) if mark.startswith(text[-n:])), 0)


def visible(carry: str, thinking: bool, chunk: str) -> tuple[str, str, bool]:
    """What a chunk lets through, and what is held for the next: (out, carry, thinking)."""
    text, out = carry + chunk, []
    while True:
        mark = CLOSE if thinking else OPEN
        at = text.find(mark)
        if at < 0:
            n = _held(text, mark)
            if not thinking:
                out.append(text[: len(text) - n])
            return "".join(out), text[len(text) - n :] if n else "", thinking
        if not thinking:
            out.append(text[:at])
        text, thinking = text[at + len(mark) :], not thinking


def think_filter(chunks: DataFrame) -> DataFrame:
    """I7 on a stream of (conv_id, seq, chunk): chunks without thinking, with marks that lie across chunk ends.

    Chunks of a conversation must come in order of seq over the micro-batches. What is held back when a stream ends is
    given out when its last chunk, a null one, comes.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carry, thinking = state.get if state.exists else ("", False)
        rows = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            if r.chunk is None:
                out, carry = ("" if thinking else carry), ""
            else:
                out, carry, thinking = visible(carry, thinking, r.chunk)
            if out:
                rows.append((key[0], r.seq, out))
        state.update((carry, thinking))
        yield pd.DataFrame(rows, columns=["conv_id", "seq", "text"])

    return chunks.groupBy("conv_id").applyInPandasWithState(run, "conv_id long, seq long, text string", "carry string, thinking boolean", "append", GroupStateTimeout.NoTimeout)
