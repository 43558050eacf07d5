"""Streams: windowed trace counts, repeated chunks, and the lifecycle fold as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kvlens.operators.lifecycle import TRANSITIONS


def trace_counts(events: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Bytes and events by window and type; events later than ``late`` are left out and old state goes."""
    timed = events.withColumn("at", F.timestamp_millis("timestamp_unix_ms")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "event_type").agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).select("window.start", "event_type", "events", "bytes")


def distinct_chunks(chunks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (transfer, index, hash) once within the watermark; a repeat is passed over."""
    return chunks.withWatermark("at", late).dropDuplicatesWithinWatermark(["transfer", "chunk_index", "hash"])


def fold_step(state: str, pins: int, rejected: int, op: str) -> tuple[str, int, int]:
    """One log record; the same rules as the batch fold."""
    may = lambda target: state == target or target in TRANSITIONS[state]
    if op == "pin":
        if pins:
            return state, pins + 1, rejected
        return ("pinned", 1, rejected) if may("pinned") else (state, pins, rejected + 1)
    if op == "unpin":
        return ("verified" if pins == 1 and state == "pinned" else state), max(pins - 1, 0), rejected
    target = op.split("_", 1)[1]
    return (target, pins, rejected) if op.startswith("force_") or may(target) else (state, pins, rejected + 1)


def lifecycle_states(log: DataFrame, initial_state: str = "verified") -> DataFrame:
    """object_id, state, pin_count, rejected after each micro-batch, for the objects that it names.

    Only the latest state of an object is kept; its records of one micro-batch are ordered by seq.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else (initial_state, 0, 0)
        records = pd.concat(list(frames)).sort_values("seq")
        for op in records["op"]:
            if op in ("pin", "unpin") or op.startswith(("to_", "force_")):
                now = fold_step(*now, op)
        held.update(now)
        yield pd.DataFrame([(*key, *now)], columns=["object_id", "state", "pin_count", "rejected"])

    out = "object_id string, state string, pin_count long, rejected long"
    return log.groupBy("object_id").applyInPandasWithState(update, out, "state string, pin_count long, rejected long", "update", GroupStateTimeout.NoTimeout)
