"""Trace events: transfer summaries, nearest-rank latencies, and the health of paths."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summarize(trace: DataFrame, *by: str) -> DataFrame:
    """Bytes and counts by event type; the longest duration, and the reason of the last line that has one."""
    total = lambda *t: F.coalesce(F.sum(F.when(F.col("event_type").isin(*t), F.col("bytes"))), F.lit(0))
    count = lambda *t: F.count_if(F.col("event_type").isin(*t))
    last = F.max(F.when(F.col("reason_code") != "", F.struct("line_no", "reason_code")))["reason_code"]
    return trace.groupBy(*by).agg(
        total("chunk_sent", "get_chunk_sent").alias("bytes_sent"), total("chunk_received").alias("bytes_received"), count("chunk_retry", "chunk_retried").alias("retries"),
        count("chunk_timeout", "transfer_timeout").alias("timeouts"), F.max("duration_ms").alias("duration_ms"), last.alias("reason_code"),
    )


def ack_latency(trace: DataFrame, *by: str) -> DataFrame:
    """Nearest-rank percentiles of acknowledged chunks, which are values that occurred."""
    acks = trace.where("event_type = 'chunk_ack'")
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY duration_ms)").cast("long")
    return acks.groupBy(*by).agg(F.count(F.lit(1)).alias("acks"), rank(0.5).alias("p50_ms"), rank(0.95).alias("p95_ms"))


class PathHealth:
    """Two failures in a row degrade a path and three end it; a timeout degrades; an acknowledgement heals all but a dead one."""

    def __init__(self, health: str = "healthy", failures: int = 0, timeouts: int = 0, ewma: float | None = None):
        self.health, self.failures, self.timeouts, self.ewma = health, failures, timeouts, ewma

    def step(self, event_type: str, duration_ms: float | None) -> None:
        if event_type == "chunk_ack":
            if self.health != "dead":
                self.failures, self.health = 0, "healthy"
            if duration_ms is not None:
                self.ewma = duration_ms if self.ewma is None else 0.25 * duration_ms + 0.75 * self.ewma
        elif event_type == "chunk_timeout":
            self.timeouts += 1
            self.failures += 1
            if self.health != "dead":
                self.health = "dead" if self.failures >= 3 else "degraded"
        elif event_type == "chunk_retry":
            self.failures += 1
            if self.failures >= 2 and self.health != "dead":
                self.health = "dead" if self.failures >= 3 else "degraded"


def path_health(trace: DataFrame) -> DataFrame:
    """path_name, health, failures, timeouts, ewma_ms after all events of a path in line order.

    A path's events are sorted by Spark's shuffle and streamed through the fold; no path is held in memory.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        path, now, out = None, PathHealth(), []
        row = lambda: (path, now.health, now.failures, now.timeouts, now.ewma)
        for batch in batches:
            for name, event, duration in batch[["path_name", "event_type", "duration_ms"]].itertuples(index=False):
                if name != path:
                    if path is not None:
                        out.append(row())
                    path, now = name, PathHealth()
                now.step(event, None if pd.isna(duration) else float(duration))
        if path is not None:
            out.append(row())
        yield pd.DataFrame(out, columns=["path_name", "health", "failures", "timeouts", "ewma_ms"])

    kept = trace.where("path_name IS NOT NULL AND event_type IN ('chunk_ack', 'chunk_timeout', 'chunk_retry')").select("path_name", "line_no", "event_type", "duration_ms")
    return kept.repartition("path_name").sortWithinPartitions("path_name", "line_no").mapInPandas(run, "path_name string, health string, failures long, timeouts long, ewma_ms double")
