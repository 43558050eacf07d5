"""Object lifecycle: a log of mutations folded to a snapshot.

Counters, sums and last writes are plain aggregates with map-side combination and never enter a fold.  Only
pins and state changes depend on their order; these few columns are folded for each object in log order, an
illegal step being counted and passed over.  ``start`` carries on from an earlier snapshot, so a long log
is folded a partition (say, a day) at a time and an object's list stays as short as its day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Allowed transitions; a state may always follow itself.
TRANSITIONS = {
    "staging": ("committed", "quarantined"),
    "committed": ("verified", "evicting", "missing", "corrupt", "quarantined"),
    "verified": ("pinned", "evictable", "evicting", "missing", "corrupt", "quarantined"),
    "pinned": ("verified", "quarantined"),
    "evictable": ("pinned", "evicting", "missing", "corrupt", "quarantined"),
    "evicting": ("evicted", "missing", "quarantined"),
    "missing": ("quarantined", "verified"),
    "corrupt": ("quarantined", "verified"),
    "quarantined": ("verified",),
    "evicted": (),
}


def allowed(source: Column, target: Column) -> Column:
    pairs = F.array(*(F.lit(f"{a}>{b}") for a, bs in TRANSITIONS.items() for b in bs))
    return (source == target) | F.array_contains(pairs, F.concat(source, F.lit(">"), target))


def access_totals(log: DataFrame) -> DataFrame:
    count = lambda op: F.count_if(F.col("op") == op)
    total = lambda op: F.coalesce(F.sum(F.when(F.col("op") == op, F.col("bytes"))), F.lit(0))
    last = lambda op: F.max(F.when(F.col("op") == op, F.col("timestamp_unix_ms")))
    return log.groupBy("object_id").agg(
        count("get").alias("get_count"), count("put").alias("put_count"), total("get").alias("bytes_read_total"), total("put").alias("bytes_written_total"), last("get").alias("last_get_unix_ms"), last("put").alias("last_put_unix_ms")
    )


def ttl_last_write(log: DataFrame) -> DataFrame:
    """The TTL of each object that had one set or cleared; the last write (by seq) wins, cleared is null."""
    writes = log.where(F.col("op").isin("ttl_set", "ttl_clear"))
    last = writes.groupBy("object_id").agg(F.max(F.struct("seq", "op", "timestamp_unix_ms", "bytes")).alias("w"))
    ttl = F.when(F.col("w.op") == "ttl_set", F.col("w.timestamp_unix_ms") + F.col("w.bytes"))
    return last.select("object_id", ttl.alias("ttl_expires_at_unix_ms"), F.col("w.seq").alias("seq"))


def fold(log: DataFrame, start: DataFrame | None = None, initial_state: str = "verified") -> DataFrame:
    """object_id, state, pin_count, rejected after the log.  Ops: pin, unpin, to_<state>, force_<state>."""
    steps = log.where((F.col("op").isin("pin", "unpin")) | F.col("op").rlike("^(to|force)_"))
    listed = steps.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("seq", "op"))).alias("steps"))
    if start is None:
        rows = listed.withColumns({"state": F.lit(initial_state), "pin_count": F.lit(0).cast("long")})
    else:
        rows = listed.join(start.select("object_id", "state", "pin_count"), "object_id", "full_outer").withColumns({"steps": F.coalesce("steps", F.array().cast(dict(listed.dtypes)["steps"])), "state": F.coalesce("state", F.lit(initial_state)), "pin_count": F.coalesce("pin_count", F.lit(0).cast("long"))})

    def step(now: Column, s: Column) -> Column:
        state, pins, bad = now["state"], now["pins"], now["rejected"]
        made = lambda st, p, b: F.struct(st.alias("state"), p.alias("pins"), b.alias("rejected"))
        target = F.regexp_replace(s["op"], "^(to|force)_", "")
        pin = F.when((pins > 0) | allowed(state, F.lit("pinned")), made(F.when(pins > 0, state).otherwise(F.lit("pinned")), pins + 1, bad)).otherwise(made(state, pins, bad + 1))
        unpin = F.when(pins == 0, made(state, pins, bad)).otherwise(made(F.when((pins == 1) & (state == "pinned"), F.lit("verified")).otherwise(state), pins - 1, bad))
        move = F.when(allowed(state, target) | s["op"].startswith("force_"), made(target, pins, bad)).otherwise(made(state, pins, bad + 1))
        return F.when(s["op"] == "pin", pin).when(s["op"] == "unpin", unpin).otherwise(move)

    zero = F.struct(F.col("state").alias("state"), F.col("pin_count").alias("pins"), F.lit(0).cast("long").alias("rejected"))
    done = rows.withColumn("now", F.aggregate("steps", zero, step))
    return done.select("object_id", "now.state", F.col("now.pins").alias("pin_count"), "now.rejected")
