"""Eviction plans: which objects go, in which order, until a target size is reached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlens.operators.catalog import is_evictable
from kvlens.sources.scratch import save

POLICIES = ("lru", "size_aware_lru", "ttl")


def candidates(objects: DataFrame, locations: DataFrame) -> DataFrame:
    """Evictable objects that lie on disk."""
    return objects.where(is_evictable()).join(locations.where("tier = 'disk'").select("object_id", "bytes_on_disk"), "object_id")


def score(now_unix_ms: int) -> Column:
    """Age times size; an object that was never read is as old as the clock.  Exact beyond 64 bits."""
    wide = lambda x: F.greatest(x, F.lit(0)).cast("decimal(19,0)")
    return wide(F.lit(now_unix_ms) - F.coalesce("last_accessed_unix_ms", F.lit(0))) * wide(F.col("bytes_on_disk"))


def order_of(policy: str, now_unix_ms: int) -> list[Column]:
    lru = [F.col("last_accessed_unix_ms").asc_nulls_first(), F.col("object_id").asc()]
    if policy == "lru":
        return lru
    if policy == "ttl":
        return [F.col("ttl_expires_at_unix_ms").asc(), *lru]
    if policy == "size_aware_lru":
        return [F.col("score").desc(), lru[0], F.col("bytes_on_disk").desc(), lru[1]]
    raise ValueError(f"no such policy: {policy}")


def running(df: DataFrame, order: list[Column], value: str, partitions: int = 0) -> DataFrame:
    """``df`` with ``before`` (the sum of ``value`` over all earlier rows) and ``position`` (from 1).

    A window over the whole table would put every row in one task.  The rows are dealt to ranges of the
    order instead, written once, and summed a range; a window then goes over one row a range.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = save(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rank"))
    inside = Window.partitionBy("_range").orderBy(*order)
    own = F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = ranged.withColumns({"_before": own, "_at": F.row_number().over(inside)})
    joined = numbered.join(F.broadcast(starts), "_range")  # one row a partition
    return joined.withColumns({"before": F.col("_start") + F.col("_before"), "position": F.col("_rank") + F.col("_at")}).drop("_range", "_start", "_rank", "_before", "_at")


def plan(objects: DataFrame, locations: DataFrame, policy: str, now_unix_ms: int, target_bytes: int, max_objects: int | None = None) -> DataFrame:
    """position, object_id, bytes_on_disk, projected_bytes (what stays on disk after it) of the objects to evict.

    Objects are taken while the bytes on disk exceed the target, at most ``max_objects``.
    """
    on_disk = locations.where("tier = 'disk'").agg(F.coalesce(F.sum("bytes_on_disk"), F.lit(0))).first()[0]
    found = candidates(objects, locations)
    if policy == "ttl":
        found = found.where(F.col("ttl_expires_at_unix_ms") <= now_unix_ms)
    if policy == "size_aware_lru":
        found = found.withColumn("score", score(now_unix_ms))
    keep = ["object_id", "bytes_on_disk", "last_accessed_unix_ms", "ttl_expires_at_unix_ms", *(["score"] if policy == "size_aware_lru" else [])]
    placed = running(found.select(*keep), order_of(policy, now_unix_ms), "bytes_on_disk")
    taken = placed.where(F.lit(on_disk) - F.col("before") > target_bytes)
    if max_objects is not None:
        taken = taken.where(F.col("position") <= max_objects)
    return taken.select("position", "object_id", "bytes_on_disk", (F.lit(on_disk) - F.col("before") - F.col("bytes_on_disk")).alias("projected_bytes"))


def outcome(taken: DataFrame, on_disk: int, target_bytes: int, dry_run: bool = False) -> str:
    """The reason code of a plan."""
    if on_disk <= target_bytes:
        return "target_already_reached"
    n, least = taken.agg(F.count(F.lit(1)), F.min("projected_bytes")).first()
    if not n:
        return "no_eligible_candidates"
    if dry_run:
        return "dry_run"
    return "ok" if least <= target_bytes else "target_not_reached"


def skip_counts(objects: DataFrame, locations: DataFrame) -> DataFrame:
    """One row: objects on disk that are pinned, and unpinned ones that can't go as their state forbids or no file is known."""
    disk = locations.where("tier = 'disk'").select("object_id", F.lit(True).alias("on_disk"))
    pinned = F.count_if(F.col("on_disk").isNotNull() & (F.col("pin_count") > 0))
    unsafe = F.count_if((F.col("pin_count") == 0) & (F.col("on_disk").isNull() | ~F.col("state").isin("committed", "verified", "evictable")))
    return objects.join(disk, "object_id", "left").agg(pinned.alias("pinned_count"), unsafe.alias("unsafe_count"))
