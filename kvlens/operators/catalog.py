"""Catalog queries over objects, compatibility, locations and the opaque-key index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("staging", "committed", "verified", "pinned", "evictable", "evicting", "evicted", "missing", "corrupt", "quarantined")
SERVABLE = ("verified", "pinned", "evictable")
EVICTABLE = ("committed", "verified", "evictable")


def is_servable() -> Column:
    return F.col("state").isin(*SERVABLE) & (F.col("pin_count") >= 0)


def is_evictable() -> Column:
    return F.col("state").isin(*EVICTABLE) & (F.col("pin_count") == 0)


def page(df: DataFrame, order: list, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of ``df`` in a total order; without a limit everything after the offset."""
    ordered = df.orderBy(*order).offset(offset) if offset else df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def list_objects(objects: DataFrame, compat: DataFrame, limit: int | None = None, offset: int = 0, **equal) -> DataFrame:
    """Objects with their compatibility columns where all given columns have the given values, by object_id.

    Conditions on compatibility columns make the left join an inner one, which the optimizer sees by itself.
    """
    unknown = set(equal) - set(objects.columns) - set(compat.columns)
    if unknown:
        raise ValueError(f"no such filter: {sorted(unknown)}")
    own = compat.drop(*(set(compat.columns) & set(objects.columns) - {"object_id"}))
    joined = objects.join(own, "object_id", "left")
    wanted = [F.col(c) == F.lit(v) for c, v in equal.items() if v is not None]
    return page(reduce(DataFrame.where, wanted, joined), ["object_id"], limit, offset)


def list_then_servable(objects: DataFrame, limit: int) -> DataFrame:
    """The servable ones among the first ``limit`` objects: the limit comes first, so a page can be short."""
    return page(objects, ["object_id"], limit).where(is_servable())


def stats_by_state(objects: DataFrame) -> DataFrame:
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return objects.groupBy("state").agg(F.count(F.lit(1)).alias("object_count"), total("byte_length", "bytes"), total("pin_count", "pins"), total("access_count", "accesses"))


def stats(objects: DataFrame, locations: DataFrame) -> DataFrame:
    """One row: the number of objects of each state, sums, and the bytes on disk."""
    counts = [F.count_if(F.col("state") == s).alias(f"{s}_count") for s in STATES]
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    one = objects.agg(F.count(F.lit(1)).alias("object_count"), *counts, total("byte_length", "total_bytes"), total("pin_count", "total_pins"), total("access_count", "total_accesses"))
    return one.crossJoin(locations.where("tier = 'disk'").agg(total("bytes_on_disk", "disk_bytes")))  # one row each


def unservable_reason() -> Column:
    """Why an object (left-joined; null state: absent) can't be served; null if it can.

    States that a stored object shouldn't be found in (committed, evicting) are an inconsistent catalog.
    """
    state = F.col("state")
    by_state = F.when(state.isin("staging", "missing", "evicted", "corrupt", "quarantined"), F.concat(F.lit("object_"), state))
    return F.when(state.isNull(), F.lit("object_absent")).when(is_servable(), F.lit(None).cast("string")).otherwise(F.coalesce(by_state, F.lit("catalog_inconsistent")))


def opaque_index(compat: DataFrame) -> DataFrame:
    """The index of opaque keys: of writes to one key the last (by time, then object) stays, whole."""
    key = ["engine_name", "integration_name", "opaque_engine_key_hash"]
    complete = compat.where(" AND ".join(f"{k} IS NOT NULL" for k in key))
    last = complete.groupBy(*key).agg(F.max(F.struct("created_at_unix_ms", "object_id")).alias("w"))
    return last.select(*key, "w.object_id", "w.created_at_unix_ms")


def list_opaque(index: DataFrame, objects: DataFrame) -> DataFrame:
    """The index with state and whether the object can be served (false where it is absent)."""
    known = objects.select("object_id", "state", is_servable().alias("serveable"))
    return index.join(known, "object_id", "left").withColumn("serveable", F.coalesce("serveable", F.lit(False)))


def list_opaque_page(index: DataFrame, objects: DataFrame, engine_name: str | None = None, integration_name: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of the listed index of an engine or an integration, by engine, integration and key."""
    listed = list_opaque(index, objects)
    wanted = [F.col(c) == v for c, v in (("engine_name", engine_name), ("integration_name", integration_name)) if v is not None]
    return page(reduce(DataFrame.where, wanted, listed), ["engine_name", "integration_name", "opaque_engine_key_hash"], limit, offset)


def lookup_opaque(index: DataFrame, objects: DataFrame, keys: DataFrame) -> DataFrame:
    """object_id of each wanted key whose object can be served: one join for a batch of keys."""
    listed = list_opaque(index, objects).where("serveable")
    return keys.join(listed, ["engine_name", "integration_name", "opaque_engine_key_hash"]).select(*keys.columns, "object_id")
