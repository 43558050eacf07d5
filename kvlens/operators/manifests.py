"""Manifests: member order, missing members, completeness, coverage of a grid and range containment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlens.operators.catalog import is_servable, page, unservable_reason

#: The reasons that make a manifest corrupt, not merely incomplete.
CORRUPT_REASONS = ("object_corrupt", "compatibility_mismatch", "catalog_inconsistent")
#: Columns in which a member must agree with its manifest where the manifest has a value.
OPTIONAL = ("tokenizer_hash", "rope_config_hash")
#: The columns that a member's identity is judged by.
IDENTITY = ("model_hash", *OPTIONAL, "prefix_hash", "token_range_start", "token_range_end")


def list_manifests(manifests: DataFrame, limit: int | None = None, **equal: str | None) -> DataFrame:
    """Manifests where the given columns (manifest_type, model_hash, prefix_hash) have the given values, by id."""
    wanted = [F.col(c) == F.lit(v) for c, v in equal.items() if v is not None]
    return page(reduce(DataFrame.where, wanted, manifests), ["manifest_id"], limit)


def ordered_members(members: DataFrame) -> DataFrame:
    """Members with their place in the manifest: by layer and block (nulls last), then object."""
    order = [F.col("layer_id").asc_nulls_last(), F.col("kv_block_id").asc_nulls_last(), F.col("object_id").asc()]
    return members.withColumn("place", F.row_number().over(Window.partitionBy("manifest_id").orderBy(*order)).cast("long"))


def identity_mismatch(manifests: DataFrame, compat: DataFrame) -> Column:
    """The first rule that a member's compatibility (struct c) breaks against its manifest (struct m), else null.

    Both model hashes may be absent alike; a prefix hash must be there; the token range must lie inside.
    """
    m, c = (lambda name: F.col(f"m.{name}")), (lambda name: F.col(f"c.{name}"))
    known = [x for x in OPTIONAL if x in manifests.columns and x in compat.columns]
    rules = [(~m("model_hash").eqNullSafe(c("model_hash")), "model_hash mismatch")]
    rules += [(m(x).isNotNull() & ~m(x).eqNullSafe(c(x)), f"{x} mismatch") for x in known]
    rules += [
        (~c("prefix_hash").eqNullSafe(m("prefix_hash")) | m("prefix_hash").isNull(), "prefix_hash mismatch"),
        (c("token_range_start").isNull(), "token_range_start missing"),
        (c("token_range_end").isNull(), "token_range_end missing"),
        ((c("token_range_start") < m("token_range_start")) | (c("token_range_end") > m("token_range_end")) | (c("token_range_end") < c("token_range_start")), "token range mismatch"),
    ]
    return reduce(lambda done, rule: done.when(*rule), rules[1:], F.when(*rules[0]))


def identity_columns(df: DataFrame) -> Column:
    """Struct of the columns that identity is judged by; no others are read or moved."""
    return F.struct(*(x for x in IDENTITY if x in df.columns))


def with_identity(members: DataFrame, manifests: DataFrame, compat: DataFrame) -> DataFrame:
    """Members with mismatch; a member without compatibility has c null."""
    own = manifests.select("manifest_id", identity_columns(manifests).alias("m"))
    ranges = compat.select("object_id", identity_columns(compat).alias("c"))
    joined = members.join(own, "manifest_id").join(ranges, "object_id", "left")
    return joined.withColumn("mismatch", identity_mismatch(manifests, compat))


def missing_members(members: DataFrame, objects: DataFrame, locations: DataFrame, manifests: DataFrame | None = None, compat: DataFrame | None = None) -> DataFrame:
    """Required members that can't be served or don't belong to their manifest, with the reason.

    An object without a location counts as absent, as does one without compatibility where that is given.
    """
    stored = objects.join(locations.where("tier = 'disk'").select("object_id"), "object_id", "left_semi").select("object_id", "state", "pin_count")
    required = members.where("required = 1")
    reason = unservable_reason()
    if manifests is not None and compat is not None:
        required = with_identity(required.select("manifest_id", "object_id", "layer_id", "kv_block_id"), manifests, compat)
        reason = F.when(F.col("c").isNull(), F.lit("object_absent")).otherwise(F.coalesce(reason, F.when(F.col("mismatch").isNotNull(), "compatibility_mismatch")))
    joined = required.join(stored, "object_id", "left")
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").select("manifest_id", "object_id", "layer_id", "kv_block_id", "reason")


def completeness(manifests: DataFrame, members: DataFrame, missing: DataFrame) -> DataFrame:
    """manifest_id, required_count, serveable_required_count, missing_count, completeness_state."""
    required = members.where("required = 1").groupBy("manifest_id").agg(F.count(F.lit(1)).alias("required_count"))
    per = missing.groupBy("manifest_id").agg(F.count(F.lit(1)).alias("missing_count"), F.bool_or(F.col("reason").isin(*CORRUPT_REASONS)).alias("bad"))
    joined = manifests.select("manifest_id").join(required, "manifest_id", "left").join(per, "manifest_id", "left")
    n, lost = F.coalesce("required_count", F.lit(0)), F.coalesce("missing_count", F.lit(0))
    state = F.when(F.col("bad"), "corrupt").when(lost > 0, "incomplete").otherwise("complete")
    return joined.select("manifest_id", n.alias("required_count"), (n - lost).alias("serveable_required_count"), lost.alias("missing_count"), state.alias("completeness_state"))


def uncovered(manifests: DataFrame, members: DataFrame, layers: int, blocks: int) -> DataFrame:
    """Cells of the expected grid (layers and blocks from 0) that no required member fills.  The grid is exploded in place."""
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    grid = manifests.select("manifest_id", upto(layers).alias("layer_id")).withColumn("kv_block_id", upto(blocks))
    filled = members.where("required = 1").select("manifest_id", "layer_id", "kv_block_id")
    return grid.join(filled, ["manifest_id", "layer_id", "kv_block_id"], "left_anti").withColumn("reason", F.lit("expected_member_missing"))


def unexpected(expected: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of ``expected`` (manifest_id, layer_id, kv_block_id, token_range_start, token_range_end) that no required
    member fills; a null range asks for none."""
    here = members.where("required = 1").select("manifest_id", "layer_id", "kv_block_id", F.col("token_range_start").alias("_start"), F.col("token_range_end").alias("_end"))
    same = [expected[c] == here[c] for c in ("manifest_id", "layer_id", "kv_block_id")]
    same += [expected[c].isNull() | (expected[c] == here[d]) for c, d in (("token_range_start", "_start"), ("token_range_end", "_end"))]
    return expected.join(here, reduce(Column.__and__, same), "left_anti").withColumn("reason", F.lit("expected_member_missing"))


def identity_violations(manifests: DataFrame, members: DataFrame, compat: DataFrame) -> DataFrame:
    """manifest_id, object_id, mismatch of members that don't belong to their manifest."""
    found = with_identity(members.select("manifest_id", "object_id"), manifests, compat).where("c IS NOT NULL AND mismatch IS NOT NULL")
    return found.select("manifest_id", "object_id", "mismatch")


def inspect(manifests: DataFrame, members: DataFrame) -> DataFrame:
    """Manifests with the number of their members and of the required ones."""
    per = members.groupBy("manifest_id").agg(F.count(F.lit(1)).alias("member_count"), F.count_if(F.col("required") == 1).alias("required_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return manifests.join(per, "manifest_id", "left").select(*manifests.columns, zero("member_count"), zero("required_count"))


def add_members(asked: DataFrame, manifests: DataFrame, objects: DataFrame, locations: DataFrame, compat: DataFrame) -> DataFrame:
    """manifest_id, object_id, refused, pins of members asked for: the reason they are refused, else null, and the pins
    that the object takes over from its manifest if it is required.

    Members go through each join once; an asked row gives a row.
    """
    stored = objects.where(is_servable()).select("object_id").join(locations.where("tier = 'disk'").select("object_id"), "object_id", "left_semi")
    servable = compat.select("object_id", identity_columns(compat).alias("c"), F.lit(True).alias("servable")).join(stored, "object_id", "left_semi")
    known = manifests.select("manifest_id", "pin_count", identity_columns(manifests).alias("m"), F.lit(True).alias("known"))
    joined = asked.select("manifest_id", "object_id", "required").join(known, "manifest_id", "left").join(servable, "object_id", "left")
    mismatch = identity_mismatch(manifests, compat)
    refused = F.when(F.col("servable").isNull(), "member is not serveable").when(F.col("known").isNull(), "manifest not found").otherwise(mismatch)
    pins = F.when(refused.isNull() & (F.col("required") == 1), F.col("pin_count")).otherwise(F.lit(0))
    return joined.select("manifest_id", "object_id", refused.alias("refused"), pins.cast("long").alias("pins"))


def pin_records(manifest_ids: DataFrame, members: DataFrame, op: str = "pin") -> DataFrame:
    """One log record for each required member of the manifests that are pinned or unpinned."""
    return manifest_ids.join(members.where("required = 1"), "manifest_id").select("object_id", "manifest_id", F.lit(op).alias("op"))
