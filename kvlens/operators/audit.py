"""Integrity audit of catalog, files, manifests and opaque keys: every finding as a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlens.operators.catalog import is_servable

#: Severity of each finding.
SEVERITY = {
    "object_location_missing": "error",
    "object_location_path_mismatch": "error",
    "catalog_object_missing_metadata_file": "error",
    "catalog_object_missing_payload_file": "error",
    "metadata_parse_failed": "critical",
    "object_validation_failed": "critical",
    "payload_hash_mismatch": "critical",
    "metadata_hash_mismatch": "critical",
    "object_id_mismatch": "critical",
    "byte_length_mismatch": "error",
    "metadata_file_without_catalog_entry": "warning",
    "payload_file_without_catalog_entry": "warning",
    "orphan_file_path_mismatch": "error",
    "invalid_committed_filename": "warning",
    "staging_transfer_abandoned": "warning",
    "manifest_member_object_missing": "error",
    "manifest_member_object_not_serveable": "error",
    "quarantined_object_referenced_by_complete_manifest": "critical",
    "opaque_key_index_object_missing": "error",
    "opaque_key_index_object_uninspectable": "error",
}
#: What a rejection by validation is called; all else is object_validation_failed.
REJECTED = {"payload_hash_mismatch": "payload_hash_mismatch", "descriptor_hash_mismatch": "metadata_hash_mismatch", "object_id_mismatch": "object_id_mismatch", "byte_length_mismatch": "byte_length_mismatch"}


def findings_of(df: DataFrame, kinds: Column, manifest: Column | None = None) -> DataFrame:
    """A row for each kind in an array column (nulls are passed over), with its severity."""
    severity = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))
    named = df.select("object_id", (F.lit(None).cast("string") if manifest is None else manifest).alias("manifest_id"), F.explode(F.array_compact(kinds)).alias("finding_type"))
    return named.select("finding_type", severity[F.col("finding_type")].alias("severity"), "object_id", "manifest_id")


def when(condition: Column, kind: str) -> Column:
    return F.when(condition, F.lit(kind))


def inspected(objects: DataFrame, locations: DataFrame, files: DataFrame) -> DataFrame:
    """Objects with their location (null columns: none) and files: one row an object, from two joins.

    ``files``: object_id, has_meta, has_payload, metadata_ok, reason_code (of its validation, accepted if it
    passes), found_id, found_descriptor_hash, found_payload_hash, payload_bytes, meta_path, payload_path.
    """
    place = locations.where("tier = 'disk'").select("object_id", F.lit(True).alias("placed"), F.col("meta_path").alias("known_meta"), F.col("payload_path").alias("known_payload"))
    return objects.join(place, "object_id", "left").join(files, "object_id", "left")


def object_findings(seen: DataFrame) -> DataFrame:
    """Findings of catalog objects; each check ends where a file that the next needs isn't there or isn't valid."""
    placed = F.coalesce("placed", F.lit(False))
    meta, payload = placed & F.coalesce("has_meta", F.lit(False)), placed & F.coalesce("has_payload", F.lit(False))
    both = meta & payload
    parsed = both & F.coalesce("metadata_ok", F.lit(False))
    valid = parsed & (F.col("reason_code") == "accepted")
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    rejected = reduce(lambda done, pair: done.when(F.col("reason_code") == pair[0], pair[1]), REJECTED.items(), F.when(F.lit(False), ""))
    kinds = F.array(
        when(~placed, "object_location_missing"),
        when(placed & (differs("known_meta", "meta_path") | differs("known_payload", "payload_path")), "object_location_path_mismatch"),
        when(placed & ~meta, "catalog_object_missing_metadata_file"),
        when(placed & ~payload, "catalog_object_missing_payload_file"),
        when(both & ~parsed, "metadata_parse_failed"),
        F.when(parsed & ~valid, rejected.otherwise("object_validation_failed")),
        when(valid & differs("found_id", "object_id"), "object_id_mismatch"),
        when(valid & differs("found_descriptor_hash", "descriptor_hash"), "metadata_hash_mismatch"),
        when(valid & differs("found_payload_hash", "payload_hash"), "payload_hash_mismatch"),
        when(valid & differs("byte_length", "payload_bytes"), "byte_length_mismatch"),
    )
    found = findings_of(seen, kinds)
    # A length that validation rejects is as grave as a hash; one that only the catalog has wrong isn't.
    grave = seen.where(parsed & ~valid).select("object_id").distinct()
    graver = found.where("finding_type = 'byte_length_mismatch'").join(grave, "object_id", "left_semi").withColumn("severity", F.lit("critical"))
    milder = found.where("finding_type <> 'byte_length_mismatch'").unionByName(found.where("finding_type = 'byte_length_mismatch'").join(grave, "object_id", "left_anti"))
    return milder.unionByName(graver)


def file_findings(files: DataFrame, objects: DataFrame, names: DataFrame | None = None, staging: DataFrame | None = None) -> DataFrame:
    """Files without a catalog entry (a pair not at its own path too), committed names that are no ids, staging left over.

    ``names``: object_id (the stem of a committed file), valid; ``staging``: object_id (the folder's name).
    """
    lost = files.join(objects, "object_id", "left_anti")
    pair = F.col("has_meta") & F.col("has_payload")
    found = findings_of(lost, F.array(
        when(F.col("has_meta"), "metadata_file_without_catalog_entry"),
        when(F.col("has_payload"), "payload_file_without_catalog_entry"),
        when(pair & ~F.coalesce("at_own_path", F.lit(True)), "orphan_file_path_mismatch"),
    ))
    if names is not None:
        found = found.unionByName(findings_of(names.where("NOT valid"), F.array(F.lit("invalid_committed_filename"))))
    if staging is not None:
        found = found.unionByName(findings_of(staging, F.array(F.lit("staging_transfer_abandoned"))))
    return found


def inspectable(seen: DataFrame) -> DataFrame:
    """object_id, state, pin_count, placed, servable: an object whose files stand at their place and are valid serves by its state."""
    whole = F.col("has_meta") & F.col("has_payload") & F.col("metadata_ok") & (F.col("reason_code") == "accepted") & F.col("known_meta").eqNullSafe(F.col("meta_path")) & F.col("known_payload").eqNullSafe(F.col("payload_path"))
    placed = F.coalesce("placed", F.lit(False))
    return seen.select("object_id", "state", "pin_count", placed.alias("placed"), (placed & F.coalesce(whole, F.lit(False)) & is_servable()).alias("servable"))


def member_findings(members: DataFrame, seen: DataFrame, complete: DataFrame | None = None) -> DataFrame:
    """``seen``: as ``inspectable`` gives it; ``complete``: manifest_id of manifests that are said to be complete."""
    joined = members.select("manifest_id", "object_id").join(seen.select("object_id", "state", "servable"), "object_id", "left")
    bad = F.lit(False)
    if complete is not None:
        joined = joined.join(complete.select("manifest_id", F.lit(True).alias("complete")), "manifest_id", "left")
        bad = F.col("complete") & F.col("state").isin("quarantined", "corrupt")
    return findings_of(joined, F.array(
        when(F.col("state").isNull(), "manifest_member_object_missing"),
        when(F.col("state").isNotNull() & ~F.col("servable"), "manifest_member_object_not_serveable"),
        when(bad, "quarantined_object_referenced_by_complete_manifest"),
    ), F.col("manifest_id"))


def index_findings(index: DataFrame, seen: DataFrame, compat: DataFrame) -> DataFrame:
    """Opaque keys whose object is unknown, or known without a location or compatibility."""
    described = compat.select("object_id", F.lit(True).alias("described"))
    joined = index.select("object_id").join(seen.select("object_id", "state", "placed"), "object_id", "left").join(described, "object_id", "left")
    here = F.col("state").isNotNull()
    return findings_of(joined, F.array(
        when(~here, "opaque_key_index_object_missing"),
        when(here & ~(F.col("placed") & F.coalesce("described", F.lit(False))), "opaque_key_index_object_uninspectable"),
    ))


def audit(objects, locations, files, members, manifests, index, compat, names=None, staging=None) -> DataFrame:
    """Every finding.  ``manifests``: manifest_id, completeness_state."""
    seen = inspected(objects, locations, files)
    known = inspectable(seen)
    complete = manifests.where("completeness_state = 'complete'")
    parts = [object_findings(seen), file_findings(files, objects, names, staging), member_findings(members, known, complete), index_findings(index, known, compat)]
    return reduce(DataFrame.unionByName, parts)


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "finding_type").agg(F.count(F.lit(1)).alias("findings"))


def verdict(findings: DataFrame, mode: str = "check", mutations: int = 0) -> str:
    """clean or dirty; quarantined or repaired where that mode has changed something."""
    if mutations and mode in ("quarantine", "repair"):
        return {"quarantine": "quarantined", "repair": "repaired"}[mode]
    return "dirty" if findings.limit(1).count() else "clean"


def repairs(findings: DataFrame, mode: str) -> DataFrame:
    """object_id, manifest_id, new_state of what repair or quarantine does about findings, one row each.

    Repair marks objects without location or files missing; quarantine takes damaged ones aside.  Manifests
    with members that can't be served become incomplete, or corrupt under quarantine where a complete one has
    bad members.
    """
    kind = F.col("finding_type")
    lost = kind.isin("object_location_missing", "catalog_object_missing_metadata_file", "catalog_object_missing_payload_file")
    damaged = kind.isin("metadata_parse_failed", "object_validation_failed", "payload_hash_mismatch", "metadata_hash_mismatch", "object_id_mismatch") | ((kind == "byte_length_mismatch") & (F.col("severity") == "critical"))
    member = kind.isin("manifest_member_object_missing", "manifest_member_object_not_serveable")
    worst = kind == "quarantined_object_referenced_by_complete_manifest"
    state = F.when(F.lit(mode == "repair") & lost, "missing").when(F.lit(mode == "quarantine") & damaged, "quarantined")
    state = state.when(F.lit(mode == "quarantine") & worst, "corrupt").when(F.lit(mode != "check") & member, "incomplete")
    named = findings.select(F.when(F.col("manifest_id").isNull(), F.col("object_id")).alias("object_id"), "manifest_id", state.alias("new_state")).where("new_state IS NOT NULL")
    return named.groupBy("object_id", "manifest_id").agg(F.min("new_state").alias("new_state"))  # corrupt before incomplete


def importable(files: DataFrame, objects: DataFrame) -> DataFrame:
    """object_id of pairs of files without catalog entry that repair takes in: at their own path, valid, of their own id."""
    whole = F.col("has_meta") & F.col("has_payload") & F.coalesce("at_own_path", F.lit(True)) & F.col("metadata_ok") & (F.col("reason_code") == "accepted") & (F.col("found_id") == F.col("object_id"))
    return files.where(whole).join(objects, "object_id", "left_anti").select("object_id")
