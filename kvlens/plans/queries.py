"""The registered catalog and serving queries with the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlens.functions.descriptors import manifest_id
from kvlens.functions.descriptors import object_identity as identity_of
from kvlens.functions.identity import blake3_hex, bounded
from kvlens.operators import audit, catalog, chunks, eviction, lifecycle, manifests, phases, serving, traces, validation
from kvlens.sources.descriptors import descriptors
from kvlens.sources.views import table, view, with_views

NOW = 1_700_050_000_000
TARGET = 1_000_000
CHUNK = 1024

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register a function of a table getter; its name is the query's."""

    def register(fn: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda name: view(spark, sf_dir, name) if name.startswith("v_") else table(spark, sf_dir, name))

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE_SQL[fn.__name__] = with_views(sql)
        return fn

    return register


# -- catalog ------------------------------------------------------------------------------------------------

LISTED = ["object_id", "object_type", "state", "byte_length", "engine_name", "layer_id"]
CAN_SERVE = "(state IN ('verified', 'pinned', 'evictable') AND pin_count >= 0)"


@query("""SELECT object_id, object_type, state, byte_length, engine_name, layer_id FROM v_objects LEFT JOIN v_compat USING (object_id)
WHERE state = 'verified' AND engine_name = 'engine-en' ORDER BY object_id""")
def list_objects_filtered(t):
    return catalog.list_objects(t("v_objects"), t("v_compat"), state="verified", engine_name="engine-en").select(*LISTED)


@query("""SELECT object_id, object_type, state, byte_length, engine_name, layer_id FROM v_objects LEFT JOIN v_compat USING (object_id)
ORDER BY object_id LIMIT 50 OFFSET 20""")
def list_objects_paged(t):
    return catalog.list_objects(t("v_objects"), t("v_compat"), limit=50, offset=20).select(*LISTED)


@query(f"SELECT object_id, state FROM (SELECT * FROM v_objects ORDER BY object_id LIMIT 100) WHERE {CAN_SERVE}")
def list_limit_then_servable(t):
    return catalog.list_then_servable(t("v_objects"), 100).select("object_id", "state")


@query(f"SELECT object_id, state, byte_length FROM v_objects WHERE {CAN_SERVE}")
def servable_objects(t):
    return t("v_objects").where(catalog.is_servable()).select("object_id", "state", "byte_length")


@query("""SELECT o.object_id, bytes_on_disk FROM v_objects o JOIN v_locations l ON l.object_id = o.object_id AND tier = 'disk'
WHERE state IN ('committed', 'verified', 'evictable') AND pin_count = 0""")
def evictable_objects(t):
    return eviction.candidates(t("v_objects"), t("v_locations")).select("object_id", "bytes_on_disk")


@query("""SELECT state, count(*) AS object_count, CAST(sum(byte_length) AS BIGINT) AS bytes, CAST(sum(pin_count) AS BIGINT) AS pins,
CAST(sum(access_count) AS BIGINT) AS accesses FROM v_objects GROUP BY state""")
def store_stats_by_state(t):
    return catalog.stats_by_state(t("v_objects"))


@query(f"""SELECT count(*) AS object_count, {", ".join(f"count(*) FILTER (WHERE state = '{s}') AS {s}_count" for s in catalog.STATES)},
CAST(coalesce(sum(byte_length), 0) AS BIGINT) AS total_bytes, CAST(coalesce(sum(pin_count), 0) AS BIGINT) AS total_pins,
CAST(coalesce(sum(access_count), 0) AS BIGINT) AS total_accesses,
(SELECT CAST(coalesce(sum(bytes_on_disk), 0) AS BIGINT) FROM v_locations WHERE tier = 'disk') AS disk_bytes FROM v_objects""")
def store_stats_pivot(t):
    return catalog.stats(t("v_objects"), t("v_locations"))


# -- eviction -----------------------------------------------------------------------------------------------

PLACED = """WITH total AS (SELECT sum(bytes_on_disk) AS n FROM v_locations WHERE tier = 'disk'),
candidates AS (SELECT o.*, l.bytes_on_disk,
  CAST(greatest({now} - coalesce(last_accessed_unix_ms, 0), 0) AS HUGEINT) * greatest(bytes_on_disk, 0) AS score
  FROM v_objects o JOIN v_locations l ON l.object_id = o.object_id AND tier = 'disk'
  WHERE state IN ('committed', 'verified', 'evictable') AND pin_count = 0 {more}),
placed AS (SELECT object_id, bytes_on_disk, row_number() OVER (ORDER BY {order}) AS position,
  coalesce(sum(bytes_on_disk) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM candidates)
SELECT position, object_id, bytes_on_disk, CAST(n - before - bytes_on_disk AS BIGINT) AS projected_bytes
FROM placed, total WHERE n - before > {target} {cap}"""
LRU = "last_accessed_unix_ms NULLS FIRST, object_id"


def eviction_sql(order: str, more: str = "", cap: str = "") -> str:
    return PLACED.format(now=NOW, target=TARGET, order=order, more=more, cap=cap)


@query(eviction_sql(LRU))
def evict_lru(t):
    return eviction.plan(t("v_objects"), t("v_locations"), "lru", NOW, TARGET)


@query(eviction_sql("score DESC, last_accessed_unix_ms NULLS FIRST, bytes_on_disk DESC, object_id"))
def evict_size_aware(t):
    return eviction.plan(t("v_objects"), t("v_locations"), "size_aware_lru", NOW, TARGET)


@query(eviction_sql("ttl_expires_at_unix_ms, " + LRU, f"AND ttl_expires_at_unix_ms <= {NOW}"))
def evict_ttl(t):
    return eviction.plan(t("v_objects"), t("v_locations"), "ttl", NOW, TARGET)


@query(eviction_sql(LRU, cap="AND position <= 25"))
def evict_max_objects(t):
    return eviction.plan(t("v_objects"), t("v_locations"), "lru", NOW, TARGET, max_objects=25)


@query("""SELECT count(*) FILTER (WHERE l.object_id IS NOT NULL AND pin_count > 0) AS pinned_count,
count(*) FILTER (WHERE pin_count = 0 AND (l.object_id IS NULL OR state NOT IN ('committed', 'verified', 'evictable'))) AS unsafe_count
FROM v_objects o LEFT JOIN v_locations l ON l.object_id = o.object_id AND tier = 'disk'""")
def eviction_skip_counts(t):
    return eviction.skip_counts(t("v_objects"), t("v_locations"))


# -- manifests ----------------------------------------------------------------------------------------------

BELONGS = """WITH checked AS (SELECT m.manifest_id, m.object_id, m.layer_id, m.kv_block_id, m.required, c.object_id IS NOT NULL AS described,
  CASE WHEN f.model_hash IS DISTINCT FROM c.model_hash THEN 'model_hash mismatch'
       WHEN c.prefix_hash IS DISTINCT FROM f.prefix_hash OR f.prefix_hash IS NULL THEN 'prefix_hash mismatch'
       WHEN c.token_range_start IS NULL THEN 'token_range_start missing' WHEN c.token_range_end IS NULL THEN 'token_range_end missing'
       WHEN c.token_range_start < f.token_range_start OR c.token_range_end > f.token_range_end OR c.token_range_end < c.token_range_start
       THEN 'token range mismatch' END AS mismatch
  FROM v_members m JOIN v_manifests f ON f.manifest_id = m.manifest_id LEFT JOIN v_compat c ON c.object_id = m.object_id)
"""
MISSING = BELONGS.rstrip() + f""",
missing AS (SELECT m.manifest_id, m.object_id, layer_id, kv_block_id,
  CASE WHEN s.state IS NULL OR NOT described THEN 'object_absent'
       WHEN {CAN_SERVE} THEN CASE WHEN mismatch IS NOT NULL THEN 'compatibility_mismatch' END
       WHEN state IN ('staging', 'evicted', 'quarantined', 'corrupt', 'missing') THEN concat('object_', state)
       ELSE 'catalog_inconsistent' END AS reason
  FROM checked m LEFT JOIN (SELECT * FROM v_objects WHERE object_id IN (SELECT object_id FROM v_locations WHERE tier = 'disk')) s
  ON s.object_id = m.object_id WHERE required = 1)
"""


def missing_of(t):
    return manifests.missing_members(t("v_members"), t("v_objects"), t("v_locations"), t("v_manifests"), t("v_compat"))


@query("""SELECT manifest_id, object_id, layer_id, kv_block_id, required,
row_number() OVER (PARTITION BY manifest_id ORDER BY layer_id NULLS LAST, kv_block_id NULLS LAST, object_id) AS place FROM v_members""")
def manifest_members_ordered(t):
    return manifests.ordered_members(t("v_members"))


@query(MISSING + "SELECT * FROM missing WHERE reason IS NOT NULL")
def manifest_missing_members(t):
    return missing_of(t)


@query(MISSING + """SELECT manifest_id, count(missing.manifest_id) AS required_count, count(missing.manifest_id) - count(reason) AS serveable_required_count, count(reason) AS missing_count,
CASE WHEN bool_or(coalesce(reason IN ('object_corrupt', 'compatibility_mismatch', 'catalog_inconsistent'), false)) THEN 'corrupt'
     WHEN count(reason) > 0 THEN 'incomplete' ELSE 'complete' END AS completeness_state
FROM v_manifests LEFT JOIN missing USING (manifest_id) GROUP BY manifest_id""")
def manifest_completeness(t):
    return manifests.completeness(t("v_manifests"), t("v_members"), missing_of(t))


@query("""SELECT manifest_id, layer_id, kv_block_id, 'expected_member_missing' AS reason FROM (
SELECT manifest_id, layer_id, kv_block_id FROM v_manifests, (SELECT unnest(range(0, 4)) AS layer_id), (SELECT unnest(range(0, 7)) AS kv_block_id)
EXCEPT SELECT manifest_id, layer_id, kv_block_id FROM v_members WHERE required = 1)""")
def manifest_expected_coverage(t):
    return manifests.uncovered(t("v_manifests"), t("v_members"), 4, 7)


@query(BELONGS + "SELECT manifest_id, object_id, mismatch FROM checked WHERE described AND mismatch IS NOT NULL")
def manifest_identity_violations(t):
    return manifests.identity_violations(t("v_manifests"), t("v_members"), t("v_compat"))


@query(BELONGS.rstrip() + f""",
servable AS (SELECT object_id FROM v_objects WHERE {CAN_SERVE} AND object_id IN (SELECT object_id FROM v_locations WHERE tier = 'disk') AND object_id IN (SELECT object_id FROM v_compat)),
judged AS (SELECT c.*, f.pin_count, CASE WHEN s.object_id IS NULL THEN 'member is not serveable' ELSE mismatch END AS refused
  FROM checked c JOIN v_manifests f ON f.manifest_id = c.manifest_id LEFT JOIN servable s ON s.object_id = c.object_id)
SELECT manifest_id, object_id, refused, CAST(CASE WHEN refused IS NULL AND required = 1 THEN pin_count ELSE 0 END AS BIGINT) AS pins FROM judged""")
def manifest_add_members(t):
    return manifests.add_members(t("v_members"), t("v_manifests"), t("v_objects"), t("v_locations"), t("v_compat"))


@query("""SELECT manifest_id, completeness_state, pin_count, count(m.object_id) AS member_count, count(*) FILTER (WHERE required = 1) AS required_count
FROM v_manifests LEFT JOIN v_members m USING (manifest_id) GROUP BY ALL""")
def manifest_inspection(t):
    return manifests.inspect(t("v_manifests"), t("v_members")).select("manifest_id", "completeness_state", "pin_count", "member_count", "required_count")


@query("""SELECT o.object_id, m.manifest_id, 'pin' AS op FROM v_members m JOIN v_manifests f ON f.manifest_id = m.manifest_id
JOIN v_objects o ON o.object_id = m.object_id WHERE required = 1 AND f.pin_count > 0""")
def manifest_pin_records(t):
    pinned = t("v_manifests").where("pin_count > 0").select("manifest_id")
    return manifests.pin_records(pinned, t("v_members").join(t("v_objects").select("object_id"), "object_id", "left_semi"))


# -- opaque keys --------------------------------------------------------------------------------------------

INDEX = """WITH idx AS (SELECT engine_name, integration_name, opaque_engine_key_hash, object_id, created_at_unix_ms FROM v_compat
  WHERE opaque_engine_key_hash IS NOT NULL AND engine_name IS NOT NULL AND integration_name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY engine_name, integration_name, opaque_engine_key_hash ORDER BY created_at_unix_ms DESC, object_id DESC) = 1)
"""


@query(INDEX + "SELECT * FROM idx")
def opaque_key_last_write(t):
    return catalog.opaque_index(t("v_compat"))


@query(INDEX + f"""SELECT idx.*, state, coalesce({CAN_SERVE}, false) AS serveable FROM idx LEFT JOIN v_objects o ON o.object_id = idx.object_id""")
def opaque_key_list(t):
    return catalog.list_opaque(catalog.opaque_index(t("v_compat")), t("v_objects"))


@query(INDEX + f"""SELECT k.engine_name, k.integration_name, k.opaque_engine_key_hash, idx.object_id
FROM (SELECT DISTINCT engine_name, integration_name, md5(text) AS opaque_engine_key_hash FROM documents JOIN v_compat
      ON object_id = concat('obj-', lpad(CAST(doc_id AS STRING), 10, '0'))) k
JOIN idx USING (engine_name, integration_name, opaque_engine_key_hash) JOIN v_objects o ON o.object_id = idx.object_id WHERE {CAN_SERVE}""")
def opaque_key_lookup(t):
    docs = t("documents").select(F.concat(F.lit("engine-"), "lang").alias("engine_name"), F.concat(F.lit("integ-"), "source").alias("integration_name"), F.md5("text").alias("opaque_engine_key_hash"))
    return catalog.lookup_opaque(catalog.opaque_index(t("v_compat")), t("v_objects"), docs.distinct())


# -- audit --------------------------------------------------------------------------------------------------

CHECKED = f"""WITH seen AS (SELECT o.*, l.object_id IS NOT NULL AS placed, l.meta_path AS known_meta, l.payload_path AS known_payload,
    f.meta_path, f.payload_path, f.payload_bytes, f.found_id, f.found_descriptor_hash, f.found_payload_hash, f.reason_code,
    coalesce(has_meta, false) AS meta, coalesce(has_payload, false) AS payload, coalesce(metadata_ok, false) AS parsed
  FROM v_objects o LEFT JOIN v_locations l ON l.object_id = o.object_id AND tier = 'disk' LEFT JOIN v_files f ON f.object_id = o.object_id),
known AS (SELECT object_id, state, placed, placed AND meta AND payload AND parsed AND reason_code = 'accepted' AND known_meta IS NOT DISTINCT FROM meta_path
    AND known_payload IS NOT DISTINCT FROM payload_path AND {CAN_SERVE} AS servable FROM seen),
valid AS (SELECT * FROM seen WHERE placed AND meta AND payload AND parsed AND reason_code = 'accepted'),
objects_found AS (
  SELECT 'object_location_missing' AS finding_type, 'error' AS severity, object_id, CAST(NULL AS STRING) AS manifest_id FROM seen WHERE NOT placed
  UNION ALL SELECT 'object_location_path_mismatch', 'error', object_id, NULL FROM seen WHERE placed AND (known_meta IS DISTINCT FROM meta_path OR known_payload IS DISTINCT FROM payload_path)
  UNION ALL SELECT 'catalog_object_missing_metadata_file', 'error', object_id, NULL FROM seen WHERE placed AND NOT meta
  UNION ALL SELECT 'catalog_object_missing_payload_file', 'error', object_id, NULL FROM seen WHERE placed AND NOT payload
  UNION ALL SELECT 'metadata_parse_failed', 'critical', object_id, NULL FROM seen WHERE placed AND meta AND payload AND NOT parsed
  UNION ALL SELECT CASE reason_code WHEN 'payload_hash_mismatch' THEN reason_code WHEN 'descriptor_hash_mismatch' THEN 'metadata_hash_mismatch'
      WHEN 'object_id_mismatch' THEN reason_code WHEN 'byte_length_mismatch' THEN reason_code ELSE 'object_validation_failed' END, 'critical', object_id, NULL
    FROM seen WHERE placed AND meta AND payload AND parsed AND reason_code <> 'accepted'
  UNION ALL SELECT 'object_id_mismatch', 'critical', object_id, NULL FROM valid WHERE found_id <> object_id
  UNION ALL SELECT 'metadata_hash_mismatch', 'critical', object_id, NULL FROM valid WHERE found_descriptor_hash <> descriptor_hash
  UNION ALL SELECT 'payload_hash_mismatch', 'critical', object_id, NULL FROM valid WHERE found_payload_hash <> payload_hash
  UNION ALL SELECT 'byte_length_mismatch', 'error', object_id, NULL FROM valid WHERE payload_bytes <> byte_length),
lost AS (SELECT * FROM v_files WHERE object_id NOT IN (SELECT object_id FROM v_objects)),
files_found AS (
  SELECT 'metadata_file_without_catalog_entry' AS finding_type, 'warning' AS severity, object_id, CAST(NULL AS STRING) AS manifest_id FROM lost WHERE has_meta
  UNION ALL SELECT 'payload_file_without_catalog_entry', 'warning', object_id, NULL FROM lost WHERE has_payload
  UNION ALL SELECT 'orphan_file_path_mismatch', 'error', object_id, NULL FROM lost WHERE has_meta AND has_payload AND NOT at_own_path
  UNION ALL SELECT 'invalid_committed_filename', 'warning', object_id, NULL FROM v_names WHERE NOT valid
  UNION ALL SELECT 'staging_transfer_abandoned', 'warning', object_id, NULL FROM v_staging),
members_found AS (
  SELECT 'manifest_member_object_missing' AS finding_type, 'error' AS severity, m.object_id, m.manifest_id FROM v_members m LEFT JOIN known k ON k.object_id = m.object_id WHERE k.state IS NULL
  UNION ALL SELECT 'manifest_member_object_not_serveable', 'error', m.object_id, m.manifest_id FROM v_members m JOIN known k ON k.object_id = m.object_id WHERE NOT coalesce(servable, false)
  UNION ALL SELECT 'quarantined_object_referenced_by_complete_manifest', 'critical', m.object_id, m.manifest_id FROM v_members m JOIN known k ON k.object_id = m.object_id
    JOIN v_manifests f ON f.manifest_id = m.manifest_id WHERE completeness_state = 'complete' AND state IN ('quarantined', 'corrupt')),
idx AS (SELECT engine_name, integration_name, opaque_engine_key_hash, arg_max(object_id, (created_at_unix_ms, object_id)) AS object_id FROM v_compat
  WHERE opaque_engine_key_hash IS NOT NULL AND engine_name IS NOT NULL AND integration_name IS NOT NULL GROUP BY ALL),
index_found AS (
  SELECT 'opaque_key_index_object_missing' AS finding_type, 'error' AS severity, i.object_id, CAST(NULL AS STRING) AS manifest_id FROM idx i LEFT JOIN v_objects o ON o.object_id = i.object_id WHERE o.object_id IS NULL
  UNION ALL SELECT 'opaque_key_index_object_uninspectable', 'error', i.object_id, NULL FROM idx i JOIN known k ON k.object_id = i.object_id WHERE NOT placed),
found AS (SELECT * FROM objects_found UNION ALL SELECT * FROM files_found UNION ALL SELECT * FROM members_found UNION ALL SELECT * FROM index_found)
"""


def seen_of(t):
    return audit.inspected(t("v_objects"), t("v_locations"), t("v_files"))


def audit_of(t):
    return audit.audit(t("v_objects"), t("v_locations"), t("v_files"), t("v_members"), t("v_manifests"), catalog.opaque_index(t("v_compat")), t("v_compat"), t("v_names"), t("v_staging"))


@query(CHECKED + "SELECT * FROM files_found")
def fsck_orphans(t):
    return audit.file_findings(t("v_files"), t("v_objects"), t("v_names"), t("v_staging"))


@query(CHECKED + "SELECT * FROM objects_found")
def fsck_objects(t):
    return audit.object_findings(seen_of(t))


@query(CHECKED + "SELECT * FROM members_found")
def fsck_members(t):
    return audit.member_findings(t("v_members"), audit.inspectable(seen_of(t)), t("v_manifests").where("completeness_state = 'complete'"))


@query(CHECKED + "SELECT * FROM index_found")
def fsck_opaque_index(t):
    return audit.index_findings(catalog.opaque_index(t("v_compat")), audit.inspectable(seen_of(t)), t("v_compat"))


@query(CHECKED + "SELECT severity, finding_type, count(*) AS findings FROM found GROUP BY ALL")
def fsck_severity_counts(t):
    return audit.severity_counts(audit_of(t))


@query(CHECKED + """SELECT CASE WHEN manifest_id IS NULL THEN object_id END AS object_id, manifest_id, CASE WHEN manifest_id IS NULL THEN 'missing' ELSE 'incomplete' END AS new_state
FROM found WHERE finding_type IN ('object_location_missing', 'catalog_object_missing_metadata_file', 'catalog_object_missing_payload_file', 'manifest_member_object_missing', 'manifest_member_object_not_serveable') GROUP BY ALL""")
def fsck_repairs(t):
    return audit.repairs(audit_of(t), "repair")


@query(CHECKED + "SELECT object_id FROM lost WHERE has_meta AND has_payload AND at_own_path AND metadata_ok AND reason_code = 'accepted' AND found_id = object_id")
def fsck_importable(t):
    return audit.importable(t("v_files"), t("v_objects"))


# -- lifecycle ----------------------------------------------------------------------------------------------


@query("""SELECT object_id, count(*) FILTER (WHERE op = 'get') AS get_count, count(*) FILTER (WHERE op = 'put') AS put_count,
CAST(coalesce(sum(bytes) FILTER (WHERE op = 'get'), 0) AS BIGINT) AS bytes_read_total, CAST(coalesce(sum(bytes) FILTER (WHERE op = 'put'), 0) AS BIGINT) AS bytes_written_total,
max(timestamp_unix_ms) FILTER (WHERE op = 'get') AS last_get_unix_ms, max(timestamp_unix_ms) FILTER (WHERE op = 'put') AS last_put_unix_ms
FROM v_store_events GROUP BY object_id""")
def access_totals(t):
    return lifecycle.access_totals(t("v_store_events"))


@query("""SELECT object_id, CASE WHEN arg_max(op, seq) = 'ttl_set' THEN arg_max(timestamp_unix_ms + bytes, seq) END AS ttl_expires_at_unix_ms, max(seq) AS seq
FROM v_store_events WHERE op IN ('ttl_set', 'ttl_clear') GROUP BY object_id""")
def ttl_last_write(t):
    return lifecycle.ttl_last_write(t("v_store_events"))


_LEGAL = ", ".join(f"('{a}', '{b}')" for a, bs in lifecycle.TRANSITIONS.items() for b in bs)


@query(f"""WITH RECURSIVE steps AS (SELECT object_id, op, row_number() OVER (PARTITION BY object_id ORDER BY seq) AS k FROM v_store_events
  WHERE op IN ('pin', 'unpin') OR op LIKE 'to\\_%' ESCAPE '\\'),
folded AS (
  SELECT object_id, CAST(0 AS BIGINT) AS k, 'verified' AS state, CAST(0 AS BIGINT) AS pins, CAST(0 AS BIGINT) AS rejected FROM (SELECT DISTINCT object_id FROM steps)
  UNION ALL
  SELECT f.object_id, s.k,
    CASE WHEN op = 'pin' THEN CASE WHEN pins > 0 THEN state WHEN state = 'pinned' OR (state, 'pinned') IN ({_LEGAL}) THEN 'pinned' ELSE state END
         WHEN op = 'unpin' THEN CASE WHEN pins = 1 AND state = 'pinned' THEN 'verified' ELSE state END
         WHEN state = substr(op, 4) OR (state, substr(op, 4)) IN ({_LEGAL}) THEN substr(op, 4) ELSE state END,
    CASE WHEN op = 'pin' THEN CASE WHEN pins > 0 OR state = 'pinned' OR (state, 'pinned') IN ({_LEGAL}) THEN pins + 1 ELSE pins END
         WHEN op = 'unpin' THEN greatest(pins - 1, 0) ELSE pins END,
    CASE WHEN op = 'pin' THEN CASE WHEN pins > 0 OR state = 'pinned' OR (state, 'pinned') IN ({_LEGAL}) THEN rejected ELSE rejected + 1 END
         WHEN op = 'unpin' THEN rejected
         WHEN state = substr(op, 4) OR (state, substr(op, 4)) IN ({_LEGAL}) THEN rejected ELSE rejected + 1 END
  FROM folded f JOIN steps s ON s.object_id = f.object_id AND s.k = f.k + 1)
SELECT object_id, arg_max(state, k) AS state, arg_max(pins, k) AS pin_count, arg_max(rejected, k) AS rejected FROM folded GROUP BY object_id""")
def lifecycle_snapshot(t):
    return lifecycle.fold(t("v_store_events"))


# -- traces -------------------------------------------------------------------------------------------------


@query("""SELECT transfer_id, CAST(coalesce(sum(bytes) FILTER (WHERE event_type IN ('chunk_sent', 'get_chunk_sent')), 0) AS BIGINT) AS bytes_sent,
CAST(coalesce(sum(bytes) FILTER (WHERE event_type = 'chunk_received'), 0) AS BIGINT) AS bytes_received,
count(*) FILTER (WHERE event_type IN ('chunk_retry', 'chunk_retried')) AS retries, count(*) FILTER (WHERE event_type IN ('chunk_timeout', 'transfer_timeout')) AS timeouts,
max(duration_ms) AS duration_ms, arg_max(reason_code, line_no) FILTER (WHERE reason_code <> '') AS reason_code
FROM v_trace GROUP BY transfer_id""")
def trace_summary(t):
    return traces.summarize(t("v_trace"), "transfer_id")


@query("""SELECT path_name, count(*) AS acks, CAST(quantile_disc(duration_ms, 0.5) AS BIGINT) AS p50_ms, CAST(quantile_disc(duration_ms, 0.95) AS BIGINT) AS p95_ms
FROM v_trace WHERE event_type = 'chunk_ack' GROUP BY path_name""")
def chunk_ack_nearest_rank(t):
    return traces.ack_latency(t("v_trace"), "path_name")


@query("""WITH RECURSIVE steps AS (SELECT path_name, event_type, duration_ms, row_number() OVER (PARTITION BY path_name ORDER BY line_no) AS k FROM v_trace
  WHERE path_name IS NOT NULL AND event_type IN ('chunk_ack', 'chunk_timeout', 'chunk_retry')),
folded AS (
  SELECT path_name, CAST(0 AS BIGINT) AS k, 'healthy' AS health, CAST(0 AS BIGINT) AS failures, CAST(0 AS BIGINT) AS timeouts, CAST(NULL AS DOUBLE) AS ewma FROM (SELECT DISTINCT path_name FROM steps)
  UNION ALL
  SELECT f.path_name, s.k,
    CASE WHEN health = 'dead' THEN 'dead' WHEN event_type = 'chunk_ack' THEN 'healthy' WHEN failures + 1 >= 3 THEN 'dead'
         WHEN event_type = 'chunk_timeout' OR failures + 1 >= 2 THEN 'degraded' ELSE health END,
    CASE WHEN event_type <> 'chunk_ack' THEN failures + 1 WHEN health = 'dead' THEN failures ELSE 0 END,
    timeouts + CASE WHEN event_type = 'chunk_timeout' THEN 1 ELSE 0 END,
    CASE WHEN event_type <> 'chunk_ack' OR duration_ms IS NULL THEN ewma WHEN ewma IS NULL THEN CAST(duration_ms AS DOUBLE) ELSE 0.25::DOUBLE * duration_ms + 0.75::DOUBLE * ewma END
  FROM folded f JOIN steps s ON s.path_name = f.path_name AND s.k = f.k + 1)
SELECT path_name, arg_max(health, k) AS health, arg_max(failures, k) AS failures, arg_max(timeouts, k) AS timeouts,
round(arg_max(ewma, k) FILTER (WHERE ewma IS NOT NULL), 6) AS ewma_ms FROM folded GROUP BY path_name""")
def path_health(t):
    return traces.path_health(t("v_trace")).withColumn("ewma_ms", F.round("ewma_ms", 6))


# -- serving ------------------------------------------------------------------------------------------------


def summary_sql(by: str) -> str:
    ok = "FILTER (WHERE status BETWEEN 200 AND 299 AND error IS NULL)"
    return f"""SELECT {by}, count(*) AS request_count, count(*) {ok} AS success_count, count(*) - count(*) {ok} AS error_count,
round((count(*) - count(*) {ok}) / count(*), 6) AS error_rate, round(quantile_cont(latency_ms, 0.5) {ok}, 6) AS p50_latency_ms,
round(quantile_cont(latency_ms, 0.95) {ok}, 6) AS p95_latency_ms, round(avg(latency_ms) {ok}, 6) AS mean_latency_ms,
round(quantile_cont(ttft_ms, 0.5) {ok}, 6) AS p50_ttft_ms, CAST(coalesce(sum(output_token_count) {ok}, 0) AS BIGINT) AS output_tokens
FROM v_requests GROUP BY {by}"""


@query(summary_sql("mode"))
def request_summary(t):
    return serving.summary(t("v_requests"), "mode")


@query(summary_sql("mode, phase"))
def phase_summary(t):
    return serving.summary(t("v_requests"), "mode", "phase")


@query("""SELECT mode, count(*) FILTER (WHERE n > 1) AS repeated_prefixes, CAST(sum(n) AS BIGINT) AS requests,
CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) AS reuses
FROM (SELECT mode, prefix_id, count(*) AS n FROM v_requests GROUP BY ALL) GROUP BY mode""")
def repeated_prefix_groups(t):
    return serving.repeated_prefixes(t("v_requests"))


@query("""SELECT prefix_id, request_id, place FROM (SELECT *, row_number() OVER (PARTITION BY prefix_id ORDER BY ord) AS place FROM v_requests WHERE phase = 'measured') WHERE place <= 3""")
def first_n_per_prefix(t):
    return serving.first_per_prefix(t("v_requests"), 3).select("prefix_id", "request_id", "place")


@query("""SELECT conv_id, turn, rank() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) > 1 AS expected_cache_reuse FROM conversations""")
def expected_reuse_flags(t):
    return serving.expected_reuse(t("conversations"), "conv_id", "turn", "role", "text").select("conv_id", "turn", "expected_cache_reuse")


RUNS = "s AS (" + summary_sql("mode") + """),
results AS (SELECT *, CASE mode WHEN 'mode_c' THEN 1 WHEN 'mode_a' THEN 2 ELSE 3 END AS run_order, CASE WHEN mode = 'mode_c' THEN 'skipped' ELSE 'completed' END AS status,
  CASE WHEN mode = 'mode_c' THEN 'server not available' END AS skip_reason FROM s)"""


def results_of(t):
    """Summaries as results of a run in which one mode was skipped."""
    order = F.when(F.col("mode") == "mode_c", 1).when(F.col("mode") == "mode_a", 2).otherwise(3)
    skipped = F.col("mode") == "mode_c"
    return serving.summary(t("v_requests"), "mode").select("*", order.alias("run_order"), F.when(skipped, "skipped").otherwise("completed").alias("status"), F.when(skipped, "server not available").alias("skip_reason"))


@query("WITH " + RUNS + """, base AS (SELECT * FROM results WHERE status = 'completed' ORDER BY run_order LIMIT 1)
SELECT r.run_order, b.mode AS baseline_mode, r.mode AS candidate_mode, CASE WHEN r.status = 'completed' THEN 'compared' ELSE 'skipped' END AS status,
CASE WHEN r.status = 'completed' THEN round(r.p50_latency_ms - b.p50_latency_ms, 6) END AS latency_delta_ms,
CASE WHEN r.status = 'completed' THEN round((r.p50_latency_ms - b.p50_latency_ms) / nullif(b.p50_latency_ms, 0) * 100, 6) END AS latency_delta_pct,
CASE WHEN r.status = 'completed' THEN round(r.p50_ttft_ms - b.p50_ttft_ms, 6) END AS ttft_delta_ms,
CASE WHEN r.status = 'completed' THEN round((r.p50_ttft_ms - b.p50_ttft_ms) / nullif(b.p50_ttft_ms, 0) * 100, 6) END AS ttft_delta_pct,
CASE WHEN r.status = 'completed' THEN round(r.error_rate - b.error_rate, 6) END AS error_rate_delta,
CASE WHEN r.status <> 'completed' THEN coalesce(r.skip_reason, 'not completed') WHEN r.p50_ttft_ms - b.p50_ttft_ms IS NULL THEN 'TTFT unavailable for one or both modes' ELSE '' END AS notes,
CASE WHEN r.status <> 'completed' THEN coalesce(r.skip_reason, 'not completed') END AS skipped_reason FROM results r, base b""")
def mode_comparison(t):
    return serving.compare_modes(results_of(t))


NORMAL = "regexp_replace(regexp_replace({0}, '" + serving.WHITE.replace("{", "{{").replace("}", "}}") + r"+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"""SELECT request_id, CASE WHEN NOT coalesce(r.here, false) THEN 'missing_reference' WHEN NOT coalesce(c.here, false) THEN 'missing_candidate'
WHEN r.output_text IS NOT DISTINCT FROM c.output_text THEN 'exact'
WHEN {NORMAL.format('r.output_text')} IS NOT DISTINCT FROM {NORMAL.format('c.output_text')} THEN 'normalized' ELSE 'mismatch' END AS outcome
FROM (SELECT *, true AS here FROM v_responses_ref) r FULL JOIN (SELECT *, true AS here FROM v_responses_cand) c USING (request_id)""")
def response_compare(t):
    return serving.compare_responses(t("v_responses_ref"), t("v_responses_cand"))


@query("WITH " + RUNS + """, counted AS (SELECT mode, count(*) FILTER (WHERE phase = 'measured') AS measured FROM v_requests GROUP BY mode),
r AS (SELECT r.*, c.measured, concat('rep1:', r.mode) AS label FROM results r JOIN counted c ON c.mode = r.mode),
failures AS (
  SELECT -1 AS run_order, 1 AS place, 'expected 4 mode results, found ' || count(*) AS failure FROM r HAVING count(*) <> 4
  UNION ALL SELECT -1, 2, 'correctness checking failed'
  UNION ALL SELECT run_order, 0, label || ' did not complete: ' || coalesce(skip_reason, 'None') FROM r WHERE status <> 'completed'
  UNION ALL SELECT run_order, 1, label || ' has zero measured samples' FROM r WHERE status = 'completed' AND measured <= 0
  UNION ALL SELECT run_order, 3, label || ' did not report local cache store and retrieve activity' FROM r WHERE status = 'completed' AND mode = 'mode_a' AND NOT request_count > 1000000000
  UNION ALL SELECT run_order, 6, label || ' store audit was not clean' FROM r WHERE status = 'completed' AND mode = 'mode_b')
SELECT CASE WHEN count(*) = 0 THEN 'pass' ELSE 'failed' END AS status, count(*) AS failure_count, string_agg(failure, chr(10) ORDER BY run_order, place) AS failures FROM failures""")
def completion_gate(t):
    measured = t("v_requests").groupBy("mode").agg(F.count_if(F.col("phase") == "measured").alias("measured_requests"))
    flags = {"missing_artifacts": F.lit(False), "local_activity": F.col("request_count") > 1_000_000_000, "store_put_get": F.lit(True), "store_activity": F.lit(True), "fsck_clean": F.lit(False)}
    results = results_of(t).join(measured, "mode").select("*", F.lit(1).alias("repetition"), F.lit(None).cast("string").alias("error"), *(v.alias(k) for k, v in flags.items()))
    return serving.gate(results, 4, "fail", False, "mode_a", "mode_b")


@query("""WITH c AS (SELECT mode, prefix_id, phase, count(*) AS n FROM v_requests GROUP BY ALL)
SELECT a.mode, a.prefix_id, b.n - a.n AS delta FROM c a JOIN c b USING (mode, prefix_id) WHERE a.phase = 'cache_population' AND b.phase = 'measured'""")
def counter_delta(t):
    counts = t("v_requests").groupBy("mode", "prefix_id", "phase").agg(F.count(F.lit(1)).alias("n"))
    return serving.counter_delta(counts.where("phase = 'cache_population'"), counts.where("phase = 'measured'"), ["mode", "prefix_id"], "n")


@query("""SELECT CAST(sum(value) FILTER (WHERE name LIKE '%click%' AND name LIKE '%total%') AS BIGINT) AS total,
count(*) FILTER (WHERE name LIKE '%click%' AND name LIKE '%total%') AS matches
FROM (SELECT concat(event_type, '_total_', user_id) AS name, count(*) AS value FROM events GROUP BY event_type, user_id)""")
def metric_pattern_sum(t):
    metrics = t("events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("value"))
    return serving.pattern_sum(metrics.select(F.concat("event_type", F.lit("_total_"), F.col("user_id").cast("string")).alias("name"), "value"), ["click", "total"])


# -- texts and payloads -------------------------------------------------------------------------------------


@query(f"SELECT doc_id, sha256(s) AS normalized_sha256, length(s) AS n_chars FROM (SELECT doc_id, lower({NORMAL.format('text')}) AS s FROM documents)")
def normalize_text(t):
    s = serving.normalized(F.col("text"), lower=True)
    return t("documents").select("doc_id", F.sha2(s, 256).alias("normalized_sha256"), F.length(s).cast("long").alias("n_chars"))


@query("SELECT doc_id, greatest(1, (length(text) + 3) // 4) AS token_estimate FROM documents")
def token_estimate(t):
    return t("documents").select("doc_id", chunks.token_estimate(F.length("text")).alias("token_estimate"))


@query(f"""SELECT doc_id, i AS chunk_index, i * {CHUNK} AS "offset", least({CHUNK}, n - i * {CHUNK}) AS len
FROM (SELECT doc_id, octet_length(encode(text)) AS n, unnest(range(0, (octet_length(encode(text)) + {CHUNK - 1}) // {CHUNK})) AS i FROM documents)""")
def chunk_layout(t):
    payloads = t("documents").select("doc_id", F.col("text").cast("binary").alias("payload"))
    return chunks.layout(payloads, "doc_id", "payload", CHUNK).drop("hash")


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY ALL")
def prefix_dedup(t):
    return chunks.equal_contents(t("documents"), "doc_id", "text")


@query()
def object_identity_blake3(t):
    return bounded(t("documents")).select("doc_id", blake3_hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("payload_hash"))


@query("""WITH r AS (SELECT mode, prefix_id, ord > min(ord) OVER (PARTITION BY mode, prefix_id) AS reuse, output_token_count AS chars FROM v_requests),
per AS (SELECT mode, prefix_id, count(*) AS n, count(*) FILTER (WHERE reuse) AS reuse, sum(chars) AS chars FROM r GROUP BY ALL)
SELECT mode, CAST(sum(n) AS BIGINT) AS request_count, count(*) AS actual_repeat_groups, CAST(sum(reuse) AS BIGINT) AS expected_cache_reuse_count, CAST(sum(n - 1) AS BIGINT) AS repeated_prefix_request_count,
round(sum(n - 1) / sum(n), 6) AS repeated_prefix_ratio, round(coalesce(sum(chars), 0) / sum(n), 6) AS average_prompt_chars FROM per GROUP BY mode""")
def workload_summary(t):
    requests = t("v_requests").select(F.concat_ws("|", "mode", "prefix_id").alias("group"), "mode", "prefix_id", "ord", F.col("output_token_count").alias("prompt_chars"))
    return serving.workload_summary(serving.expected_reuse(requests, "group", "ord"), "mode")


# -- descriptors --------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN doc_id % 16 BETWEEN 1 AND 13 THEN 'rejected' ELSE 'accepted' END AS status,
CASE doc_id % 16 WHEN 1 THEN 'unknown_schema_version' WHEN 2 THEN 'unknown_object_type' WHEN 3 THEN 'missing_required_field' WHEN 4 THEN 'extra_field_rejected'
  WHEN 5 THEN 'invalid_field_type' WHEN 6 THEN 'schema_validation_failed' WHEN 7 THEN 'unsupported_compression' WHEN 8 THEN 'byte_length_mismatch' WHEN 9 THEN 'payload_hash_mismatch'
  WHEN 10 THEN 'descriptor_hash_mismatch' WHEN 11 THEN 'object_id_mismatch' WHEN 12 THEN 'parse_error'
  WHEN 13 THEN CASE WHEN doc_id % 3 = 0 THEN 'opaque_wrong_engine_name' ELSE 'wrong_engine_name' END ELSE 'accepted' END AS reason_code FROM documents""")
def object_validation(t):
    return validation.validate(descriptors(t("documents"))).select("doc_id", "status", "reason_code")


@query()
def object_identity(t):
    found = descriptors(t("documents")).withColumn("found", identity_of(F.col("metadata"), F.col("payload")))
    return found.select("doc_id", "found.payload_hash", "found.descriptor_hash", "found.object_id")


@query()
def manifest_identity(t):
    none = F.lit(None).cast("string")
    return bounded(t("v_manifests")).select("manifest_id", manifest_id(F.col("manifest_type"), F.col("model_hash"), none, none, F.col("prefix_hash"), F.col("token_range_start"), F.col("token_range_end")).alias("derived_id"))


# -- lists and phases ---------------------------------------------------------------------------------------


@query("""SELECT manifest_id, model_hash, prefix_hash, pin_count FROM v_manifests WHERE manifest_type = 'prefix_manifest' AND prefix_hash = 'prefix-src1' ORDER BY manifest_id LIMIT 40""")
def list_manifests_filtered(t):
    return manifests.list_manifests(t("v_manifests"), 40, manifest_type="prefix_manifest", prefix_hash="prefix-src1").select("manifest_id", "model_hash", "prefix_hash", "pin_count")


@query(INDEX + f"""SELECT idx.engine_name, idx.integration_name, idx.opaque_engine_key_hash, idx.object_id, state, coalesce({CAN_SERVE}, false) AS serveable
FROM idx LEFT JOIN v_objects o ON o.object_id = idx.object_id WHERE engine_name = 'engine-en' ORDER BY 1, 2, 3 LIMIT 30 OFFSET 5""")
def list_opaque_keys_paged(t):
    return catalog.list_opaque_page(catalog.opaque_index(t("v_compat")), t("v_objects"), engine_name="engine-en", limit=30, offset=5).drop("created_at_unix_ms")


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY prefix_id ORDER BY ord) AS k, count(*) OVER (PARTITION BY prefix_id) AS n FROM v_requests WHERE phase = 'measured')
SELECT prefix_id, i AS place, concat('cache_population-', lpad(CAST(i AS STRING), 2, '0'), '-', request_id) AS request_id, request_id AS source_id
FROM m, (SELECT unnest(range(0, 4)) AS i) WHERE k = least(i + 1, n)""")
def phase_population(t):
    return phases.population(t("v_requests"), 4)


@query("""SELECT concat('engine_warmup-', lpad(CAST(i AS STRING), 5, '0')) AS request_id, concat('engine_warmup-prefix-', lpad(CAST(i AS STRING), 4, '0')) AS prefix_id
FROM (SELECT unnest(range(0, 100)) AS i) WHERE concat('engine_warmup-prefix-', lpad(CAST(i AS STRING), 4, '0')) NOT IN (SELECT prefix_id FROM v_requests WHERE phase = 'measured') ORDER BY i LIMIT 12""")
def phase_warmup(t):
    return phases.warmup(t("v_requests"), 12)


@query("""SELECT prefix_id, count(*) AS requests FROM v_requests WHERE phase = 'engine_warmup' AND prefix_id IN (SELECT prefix_id FROM v_requests WHERE phase = 'measured') GROUP BY ALL""")
def phase_leaks(t):
    return phases.leaks(t("v_requests"))


@query("""SELECT mode, phase, count(*) AS requests, count(DISTINCT prefix_id) AS prefixes FROM v_requests GROUP BY ALL""")
def phase_counts(t):
    return phases.phase_counts(t("v_requests"), "mode")
