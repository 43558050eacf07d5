"""Catalog and serving tables derived from the star schema.

One SQL text for each view, valid on Spark and on DuckDB, so that a query and its oracle read the same input.
Remainders of ids stand in for facts that the star schema lacks (an evicted object has no location, a lost
file has no row); they shape the input and don't make it smaller for a query's sake.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_objects": """
SELECT concat('obj-', lpad(CAST(doc_id AS STRING), 10, '0')) AS object_id,
       CASE WHEN doc_id % 3 = 0 THEN 'opaque_engine_blob' ELSE 'native_kv_page' END AS object_type,
       n_chars AS byte_length,
       CASE doc_id % 10 WHEN 0 THEN 'pinned' WHEN 1 THEN 'committed' WHEN 2 THEN 'evictable' WHEN 3 THEN 'quarantined'
            WHEN 4 THEN 'evicted' WHEN 5 THEN 'corrupt' ELSE 'verified' END AS state,
       CASE WHEN doc_id % 10 = 0 THEN 1 + doc_id % 3 ELSE CAST(0 AS BIGINT) END AS pin_count,
       doc_id % 17 AS access_count,
       CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 1700000000000 + (doc_id * 7919 % 100000) * 1000 END AS last_accessed_unix_ms,
       CASE WHEN doc_id % 4 = 0 THEN 1700000000000 + (doc_id * 104729 % 100000) * 1000 ELSE NULL END AS ttl_expires_at_unix_ms,
       1690000000000 + doc_id * 1000 AS created_at_unix_ms, concat('d-', md5(text)) AS descriptor_hash, md5(text) AS payload_hash
FROM {documents}""",
    "v_locations": """
SELECT concat('obj-', lpad(CAST(doc_id AS STRING), 10, '0')) AS object_id, 'disk' AS tier, n_chars + 512 AS bytes_on_disk,
       concat('objects/', CAST(doc_id % 97 + CASE WHEN doc_id % 37 = 5 THEN 1 ELSE 0 END AS STRING), '.meta') AS meta_path,
       concat('objects/', CAST(doc_id % 97 AS STRING), '.payload') AS payload_path
FROM {documents} WHERE doc_id % 10 <> 4""",
    "v_compat": """
SELECT concat('obj-', lpad(CAST(doc_id AS STRING), 10, '0')) AS object_id,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('model-', lang) END AS model_hash,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('prefix-', source) END AS prefix_hash,
       concat('engine-', lang) AS engine_name, concat('integ-', source) AS integration_name,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 4 END AS layer_id,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 7 END AS kv_block_id,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 7) * 256 END AS token_range_start,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 7) * 256 + 256 END AS token_range_end,
       CASE WHEN doc_id % 3 = 0 THEN md5(text) ELSE NULL END AS opaque_engine_key_hash,
       1690000000000 + doc_id * 1000 AS created_at_unix_ms
FROM {documents}""",
    "v_files": """
SELECT concat('obj-', lpad(CAST(doc_id + CASE WHEN doc_id % 50 = 7 THEN 1000000 ELSE 0 END AS STRING), 10, '0')) AS object_id,
       n_chars + CASE WHEN doc_id % 31 = 1 THEN 1 ELSE 0 END AS payload_bytes, doc_id % 43 <> 8 AS has_meta, doc_id % 47 <> 9 AS has_payload,
       doc_id % 29 <> 10 AS metadata_ok, CASE doc_id % 59 WHEN 3 THEN 'payload_hash_mismatch' WHEN 4 THEN 'descriptor_hash_mismatch'
       WHEN 5 THEN 'object_id_mismatch' WHEN 6 THEN 'byte_length_mismatch' WHEN 7 THEN 'wrong_dtype' ELSE 'accepted' END AS reason_code,
       concat('obj-', lpad(CAST(doc_id + CASE WHEN doc_id % 50 = 7 THEN 1000000 WHEN doc_id % 23 = 2 THEN 1 ELSE 0 END AS STRING), 10, '0')) AS found_id,
       concat('d-', md5(text), CASE WHEN doc_id % 19 = 1 THEN 'x' ELSE '' END) AS found_descriptor_hash,
       concat(md5(text), CASE WHEN doc_id % 17 = 1 THEN 'x' ELSE '' END) AS found_payload_hash,
       concat('objects/', CAST(doc_id % 97 AS STRING), '.meta') AS meta_path, concat('objects/', CAST(doc_id % 97 AS STRING), '.payload') AS payload_path,
       doc_id % 100 <> 7 AS at_own_path
FROM {documents} WHERE doc_id % 10 <> 4 AND doc_id % 41 <> 6""",
    "v_manifests": """
SELECT concat('man-', CAST(o_orderkey AS STRING)) AS manifest_id, 'prefix_manifest' AS manifest_type,
       'model-en' AS model_hash, concat('prefix-src', CAST(o_custkey % 4 AS STRING)) AS prefix_hash,
       CAST(0 AS BIGINT) AS token_range_start, CAST(1024 AS BIGINT) AS token_range_end, o_orderkey % 3 AS pin_count,
       CASE o_orderkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'incomplete' ELSE 'complete' END AS completeness_state
FROM {orders}""",
    "v_names": """
SELECT concat(p_brand, '-', CAST(p_partkey AS STRING)) AS object_id, p_partkey % 5 <> 0 AS valid FROM {part}""",
    "v_staging": """
SELECT concat('put-', CAST(s_suppkey AS STRING)) AS object_id FROM {supplier}""",
    "v_members": """
SELECT concat('man-', CAST(l_orderkey AS STRING)) AS manifest_id, concat('obj-', lpad(CAST(l_partkey AS STRING), 10, '0')) AS object_id,
       CASE WHEN MIN(l_suppkey) % 9 = 0 THEN NULL ELSE MIN(l_suppkey) % 4 END AS layer_id,
       CAST(MIN(l_linenumber) AS BIGINT) AS kv_block_id,
       MAX(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS required
FROM {lineitem} GROUP BY l_orderkey, l_partkey""",
    "v_store_events": """
SELECT event_id AS seq, concat('obj-', lpad(CAST(user_id AS STRING), 10, '0')) AS object_id,
       1700000000000 + event_id * 1000 AS timestamp_unix_ms,
       CASE event_id % 8 WHEN 0 THEN 'pin' WHEN 1 THEN 'unpin' WHEN 2 THEN 'get' WHEN 3 THEN 'put' WHEN 4 THEN 'ttl_set'
            WHEN 5 THEN 'ttl_clear' WHEN 6 THEN 'to_verified' ELSE 'to_evictable' END AS op,
       CAST(FLOOR(value) AS BIGINT) AS bytes
FROM {events}""",
    "v_requests": """
SELECT concat('req-', CAST(event_id AS STRING)) AS request_id, event_id AS ord, concat('prefix-', CAST(user_id AS STRING)) AS prefix_id,
       CASE user_id % 3 WHEN 0 THEN 'mode_a' WHEN 1 THEN 'mode_b' ELSE 'mode_c' END AS mode,
       CASE WHEN event_id % 10 = 0 THEN 'engine_warmup' WHEN event_id % 10 = 1 THEN 'cache_population' ELSE 'measured' END AS phase,
       CASE WHEN event_id % 97 = 5 THEN NULL WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
       CASE WHEN event_id % 89 = 3 THEN 'timeout' ELSE NULL END AS error,
       value AS latency_ms, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value / 4 END AS ttft_ms, event_id % 32 AS output_token_count
FROM {events}""",
    "v_trace": """
SELECT event_id AS line_no, concat('tx-', CAST(user_id AS STRING)) AS transfer_id, concat('path-', CAST(user_id % 4 AS STRING)) AS path_name,
       CASE event_id % 6 WHEN 0 THEN 'chunk_sent' WHEN 1 THEN 'chunk_received' WHEN 2 THEN 'chunk_retry'
            WHEN 3 THEN 'chunk_timeout' WHEN 4 THEN 'get_chunk_sent' ELSE 'chunk_ack' END AS event_type,
       CASE WHEN event_id % 6 IN (0, 1, 4) THEN CAST(FLOOR(value * 1024) AS BIGINT) ELSE NULL END AS bytes,
       CASE WHEN event_id % 6 = 5 THEN CAST(FLOOR(value) AS BIGINT) ELSE NULL END AS duration_ms,
       CASE WHEN event_type = 'error' THEN 'chunk_ack_timeout' WHEN event_id % 7 = 2 THEN '' ELSE NULL END AS reason_code
FROM {events}""",
    "v_responses_ref": """
SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS request_id, text AS output_text
FROM {conversations} WHERE conv_id % 11 <> 3""",
    "v_responses_cand": """
SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS request_id,
       CASE conv_id % 5 WHEN 0 THEN concat('  ', text, ' ') WHEN 1 THEN replace(text, 'a', 'b') ELSE text END AS output_text
FROM {conversations} WHERE conv_id % 13 <> 4""",
}
TABLES = ("documents", "orders", "lineitem", "events", "conversations", "part", "supplier")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view; columns that a query leaves out aren't read."""
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text})


def with_views(sql: str) -> str:
    """A DuckDB statement over the views that it names."""
    used = [f"{name} AS ({text.format(**{t: t for t in TABLES})})" for name, text in VIEWS.items() if name in sql]
    body = sql.strip()
    if not used:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(used) + ",\n" + body[14:].lstrip()
    return "WITH " + ",\n".join(used) + (",\n" + body[4:].lstrip() if body.upper().startswith("WITH") else "\n" + body)
