import json

import pytest
from pyspark.sql import functions as F

from kvlens.functions.identity import blake3_hex, blake3_many, canonical_json, strict_json
from kvlens.operators import audit, chunks, eviction, lifecycle, manifests, phases, serving, traces
from kvlens.sources import files
from kvlens.streaming import logs


def test_blake3_known_answers():
    pattern = lambda n: bytes(i % 251 for i in range(n))
    sizes = [0, 1, 1024, 1025, 3072, 5000]
    got = [d.hex() for d in blake3_many([pattern(n) for n in sizes])]
    # Published digests of these lengths of the pattern.
    assert got[0] == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert got[1] == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert got[2] == "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"
    assert got[3] == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"
    assert got[4] == "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2"
    assert got[5] == blake3_many([pattern(5000)])[0].hex()


def test_known_payloads():
    # Published digests of payloads of these lengths of the pattern.
    known = {4096: "015094013f57a5277b59d8475c0501042c0b642e531b0a1c8f58d2163229e969", 786432: "acca1229e537587e75108d1a25c3e28d7ce8036556137dc2973d9289187e58d4"}
    for n, digest in known.items():
        assert blake3_many([bytes(i % 251 for i in range(n))])[0].hex() == digest


def test_blake3_column(spark):
    df = spark.createDataFrame([(1, bytearray(b"")), (2, None)], "i int, b binary")
    got = {r.i: r.h for r in df.select("i", blake3_hex("b").alias("h")).collect()}
    assert got[2] is None and got[1].startswith("blake3:af1349b9")


def test_canonical_json():
    assert canonical_json({"b": [1, True, None], "a": "é"}) == '{"a":"é","b":[1,true,null]}'.encode()
    for bad in ({"a": 1.5}, {"a": 1 << 64}):
        with pytest.raises(ValueError):
            canonical_json(bad)
    with pytest.raises(ValueError):
        strict_json('{"a":1,"a":2}')


def test_every_transition(spark):
    states = list(lifecycle.TRANSITIONS)
    pairs = spark.createDataFrame([(a, b) for a in states for b in states], "a string, b string")
    for r in pairs.select("a", "b", lifecycle.allowed(F.col("a"), F.col("b")).alias("ok")).collect():
        assert r.ok == (r.a == r.b or r.b in lifecycle.TRANSITIONS[r.a])


def test_fold_in_two_parts_and_stream_rules(spark):
    ops = ["pin", "pin", "unpin", "to_evictable", "unpin", "unpin", "to_evictable", "to_committed", "force_missing", "pin"]
    log = spark.createDataFrame([(i, "x", op) for i, op in enumerate(ops)], "seq long, object_id string, op string")
    whole = lifecycle.fold(log).first()
    first = lifecycle.fold(log.where("seq < 4"))
    second = lifecycle.fold(log.where("seq >= 4"), first).first()
    now = ("verified", 0, 0)
    for op in ops:
        now = logs.fold_step(*now, op)
    assert (whole.state, whole.pin_count, whole.rejected) == now
    assert (second.state, second.pin_count, first.first().rejected + second.rejected) == now


def test_lifecycle_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"seq": i, "object_id": "x", "op": op}) for i, op in enumerate(["pin", "unpin", "to_evictable"])))
    stream = spark.readStream.schema("seq long, object_id string, op string").json(str(tmp_path / "in"))
    q = logs.lifecycle_states(stream).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("states").collect()] == [("x", "evictable", 0, 0)]


def test_running_totals(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 13).alias("v"))
    rows = sorted((r.k, r.v, r.before, r.position) for r in eviction.running(df, [F.col("k").asc()], "v", 7).collect())
    total = 0
    for i, (_, v, before, position) in enumerate(rows):
        assert (before, position) == (total, i + 1)
        total += v


def test_empty_plan(spark):
    objects = spark.createDataFrame([], "object_id string, state string, pin_count long, last_accessed_unix_ms long, ttl_expires_at_unix_ms long")
    locations = spark.createDataFrame([], "object_id string, tier string, bytes_on_disk long")
    plan = eviction.plan(objects, locations, "lru", 0, 0)
    assert plan.count() == 0 and eviction.outcome(plan, 10, 5) == "no_eligible_candidates" and eviction.outcome(plan, 5, 5) == "target_already_reached"


def test_reassembly(spark):
    got = spark.createDataFrame([("a", 1, bytearray(b"d")), ("a", 0, bytearray(b"bc")), ("a", 0, bytearray(b"bc")), ("b", 0, bytearray(b"x")), ("c", 0, bytearray(b"x")), ("c", 0, bytearray(b"y"))], "transfer string, chunk_index int, data binary")
    want = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1), ("d", 1)], "transfer string, total_chunks int")
    out = {r.transfer: (r.outcome, r.payload and bytes(r.payload)) for r in chunks.reassemble(got, want).collect()}
    assert out == {"a": ("ok", b"bcd"), "b": ("incomplete", None), "c": ("conflict", None), "d": ("incomplete", None)}


def test_duplicate_responses_raise(spark):
    one = spark.createDataFrame([("r", "x"), ("r", "x")], "request_id string, output_text string")
    with pytest.raises(Exception, match="duplicate request_id"):
        serving.compare_responses(one, one).collect()


def test_path_health(spark):
    events = [("p", 1, "chunk_retry", None), ("p", 2, "chunk_retry", None), ("q", 1, "chunk_timeout", None), ("q", 2, "chunk_ack", 10), ("q", 3, "chunk_ack", 20)]
    df = spark.createDataFrame(events, "path_name string, line_no long, event_type string, duration_ms long")
    got = {r.path_name: (r.health, r.failures, r.timeouts, r.ewma_ms) for r in traces.path_health(df).collect()}
    assert got["p"][:3] == ("degraded", 2, 0) and got["q"] == ("healthy", 0, 1, 12.5)


def test_readers(spark, tmp_path):
    trace = tmp_path / "t.jsonl"
    trace.write_text('{"event_type":"chunk_sent","bytes":5}\n\n[1]\n')
    assert [(r.event_type, r.bytes) for r in files.read_trace(spark, str(trace)).collect()] == [("chunk_sent", 5)]
    trace.write_text("{bad\n")
    with pytest.raises(Exception, match="not JSON"):
        files.read_trace(spark, str(trace)).collect()
    events = tmp_path / "c.jsonl"
    events.write_text('{"event":"connector_get_completed","bytes":3}\n{bad\n')
    one = files.connector_counts(files.read_connector(spark, str(events))).first()
    assert (one.parse_error_count, one.get_count, one.bytes) == (1, 1, 3)
    assert files.read_connector(spark, str(events), "skip").count() == 1
    lines = spark.createDataFrame([(1, "# HELP x"), (2, 'x{a="1"} 3'), (3, 'x{a="2"} 4.5'), (4, "y 1")], "line_no int, value string")
    assert {r.name: r.value for r in files.parse_prometheus(lines).collect()} == {"x": 4.5, "y": 1.0}


def test_files_and_artifacts(spark, tmp_path):
    root = tmp_path / "store"
    root.mkdir()
    (root / ("a" * 64 + ".meta.json")).write_text("{}")
    (root / ("a" * 64 + ".payload.bin")).write_text("xyz")
    (root / "odd.txt").write_text("?")
    kinds = sorted(r.kind for r in files.read_object_files(spark, str(root)).collect())
    assert kinds == ["invalid", "meta", "payload"]
    listed = spark.createDataFrame(files.artifact_manifest(spark, str(root)).collect())
    (root / "odd.txt").write_text("!!")
    assert [tuple(r) for r in files.verify_artifacts(listed, files.artifact_manifest(spark, str(root))).collect()] == [("odd.txt", "size")]


def test_skip_counts_leave_pinned_objects_out(spark):
    objects = spark.createDataFrame([("a", "pinned", 1), ("b", "staging", 0), ("c", "verified", 0), ("d", "quarantined", 2), ("e", "verified", 0)], "object_id string, state string, pin_count long")
    locations = spark.createDataFrame([("a", "disk"), ("b", "disk"), ("c", "disk"), ("d", "disk")], "object_id string, tier string")
    assert tuple(eviction.skip_counts(objects, locations).first()) == (2, 2)


def test_manifest_states(spark):
    manifests_ = spark.createDataFrame([("m1", "x", "p", 0, 100), ("m2", "x", "p", 0, 100), ("m3", None, "p", 0, 100)], "manifest_id string, model_hash string, prefix_hash string, token_range_start long, token_range_end long")
    compat = spark.createDataFrame([("a", "x", "p", 0, 50), ("b", "x", "p", 50, 200), ("c", None, "p", 0, 50), ("d", "x", "p", 60, 50), ("e", "x", "p", 0, 10)], "object_id string, model_hash string, prefix_hash string, token_range_start long, token_range_end long")
    objects = spark.createDataFrame([(x, "committed" if x == "e" else "verified", 0) for x in "abcde"], "object_id string, state string, pin_count long")
    locations = spark.createDataFrame([(x, "disk") for x in "abcde"], "object_id string, tier string")
    members = spark.createDataFrame([("m1", "a", 0, 0, 1), ("m1", "gone", 0, 1, 1), ("m2", "b", 0, 0, 1), ("m2", "d", 1, 0, 0), ("m3", "c", 0, 0, 1)], "manifest_id string, object_id string, layer_id long, kv_block_id long, required int")
    missing = manifests.missing_members(members, objects, locations, manifests_, compat)
    assert {(r.manifest_id, r.object_id, r.reason) for r in missing.collect()} == {("m1", "gone", "object_absent"), ("m2", "b", "compatibility_mismatch")}
    got = {r.manifest_id: tuple(r)[1:] for r in manifests.completeness(manifests_, members, missing).collect()}
    assert got == {"m1": (2, 1, 1, "incomplete"), "m2": (1, 0, 1, "corrupt"), "m3": (1, 1, 0, "complete")}
    wrong = {(r.object_id, r.mismatch) for r in manifests.identity_violations(manifests_, members, compat).collect()}
    assert wrong == {("b", "token range mismatch"), ("d", "token range mismatch")}
    open_cells = {(r.layer_id, r.kv_block_id) for r in manifests.uncovered(manifests_.where("manifest_id = 'm2'"), members, 2, 2).collect()}
    assert open_cells == {(0, 1), (1, 0), (1, 1)}  # a member that isn't required fills nothing
    expected = spark.createDataFrame([("m1", 0, 0, None, None), ("m1", 5, 5, None, None), ("m1", 0, 1, 7, None)], "manifest_id string, layer_id long, kv_block_id long, token_range_start long, token_range_end long")
    ranged = members.withColumn("token_range_start", F.lit(0).cast("long")).withColumn("token_range_end", F.lit(9).cast("long"))
    assert {(r.layer_id, r.kv_block_id) for r in manifests.unexpected(expected, ranged).collect()} == {(5, 5), (0, 1)}
    asked = spark.createDataFrame([("m1", "e", 1), ("m1", "a", 1), ("m1", "b", 1), ("none", "a", 1)], "manifest_id string, object_id string, required int")
    added = manifests.add_members(asked, manifests_.withColumn("pin_count", F.lit(2).cast("long")), objects, locations, compat)
    assert {(r.manifest_id, r.object_id, r.refused, r.pins) for r in added.collect()} == {("m1", "e", "member is not serveable", 0), ("m1", "a", None, 2), ("m1", "b", "token range mismatch", 0), ("none", "a", "manifest not found", 0)}


def test_a_dead_path_stays_dead(spark):
    events = ["chunk_timeout"] * 3 + ["chunk_ack", "chunk_ack"]
    rows = [("p", i, e, 10 if e == "chunk_ack" else None) for i, e in enumerate(events)] + [("q", 1, "chunk_retry", None), ("q", 2, "chunk_retry", None), ("q", 3, "chunk_ack", 8)]
    df = spark.createDataFrame(rows, "path_name string, line_no long, event_type string, duration_ms long")
    got = {r.path_name: (r.health, r.failures, r.timeouts, r.ewma_ms) for r in traces.path_health(df).collect()}
    assert got == {"p": ("dead", 3, 3, 10.0), "q": ("healthy", 0, 0, 8.0)}


def test_reassembly_checks_indexes_and_digests(spark):
    import hashlib

    data = b"0123456789"
    got = [(t, i, data[4 * i : 4 * i + 4]) for t in ("ok", "bad") for i in range(3)] + [("far", 0, b"0123"), ("far", 5, b"4567"), ("two", 0, b"x"), ("two", 0, b"y"), ("short", 0, b"0123")]
    received = spark.createDataFrame(got, "transfer string, chunk_index long, data binary")
    want = [(t, n, len(data) if n == 3 else 4, hashlib.sha256(data if t != "bad" else b"").hexdigest()) for t, n in (("ok", 3), ("bad", 3), ("far", 2), ("two", 1), ("short", 3))]
    expected = spark.createDataFrame(want, "transfer string, total_chunks long, payload_len long, payload_hash string")
    out = {r.transfer: (r.outcome, r.payload and bytes(r.payload)) for r in chunks.reassemble(received, expected).collect()}
    assert out == {"ok": ("ok", data), "bad": ("hash_mismatch", None), "far": ("out_of_range", None), "two": ("conflict", None), "short": ("incomplete", None)}
    payloads = spark.createDataFrame([("ok", data)], "transfer string, payload binary")
    layouts = chunks.layout(payloads, "transfer", "payload", 4)
    assert {(r.chunk_index, r.outcome) for r in chunks.verify(received.where("transfer = 'ok'").unionByName(spark.createDataFrame([("ok", 7, b"z"), ("ok", 1, b"45"), ("ok", 1, b"4566")], received.schema)), layouts).collect()} == {(0, "ok"), (1, "ok"), (2, "ok"), (7, "unknown_chunk"), (1, "length_mismatch"), (1, "hash_mismatch")}
    assert [tuple(r) for r in chunks.manifest(payloads, "transfer", "payload", 4).collect()] == [("ok", 3, 10, hashlib.sha256(data).hexdigest())]


def test_requests_without_status_are_errors(spark):
    df = spark.createDataFrame([("a", 200, None, 1.0), ("a", None, None, 2.0), ("a", 200, "timeout", 3.0)], "mode string, status int, error string, latency_ms double").selectExpr("*", "CAST(NULL AS double) AS ttft_ms", "CAST(NULL AS long) AS output_token_count")
    r = serving.summary(df, "mode").first()
    assert (r.request_count, r.success_count, r.error_count, r.p50_latency_ms) == (3, 1, 2, 1.0)


def test_reuse_with_ties_and_without_group(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 1, "c"), (None, 5, "x"), (None, 6, "y"), (2, None, "z")], "g long, turn long, text string")
    got = {r.text: r.expected_cache_reuse for r in serving.expected_reuse(df, "g", "turn", "text").collect()}
    assert got == {"a": False, "b": True, "c": True, "x": False, "y": True, "z": False}


def test_audit_modes(spark):
    found = spark.createDataFrame([("object_location_missing", "error", "a", None), ("payload_hash_mismatch", "critical", "b", None), ("byte_length_mismatch", "error", "c", None), ("manifest_member_object_not_serveable", "error", "b", "m"), ("quarantined_object_referenced_by_complete_manifest", "critical", "b", "m")], "finding_type string, severity string, object_id string, manifest_id string")
    state = lambda mode: {(r.object_id, r.manifest_id, r.new_state) for r in audit.repairs(found, mode).collect()}
    assert state("check") == set() and state("repair") == {("a", None, "missing"), (None, "m", "incomplete")}
    assert state("quarantine") == {("b", None, "quarantined"), (None, "m", "corrupt")}
    assert (audit.verdict(found), audit.verdict(found.limit(0)), audit.verdict(found, "repair", 1)) == ("dirty", "clean", "repaired")


def test_normalized_takes_unicode_white_space(spark):
    text = "  a \x1cb　\n c "
    assert spark.createDataFrame([(text,)], "t string").select(serving.normalized(F.col("t"))).first()[0] == "a b c" == " ".join(text.split())


def test_phases(spark):
    rows = [("r1", 1, "b", "measured"), ("r2", 2, "a", "measured"), ("r3", 3, "a", "measured"), ("r4", 4, "a", "measured"), ("r5", 5, "engine_warmup-prefix-0001", "measured"), ("w", 0, "a", "engine_warmup")]
    df = spark.createDataFrame(rows, "request_id string, ord long, prefix_id string, phase string")
    got = [(r.prefix_id, r.place, r.request_id) for r in phases.population(df, 2).orderBy("prefix_id", "place").collect()]
    assert got[:4] == [("a", 0, "cache_population-00-r2"), ("a", 1, "cache_population-01-r3"), ("b", 0, "cache_population-00-r1"), ("b", 1, "cache_population-01-r1")] and len(got) == 6
    assert phases.population(df, 0).count() == 0
    assert [r.prefix_id for r in phases.warmup(df, 3).orderBy("request_id").collect()] == ["engine_warmup-prefix-0000", "engine_warmup-prefix-0002", "engine_warmup-prefix-0003"]
    assert [tuple(r) for r in phases.leaks(df).collect()] == [("a", 1)]
    assert phases.measured(df).count() == 5 and phases.measured(df, 1).count() == 3


def test_members_asked_for_go_through_each_join_once(spark, tmp_path):
    asked = spark.createDataFrame([("m", "a", 1), ("m", "a", 0), ("m", "b", 1), ("none", "a", 1), ("m", "c", 1)], "manifest_id string, object_id string, required int")
    asked.write.parquet(str(tmp_path / "asked"))
    known = spark.createDataFrame([("m", "x", "p", 0, 100, 2, "t")], "manifest_id string, model_hash string, prefix_hash string, token_range_start long, token_range_end long, pin_count long, tokenizer_hash string")
    compat = spark.createDataFrame([("a", "x", "p", 0, 50, "t"), ("b", "x", "p", 0, 50, "u")], "object_id string, model_hash string, prefix_hash string, token_range_start long, token_range_end long, tokenizer_hash string")
    objects = spark.createDataFrame([(x, "verified", 0) for x in "abc"], "object_id string, state string, pin_count long")
    locations = spark.createDataFrame([(x, "disk") for x in "abc"], "object_id string, tier string")
    added = manifests.add_members(spark.read.parquet(str(tmp_path / "asked")), known, objects, locations, compat)
    assert sorted((r.manifest_id, r.object_id, r.refused or "", r.pins) for r in added.collect()) == [("m", "a", "", 0), ("m", "a", "", 2), ("m", "b", "tokenizer_hash mismatch", 0), ("m", "c", "member is not serveable", 0), ("none", "a", "manifest not found", 0)]
    plan = added._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("Join ") == 4
