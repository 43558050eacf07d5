"""Validation of object descriptors: the first failing rule decides on the reason.

A descriptor is JSON text.  It is parsed once to a variant, and every rule is a built-in expression on it, in the
order: version and type, the schema's rules by path, payload and hashes, the target's profile, the meaning of
its fields.  Hashes are the only Python, one step of it, in small Arrow batches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlens.functions.descriptors import Names, object_identity
from kvlens.functions.identity import bounded

#: Kinds of fields, and the sections of a descriptor and of a target profile with their fields.
TEXT, COUNT, POSITIVE, HASH, RANGE, HASHES, SHAPE, ROLE, NOTES = "text", "count", "positive", "hash", "range", "hashes", "shape", "role", "notes"
MODEL = dict.fromkeys(("model_id", "model_revision", "quantization", "dtype"), TEXT) | dict.fromkeys(("model_hash", "tokenizer_hash", "config_hash", "rope_config_hash"), HASH) | dict.fromkeys(("num_layers", "num_attention_heads", "num_kv_heads", "head_dim", "max_position_embeddings"), POSITIVE)
ENGINE = dict.fromkeys(("engine_name", "engine_version", "integration_name", "integration_version", "attention_impl", "kv_layout", "kv_cache_format"), TEXT) | {"block_size_tokens": POSITIVE}
PREFIX = {"token_count": COUNT, "token_range": RANGE, "absolute_position_range": RANGE, "prefix_hash": HASH, "token_hash": HASH, "tokenizer_hash": HASH, "rope_config_hash": HASH, "mm_hashes": HASHES}
NATIVE = {"layer_id": COUNT, "kv_block_id": COUNT, "block_size_tokens": POSITIVE, "block_token_count": COUNT, "token_range": RANGE, "tensor_role": ROLE, "tensor_shape": SHAPE, "tensor_dtype": TEXT, "tensor_layout": TEXT}
OPAQUE = {"engine_key_hash": HASH, "engine_payload_type": TEXT, "engine_key_repr_version": TEXT}
PAYLOAD = {"byte_length": COUNT, "compression": TEXT, "payload_encoding": TEXT}
INTEGRITY = {"descriptor_hash": HASH, "payload_hash": HASH, "object_id_algorithm": "algorithm", "chunk_size_bytes": POSITIVE, "chunk_hashes": HASHES}
PROVENANCE = {"source": TEXT, "notes": NOTES, "producer_commit": TEXT, "producer_hostname": TEXT}
REQUIREMENTS = {"prefix_hash": HASH, "token_hash": HASH, "tokenizer_hash": HASH, "rope_config_hash": HASH, "token_range": RANGE, "absolute_position_range": RANGE, "allow_mm_hashes": HASHES}
SECTIONS = {"model_profile": MODEL, "engine_profile": ENGINE, "payload_profile": PAYLOAD, "integrity": INTEGRITY, "provenance": PROVENANCE}
NULLABLE = {"prefix_profile": PREFIX, "native_tensor_profile": NATIVE, "opaque_engine_profile": OPAQUE}
ROLES = ("key", "value", "kv", "kv_pair")
WIDTHS = {"float16": 2, "bfloat16": 2, "float32": 4}
TYPES = ("native_kv_page", "opaque_engine_blob")
#: What must be equal, with the reason if it isn't: (section, field, target's section, target's field).
NATIVE_EQUAL = [("model_profile", f, "model_profile", f, r) for f, r in (("model_hash", "wrong_model_hash"), ("tokenizer_hash", "wrong_tokenizer_hash"), ("config_hash", "wrong_config_hash"), ("rope_config_hash", "wrong_rope_hash"), ("dtype", "wrong_dtype"), ("num_layers", "wrong_num_layers"), ("num_kv_heads", "wrong_num_kv_heads"), ("head_dim", "wrong_head_dim"))]
NATIVE_EQUAL += [("engine_profile", f, "engine_profile", f, f"wrong_{f}") for f in ("engine_name", "engine_version", "attention_impl", "kv_layout", "block_size_tokens", "kv_cache_format")]
NATIVE_EQUAL += [("prefix_profile", f, "prefix_requirements", g, r) for f, g, r in (("prefix_hash", "prefix_hash", "wrong_prefix_hash"), ("token_hash", "token_hash", "wrong_prefix_hash"), ("tokenizer_hash", "tokenizer_hash", "wrong_tokenizer_hash"), ("rope_config_hash", "rope_config_hash", "wrong_rope_hash"), ("mm_hashes", "allow_mm_hashes", "wrong_prefix_hash"))]
NATIVE_EQUAL += [("native_tensor_profile", "token_range", "prefix_requirements", "token_range", "wrong_token_range"), ("prefix_profile", "absolute_position_range", "prefix_requirements", "absolute_position_range", "wrong_absolute_position_range")]
OPAQUE_EQUAL = [("engine_profile", "engine_name", "engine_profile", "engine_name", "opaque_wrong_engine_name"), ("engine_profile", "integration_name", "engine_profile", "integration_name", "opaque_wrong_integration_name"), ("engine_profile", "kv_cache_format", "engine_profile", "kv_cache_format", "wrong_kv_cache_format"), ("opaque_engine_profile", "engine_key_hash", "opaque_requirements", "engine_key_hash", "opaque_wrong_engine_key")]


class Json:
    """Rules on one JSON column: its text, and the variant that it was parsed to."""

    def __init__(self, text: str, variant: str, names: Names):
        self.text, self.variant, self.names = F.col(text), F.col(variant), names

    def at(self, path: str, kind: str = "variant") -> Column:
        return F.try_variant_get(self.variant, f"$.{path}", kind)

    def type(self, path: str) -> Column:
        """STRING, BIGINT, BOOLEAN, VOID (a JSON null), OBJECT, ARRAY or another; null if there is nothing."""
        return F.regexp_replace(F.schema_of_variant(self.at(path)), "<.*", "")

    def is_null(self, path: str) -> Column:
        return F.coalesce(self.type(path) == "VOID", F.lit(False))

    def keys(self, path: str | None = None) -> Column:
        return F.json_object_keys(self.text if path is None else F.get_json_object(self.text, f"$.{path}"))

    def long(self, path: str) -> Column:
        return self.at(path, "long")

    def string(self, path: str) -> Column:
        return self.at(path, "string")

    # Each rule gives a reason or null.

    def named(self, path: str | None, fields) -> Column:
        """Keys that are missing, or that don't belong there."""
        keys, wanted = self.keys(path), F.array(*map(F.lit, fields))
        return F.when(F.size(F.array_except(wanted, keys)) > 0, "missing_required_field").when(F.size(F.array_except(keys, wanted)) > 0, "extra_field_rejected")

    def field(self, path: str, kind: str) -> Column:
        bad = lambda wanted: F.when(~F.coalesce(self.type(path) == wanted, F.lit(False)), "invalid_field_type")
        fails = lambda rule: F.when(~F.coalesce(rule, F.lit(False)), "schema_validation_failed")
        text = self.string(path)
        if kind in (TEXT, NOTES):
            return F.coalesce(bad("STRING"), fails(F.length(text) >= int(kind == TEXT)))
        if kind in (COUNT, POSITIVE):
            return F.coalesce(bad("BIGINT"), fails(self.long(path) >= int(kind == POSITIVE)))
        if kind == HASH:
            return F.coalesce(bad("STRING"), fails(text.rlike(r"^blake3:[0-9a-f]{64}$")))
        if kind == "id":
            return F.coalesce(bad("STRING"), fails(F.startswith(text, F.lit(self.names.id_prefix)) & F.substring(text, len(self.names.id_prefix) + 1, 1 << 20).rlike("^[0-9a-f]{64}$")))
        if kind == ROLE:
            return fails((self.type(path) == "STRING") & text.isin(*ROLES))
        if kind == "algorithm":
            return fails((self.type(path) == "STRING") & (text == self.names.id_algorithm))
        if kind == RANGE:
            return F.coalesce(bad("OBJECT"), self.named(path, ("start", "end")), self.field(f"{path}.end", COUNT), self.field(f"{path}.start", COUNT))
        items = self.at(path, "array<variant>")
        kinds = F.transform(items, lambda x: F.schema_of_variant(x))
        if kind == HASHES:
            right = F.forall(items, lambda x: F.try_variant_get(x, "$", "string").rlike(r"^blake3:[0-9a-f]{64}$"))
            return F.coalesce(bad("ARRAY"), F.when(F.exists(kinds, lambda k: k != "STRING"), "invalid_field_type"), fails(right))
        right = (F.size(items) > 0) & F.forall(items, lambda x: F.try_variant_get(x, "$", "long") >= 1)
        return F.coalesce(bad("ARRAY"), F.when(F.exists(kinds, lambda k: k != "BIGINT"), "invalid_field_type"), fails(right))

    def section(self, path: str, fields: dict[str, str]) -> Column:
        here = F.when(~F.coalesce(self.type(path) == "OBJECT", F.lit(False)), "invalid_field_type")
        return F.coalesce(here, self.named(path, fields), *(self.field(f"{path}.{f}", fields[f]) for f in sorted(fields)))

    def section_or_null(self, path: str, fields: dict[str, str]) -> Column:
        """Whatever is wrong inside, such a section is no valid alternative."""
        return F.when(~self.is_null(path) & self.section(path, fields).isNotNull(), "schema_validation_failed")

    def whole(self) -> Column:
        """A descriptor's schema, by path."""
        own = {"object_id": "id", "created_at_unix_ms": COUNT, "created_by": TEXT}
        rules = {p: self.field(p, k) for p, k in own.items()} | {p: self.section(p, f) for p, f in SECTIONS.items()} | {p: self.section_or_null(p, f) for p, f in NULLABLE.items()}
        return F.coalesce(self.named(None, ("schema_version", "object_type", *rules)), *(rules[p] for p in sorted(rules)))

    def target(self) -> Column:
        """A target profile's schema: what belongs to its object type is there, what doesn't is null."""
        version = F.when(~F.coalesce((self.type("schema_version") == "STRING") & (self.string("schema_version") == self.names.target_schema), F.lit(False)), "unknown_schema_version")
        kind = self.string("accepts_object_type")
        native, opaque = kind == TYPES[0], kind == TYPES[1]

        def part(path: str, fields: dict[str, str], wanted: Column) -> Column:
            absent = F.when(wanted & self.is_null(path) | ~wanted & (self.type(path) == "OBJECT"), "invalid_field_type")
            return F.coalesce(self.section_or_null(path, fields), absent)

        rules = {
            "accepts_object_type": F.when(~F.coalesce(kind.isin(*TYPES), F.lit(False)), "schema_validation_failed"), "engine_profile": self.section("engine_profile", ENGINE),
            "model_profile": part("model_profile", MODEL, native), "opaque_requirements": part("opaque_requirements", OPAQUE, opaque), "prefix_requirements": part("prefix_requirements", REQUIREMENTS, native),
        }
        return F.coalesce(version, self.named(None, ("schema_version", *rules)), *(rules[p] for p in sorted(rules)))


def head(meta: Json) -> Column:
    """Version and type of the object."""
    def one(path: str, known: Column, unknown: str) -> Column:
        kind = F.coalesce(meta.type(path), F.lit("VOID"))
        return F.when(kind == "VOID", "missing_required_field").when(kind != "STRING", "invalid_field_type").when(~known, unknown)

    return F.coalesce(one("schema_version", meta.string("schema_version") == meta.names.object_schema, "unknown_schema_version"), one("object_type", meta.string("object_type").isin(*TYPES), "unknown_object_type"))


def native_meaning(m: Json) -> Column:
    """Rules between the fields of a native page."""
    native, engine, model, prefix = "native_tensor_profile", "engine_profile", "model_profile", "prefix_profile"
    n = lambda f: m.long(f"{native}.{f}")
    empty = lambda path: m.long(f"{path}.end") <= m.long(f"{path}.start")
    same = lambda a, b: m.string(a) == m.string(b)
    count = n("token_range.end") - n("token_range.start")
    heads, dim = m.long(f"{model}.num_kv_heads"), m.long(f"{model}.head_dim")
    width = reduce(lambda done, w: done.when(m.string(f"{native}.tensor_dtype") == w[0], w[1]), WIDTHS.items(), F.when(F.lit(False), 0))
    return (
        F.when(m.is_null(native) | m.is_null(prefix) | ~m.is_null("opaque_engine_profile"), "schema_validation_failed")
        .when(~same(f"{model}.dtype", f"{native}.tensor_dtype") | width.isNull(), "invalid_tensor_dtype")
        .when(m.string(f"{native}.tensor_layout") != "kv_token_head_dim", "invalid_tensor_layout")
        .when(m.string(f"{native}.tensor_role") != "kv_pair", "invalid_tensor_shape")
        .when(empty(f"{native}.token_range") | empty(f"{prefix}.token_range"), "wrong_token_range")
        .when(empty(f"{prefix}.absolute_position_range"), "wrong_absolute_position_range")
        .when((n("block_token_count") != count) | (count <= 0) | (count > n("block_size_tokens")), "invalid_block_token_count")
        .when(n("block_size_tokens") != m.long(f"{engine}.block_size_tokens"), "wrong_block_size_tokens")
        .when(n("kv_block_id") != F.floor(n("token_range.start") / n("block_size_tokens")), "invalid_kv_block_id")
        .when((n("layer_id") < 0) | (n("layer_id") >= m.long(f"{model}.num_layers")), "invalid_layer_id")
        .when(m.at(f"{native}.tensor_shape", "array<long>") != F.array(F.lit(2).cast("long"), count, heads, dim), "invalid_tensor_shape")
        .when(m.long("payload_profile.byte_length") != 2 * count * heads * dim * width, "byte_length_mismatch")
        .when(~same(f"{prefix}.tokenizer_hash", f"{model}.tokenizer_hash"), "wrong_tokenizer_hash")
        .when(~same(f"{prefix}.rope_config_hash", f"{model}.rope_config_hash"), "wrong_rope_hash")
    )


def opaque_meaning(m: Json) -> Column:
    return F.when(m.is_null("opaque_engine_profile"), "schema_validation_failed").when(~m.is_null("native_tensor_profile"), "opaque_payload_not_interpretable")


def compatibility(m: Json, t: Json) -> Column:
    """Why an object doesn't suit a target profile: the profile's own faults first, then what must be equal, in order."""
    def equal(rows: list) -> list[Column]:
        return [F.when(~F.to_json(m.at(f"{a}.{x}")).eqNullSafe(F.to_json(t.at(f"{b}.{y}"))), reason) for a, x, b, y, reason in rows]

    def against(kind: str, sections: tuple[str, ...], rows: list) -> Column:
        void = reduce(Column.__or__, map(m.is_null, sections))
        return F.coalesce(F.when(t.string("accepts_object_type") != kind, "unknown_object_type"), F.when(void, "schema_validation_failed"), *equal(rows))

    native = against(TYPES[0], ("prefix_profile", "native_tensor_profile"), NATIVE_EQUAL)
    return F.coalesce(t.target(), F.when(m.string("object_type") == TYPES[0], native).otherwise(against(TYPES[1], ("opaque_engine_profile",), OPAQUE_EQUAL)))


def validate(objects: DataFrame, names: Names = Names(), metadata: str = "metadata", payload: str = "payload", target: str | None = "target") -> DataFrame:
    """``objects`` with status, reason_code and, as far as validation came, object_id, payload_hash, descriptor_hash.

    A text that isn't one JSON object with each key once is a parse_error; a null target asks for no compatibility.
    """
    text = F.col(metadata)
    found = bounded(objects).withColumn("_found", object_identity(text, F.coalesce(F.col(payload), F.lit(b"")), names))
    hashed = found.withColumns({"_payload_hash": F.col("_found.payload_hash"), "_descriptor_hash": F.col("_found.descriptor_hash"), "_found_id": F.col("_found.object_id")})
    parsed = hashed.withColumn("_meta", F.try_parse_json(text))
    m = Json(metadata, "_meta", names)
    if target is not None:
        parsed = parsed.withColumn("_target", F.try_parse_json(F.col(target)))
    parsed = parsed.withColumn("_early", F.coalesce(
        F.when(F.col("_meta").isNull() | (F.regexp_replace(F.schema_of_variant("_meta"), "<.*", "") != "OBJECT"), "parse_error"), head(m), m.whole(),
        F.when(m.string("payload_profile.compression") != "none", "unsupported_compression"),
        F.when(m.string("payload_profile.payload_encoding") != "raw_bytes", "unsupported_payload_encoding"),
        F.when(m.long("payload_profile.byte_length") != F.octet_length(F.coalesce(F.col(payload), F.lit(b""))), "byte_length_mismatch"),
    ))
    hashes = F.when(m.string("integrity.payload_hash") != F.col("_payload_hash"), "payload_hash_mismatch")
    hashes = hashes.when(~m.string("integrity.descriptor_hash").eqNullSafe(F.col("_descriptor_hash")), "descriptor_hash_mismatch").when(m.string("object_id") != F.col("_found_id"), "object_id_mismatch")
    late = [F.when(m.string("object_type") == TYPES[0], native_meaning(m)).otherwise(opaque_meaning(m))]
    if target is not None:
        late.insert(0, F.when(F.col(target).isNotNull(), F.coalesce(F.when(F.col("_target").isNull(), "schema_validation_failed"), compatibility(m, Json(target, "_target", names)))))
    judged = parsed.withColumn("reason_code", F.coalesce("_early", hashes, *late, F.lit("accepted")))
    at = F.col("reason_code")
    said = F.when(at.isin("payload_hash_mismatch", "descriptor_hash_mismatch"), m.string("object_id")).otherwise(F.col("_found_id"))
    later = F.col("_early").isNull()
    return judged.select(
        *objects.columns, F.when(at == "accepted", "accepted").otherwise("rejected").alias("status"), "reason_code",
        F.when(later, said).alias("object_id"), F.when(later, F.col("_payload_hash")).alias("payload_hash"),
        F.when(later & (at != "payload_hash_mismatch"), F.col("_descriptor_hash")).alias("descriptor_hash"),
    )
