"""Object descriptors with payloads made from documents: whole ones, and one of each kind of fault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlens.functions.descriptors import Names, descriptor_identity
from kvlens.functions.identity import blake3_hex, bounded

#: Faults by the remainder of the document's id; a descriptor of any other remainder is whole.
FAULTS = 16
TOKENS, HEADS, DIM = 2, 2, 4


def struct(**fields) -> Column:
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()))


def written(column: Column) -> Column:
    return F.to_json(column, {"ignoreNullFields": "false"})


def descriptors(docs: DataFrame, names: Names = Names()) -> DataFrame:
    """doc_id, metadata, payload, target: a native page of each document, of every third an opaque blob with its text."""
    opaque = F.col("doc_id") % 3 == 0
    hashed = lambda c: F.concat(F.lit("blake3:"), F.sha2(c, 256))
    kind = F.when(opaque, "opaque_engine_blob").otherwise("native_kv_page")
    one = bounded(docs).select("doc_id", F.when(opaque, F.concat(F.lit("p"), F.coalesce("text", F.lit("")))).otherwise(F.rpad(F.md5("text"), 64, "x")).cast("binary").alias("payload"), "lang", "source", opaque.alias("opaque"), kind.alias("kind"))
    tail = names.target_schema
    lang, source = hashed(F.coalesce("lang", F.lit(""))), hashed(F.coalesce("source", F.lit("")))
    span = struct(start=F.col("doc_id") % 5 * TOKENS, end=F.col("doc_id") % 5 * TOKENS + TOKENS)
    model = struct(model_id="m", model_revision="r", model_hash=lang, tokenizer_hash=lang, config_hash=lang, rope_config_hash=lang, quantization="none", dtype="float16", num_layers=4, num_attention_heads=HEADS, num_kv_heads=HEADS, head_dim=DIM, max_position_embeddings=4096)
    engine = lambda name: struct(engine_name=name, engine_version="1", integration_name="i", integration_version="1", attention_impl="a", kv_layout="l", block_size_tokens=TOKENS, kv_cache_format="f")
    prefix = struct(token_count=TOKENS, token_range=span, absolute_position_range=span, prefix_hash=source, token_hash=source, tokenizer_hash=lang, rope_config_hash=lang, mm_hashes=F.array().cast("array<string>"))
    wanted = struct(prefix_hash=source, token_hash=source, tokenizer_hash=lang, rope_config_hash=lang, token_range=span, absolute_position_range=span, allow_mm_hashes=F.array().cast("array<string>"))
    native = struct(layer_id=F.col("doc_id") % 4, kv_block_id=F.col("doc_id") % 5, block_size_tokens=TOKENS, block_token_count=TOKENS, token_range=span, tensor_role="kv_pair", tensor_shape=F.array(F.lit(2), F.lit(TOKENS), F.lit(HEADS), F.lit(DIM)), tensor_dtype="float16", tensor_layout="kv_token_head_dim")
    key = struct(engine_key_hash=source, engine_payload_type="blob", engine_key_repr_version="1")

    def meta(object_id_: Column, descriptor: Column, payload: Column) -> Column:
        return written(struct(
            schema_version=names.object_schema, object_type=F.col("kind"), object_id=object_id_, created_at_unix_ms=1, created_by="job", model_profile=model, engine_profile=engine("e"),
            prefix_profile=F.when(~F.col("opaque"), prefix), payload_profile=struct(byte_length=F.octet_length("payload"), compression="none", payload_encoding="raw_bytes"),
            native_tensor_profile=F.when(~F.col("opaque"), native), opaque_engine_profile=F.when(F.col("opaque"), key),
            integrity=struct(descriptor_hash=descriptor, payload_hash=payload, object_id_algorithm=names.id_algorithm, chunk_size_bytes=4096, chunk_hashes=F.array(payload)),
            provenance=struct(source="s", notes="", producer_commit="c", producer_hostname="h"),
        ))

    null = F.lit(None).cast("string")
    whole = one.withColumn("payload_hash", blake3_hex(F.col("payload"))).withColumn("draft", meta(null, null, F.col("payload_hash")))
    whole = whole.withColumn("found", descriptor_identity(F.col("draft"), F.col("payload_hash"), names)).withColumns({"descriptor_hash": F.col("found.descriptor_hash"), "found_id": F.col("found.object_id")})
    fault = F.col("doc_id") % FAULTS
    other_id = F.concat(F.lit(names.id_prefix), F.sha2("found_id", 256))
    whole = whole.withColumn("written", meta(F.when(fault == 11, other_id).otherwise(F.col("found_id")), F.col("descriptor_hash"), F.col("payload_hash")))
    text = F.col("written")
    swap = lambda old, new: F.replace(text, F.lit(old), F.lit(new))
    made = (
        F.when(fault == 1, swap(names.object_schema, names.object_schema + "9")).when(fault == 2, swap('"object_type":"', '"object_type":"x_')).when(fault == 3, swap('"created_by":"job",', ""))
        .when(fault == 4, swap('"created_by":"job",', '"created_by":"job","more":1,')).when(fault == 5, swap('"created_by":"job"', '"created_by":7')).when(fault == 6, swap('"created_by":"job"', '"created_by":""'))
        .when(fault == 7, swap('"compression":"none"', '"compression":"zstd"')).when(fault == 10, swap('"created_by":"job"', '"created_by":"jab"')).when(fault == 12, F.concat(F.lit("{"), text)).otherwise(text)
    )
    rest = F.substring("payload", 2, (1 << 31) - 1)
    payload = F.when(fault == 8, F.concat("payload", F.lit(b"x"))).when(fault == 9, F.concat(F.lit(b"q!"), rest).substr(F.lit(1), F.octet_length("payload"))).otherwise(F.col("payload"))
    target = written(struct(
        schema_version=tail, accepts_object_type=F.col("kind"), model_profile=F.when(~F.col("opaque"), model), engine_profile=engine(F.when(fault == 13, "other").otherwise("e")),
        prefix_requirements=F.when(~F.col("opaque"), wanted), opaque_requirements=F.when(F.col("opaque"), key),
    ))
    return whole.select("doc_id", made.alias("metadata"), payload.alias("payload"), target.alias("target"))
