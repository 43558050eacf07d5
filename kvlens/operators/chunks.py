"""Fixed-size chunking of payloads, reassembly, and groups of equal contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def layout(payloads: DataFrame, id_col: str, bytes_col: str, chunk_size: int) -> DataFrame:
    """id, chunk_index, offset, len, hash (SHA-256) of every chunk; an empty payload has none."""
    size = F.octet_length(bytes_col)
    chunks = F.when(size > 0, F.transform(F.sequence(F.lit(0), F.floor((size - 1) / chunk_size).cast("int")), lambda i: F.struct(i.alias("chunk_index"), F.substring(F.col(bytes_col), i * chunk_size + 1, F.lit(chunk_size)).alias("data"))))
    each = payloads.select(id_col, F.explode(chunks).alias("c"))
    return each.select(id_col, F.col("c.chunk_index").cast("long").alias("chunk_index"), (F.col("c.chunk_index").cast("long") * chunk_size).alias("offset"), F.octet_length("c.data").cast("long").alias("len"), F.sha2("c.data", 256).alias("hash"))


def manifest(payloads: DataFrame, id_col: str, bytes_col: str, chunk_size: int) -> DataFrame:
    """transfer, total_chunks, payload_len, payload_hash (SHA-256) of each payload."""
    size = F.octet_length(bytes_col).cast("long")
    return payloads.select(F.col(id_col).alias("transfer"), F.floor((size + chunk_size - 1) / chunk_size).cast("long").alias("total_chunks"), size.alias("payload_len"), F.sha2(bytes_col, 256).alias("payload_hash"))


def verify(received: DataFrame, layouts: DataFrame) -> DataFrame:
    """transfer, chunk_index, outcome: ok, length_mismatch, hash_mismatch or unknown_chunk of each received chunk.

    ``layouts``: transfer, chunk_index, len, hash, as ``layout`` gives them.
    """
    known = layouts.select("transfer", "chunk_index", "len", "hash")
    joined = received.select("transfer", "chunk_index", "data").join(known, ["transfer", "chunk_index"], "left")
    outcome = F.when(F.col("len").isNull(), "unknown_chunk").when(F.octet_length("data") != F.col("len"), "length_mismatch").when(F.sha2("data", 256) != F.col("hash"), "hash_mismatch").otherwise("ok")
    return joined.select("transfer", "chunk_index", outcome.alias("outcome"))


def reassemble(received: DataFrame, expected: DataFrame) -> DataFrame:
    """transfer, payload, outcome from chunks in any order, repeats included: ok, out_of_range, conflict (two forms of
    one chunk), incomplete, length_mismatch or hash_mismatch, the first that holds; the payload is null unless ok.

    ``received``: transfer, chunk_index, data; ``expected``: transfer, total_chunks and maybe payload_len and
    payload_hash.  Equal repeats are one.  A transfer's payload is one value, so it fits into a task.
    """
    per = received.groupBy("transfer", "chunk_index").agg(F.count_distinct("data").alias("forms"), F.min("data").alias("data"))
    inside = per.join(expected.select("transfer", "total_chunks"), "transfer").withColumn("fits", (F.col("chunk_index") >= 0) & (F.col("chunk_index") < F.col("total_chunks")))
    part = F.when(F.col("fits"), F.struct(F.col("chunk_index").alias("chunk_index"), F.hex("data").alias("data")))
    whole = inside.groupBy("transfer").agg(F.max("forms").alias("forms"), F.count_if("fits").alias("n"), F.count_if(~F.col("fits")).alias("beyond"), F.array_sort(F.collect_list(part)).alias("parts"))
    joined = expected.join(whole, "transfer", "left").withColumn("made", F.unhex(F.array_join(F.transform(F.coalesce("parts", F.array().cast("array<struct<chunk_index:long,data:string>>")), lambda p: p["data"]), "")))
    outcome = F.when(F.col("beyond") > 0, "out_of_range").when(F.col("forms") > 1, "conflict").when(F.coalesce("n", F.lit(0)) < F.col("total_chunks"), "incomplete")
    if "payload_len" in expected.columns:
        outcome = outcome.when(F.octet_length("made") != F.col("payload_len"), "length_mismatch")
    if "payload_hash" in expected.columns:
        outcome = outcome.when(F.sha2("made", 256) != F.col("payload_hash"), "hash_mismatch")
    done = joined.withColumn("outcome", outcome.otherwise("ok"))
    return done.select("transfer", F.when(F.col("outcome") == "ok", F.col("made")).alias("payload"), "outcome")


def equal_contents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """hash, copies, first id of each content; sums are made in the map tasks."""
    return docs.groupBy(F.sha2(F.col(text_col), 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("first_id"))


def token_estimate(n_chars):
    """max(1, ceil(characters / 4))."""
    return F.greatest(F.lit(1).cast("long"), F.floor((n_chars + 3) / 4).cast("long"))
