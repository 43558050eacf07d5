"""Canonical exact digests of documents, with DataFrame functions only.

A text is normalised (NFKC), case-folded, normalised again, and runs of white space become one space.  Two
chained 64-bit xxhash values of the canonical text are its bucket.  Inside buckets with several rows the
canonical bytes are compared; texts that differ in an equal bucket get different fingerprints.

Defined cases: null is the empty text; equal texts have equal fingerprints; a row without an id is
fingerprinted but has no next document (its edited text is its own); if an id repeats, the rows share the
next document and, as a next document, the least of their texts counts; a single document follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvlens.llm.common import BROADCAST_IDS, Scratch, documents, text_or_empty

#: Neighbouring ids that meet in one group, and groups in one range when the order of the groups is found.
WIDTH = 256
ROWS_PER_RANGE = 50_000


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC, white space folded.  ICU is part of Spark; its static functions are called by name."""
    nfkc = lambda x: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = nfkc(F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True)))
    plain = F.lower(text)  # text of ASCII only needs no normaliser
    return F.trim(F.regexp_replace(F.when(F.octet_length(text) == F.length(text), plain).otherwise(folded), r"(?U)\s+", " "))


def wide_hash(text: Column, bits: int = 128) -> Column:
    """Two xxhash values, the second seeded by a constant's; fewer bits are for tests of the comparison."""
    parts = F.concat(*(F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(text), F.xxhash64(F.lit(0x5BD1E995), text))))
    return F.substring(parts, 1, bits // 4)


def few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def variants(buckets: DataFrame, texts, scratch: Scratch) -> DataFrame | None:
    """bucket, kind, doc_id, variant of the rows in buckets whose canonical bytes differ; None if no bucket has such.

    ``buckets``: kind, doc_id, bucket of all rows.  ``texts(kind, ids)`` gives doc_id, bucket, canonical of
    some ids.  Only rows whose bucket has several are read again; equal bytes meet in map-side sums.
    """
    crowded = scratch.save(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "crowded")
    flagged = scratch.save(buckets.join(crowded, "bucket", "left_semi").select("kind", "doc_id").where("doc_id IS NOT NULL").distinct(), "flagged")
    rows = None
    for kind in ("own", "edited"):
        ids = flagged.where(F.col("kind") == kind).select("doc_id")
        if ids.limit(1).count():
            part = texts(kind, ids).withColumn("kind", F.lit(kind))
            rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return None
    forms = rows.groupBy("bucket", "canonical").agg(F.count(F.lit(1)).alias("n"))
    differing = scratch.save(forms.groupBy("bucket").agg(F.count(F.lit(1)).alias("forms")).where("forms > 1").select("bucket"), "differing")
    if not differing.limit(1).count():
        return None
    numbered = forms.join(differing, "bucket", "left_semi").withColumn("variant", F.row_number().over(Window.partitionBy("bucket").orderBy("canonical")) - 1)
    found = rows.join(numbered.select("bucket", "canonical", "variant"), ["bucket", "canonical"])
    return scratch.save(found.groupBy("kind", "doc_id", "bucket").agg(F.min("variant").alias("variant")), "variants")


def with_variants(df: DataFrame, found: DataFrame | None, kind: str, col: str) -> DataFrame:
    """Fingerprints: the bucket, and after a dash the variant where its bytes differ from the first's."""
    if found is None:
        return df
    own = found.where(F.col("kind") == kind).select("doc_id", F.col("bucket").alias(col), F.col("variant").alias("v"))
    return df.join(own, ["doc_id", col], "left").withColumn(col, F.when(F.col("v") > 0, F.concat(col, F.lit("-"), F.col("v").cast("string"))).otherwise(F.col(col))).drop("v")


def fingerprints(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """id, fingerprint of each row."""
    source = docs.select(F.col(id_col).alias("doc_id"), canonical(text_or_empty(text_col)).alias("canonical"))
    hashed = source.withColumn("bucket", wide_hash(F.col("canonical"), bits))
    buckets = scratch.save(hashed.select(F.lit("own").alias("kind"), "doc_id", "bucket"), "buckets")
    found = variants(buckets, lambda kind, ids: hashed.join(few(ids), "doc_id", "left_semi"), scratch)
    out = with_variants(buckets.select("doc_id", F.col("bucket").alias("fingerprint")), found, "own", "fingerprint")
    return out.withColumnRenamed("doc_id", id_col)


# -- edited texts -------------------------------------------------------------------------------------------


def following(groups: DataFrame, scratch: Scratch) -> DataFrame:
    """group, next_group, half of distinct groups in ascending order; the last is followed by the first.

    Groups are dealt to ranges by a sample, ordered inside each, and the ranges are joined by their first groups.
    """
    n = groups.count()
    ranged = scratch.save(groups.repartitionByRange(max(1, -(-n // ROWS_PER_RANGE)), "group").withColumn("range", F.spark_partition_id()), "ranges")
    by_range = Window.orderBy("range")  # one row a range
    ends = ranged.groupBy("range").agg(F.min("group").alias("first"))
    ends = ends.withColumn("after", F.coalesce(F.lead("first").over(by_range), F.min("first").over(Window.partitionBy())))
    inside = Window.partitionBy("range").orderBy("group")
    step = ranged.withColumn("next_in", F.lead("group").over(inside)).join(ends.select("range", "after"), "range")
    return step.select("group", F.coalesce("next_in", "after").alias("next_group"), "half")


def half(text: Column) -> Column:
    return F.floor(F.length(text) / 2).cast("int")


def spliced(text: Column, other: Column) -> Column:
    """The text, its last half replaced by the beginning of the other."""
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half(text)), F.substring(other, F.lit(1), half(text)))


def edited_texts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text, next_id, edited: the last half of each text replaced by the beginning of the next document's.

    The texts are shuffled once, at every size: WIDTH neighbouring ids meet in one group and are ordered there.
    The first text of each group, found in the map tasks where ids lie together, goes on as the prefix that the
    last document of the group before it takes.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("group", F.floor(F.col("doc_id") / WIDTH))
    known = texts.where("doc_id IS NOT NULL")
    sizes = known.groupBy("group").agg(F.max(F.struct("doc_id", half(F.col("text")).alias("half"))).alias("last"))
    chain = scratch.save(following(scratch.save(sizes.select("group", F.col("last.half").alias("half")), "groups"), scratch), "chain")

    # The frame holds the larger ids only, so that the least of it is the next document, also where ids repeat.
    larger = Window.partitionBy("group").orderBy(F.desc("doc_id")).rangeBetween(Window.unboundedPreceding, -1)
    inner = known.withColumn("next", F.min(F.struct("doc_id", "text")).over(larger))
    heads = known.groupBy("group").agg(F.min(F.struct("doc_id", "text")).alias("head")).join(chain.select(F.col("next_group").alias("group"), F.col("group").alias("before"), "half"), "group")
    heads = heads.select(F.col("before").alias("group"), F.struct(F.col("head.doc_id").alias("doc_id"), F.substring(F.col("head.text"), F.lit(1), F.col("half")).alias("text")).alias("head"))
    both = inner.join(heads, "group", "left").withColumn("next", F.coalesce("next", "head"))
    found = both.select("doc_id", "text", F.col("next.doc_id").alias("next_id"), spliced(F.col("text"), F.col("next.text")).alias("edited"))
    unnamed = texts.where("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast("long").alias("next_id"), F.col("text").alias("edited"))
    return found.unionByName(unnamed)


def op2_fingerprints(spark: SparkSession, sf_dir: str, bits: int = 128) -> DataFrame:
    return compare(documents(spark, sf_dir), Scratch(spark, "fingerprints"), bits)


def compare(docs: DataFrame, scratch: Scratch, bits: int = 128) -> DataFrame:
    """Fingerprints of texts and edited texts, and their likeness (1 if equal, else 0) to each other and to the next."""
    hashed = lambda col: wide_hash(canonical(F.col(col)), bits)
    rows = edited_texts(docs, scratch).select("doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), hashed("text").alias("fingerprint"), hashed("edited").alias("edited_fingerprint"))
    rows = scratch.save(rows, "hashed")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def texts(kind: str, ids: DataFrame) -> DataFrame:
        found = own.join(few(ids), "doc_id", "left_semi")
        if kind == "edited":
            wanted = scratch.save(rows.join(few(ids), "doc_id", "left_semi").select("doc_id", "next_id").distinct(), "wanted")
            after = own.join(few(wanted.select(F.col("next_id").alias("doc_id")).distinct()), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("next_id")).agg(F.min("text").alias("other"))
            found = found.join(wanted.join(after, "next_id"), "doc_id").select("doc_id", spliced(F.col("text"), F.col("other")).alias("text"))
        return found.select("doc_id", canonical(F.col("text")).alias("canonical")).select("doc_id", wide_hash(F.col("canonical"), bits).alias("bucket"), "canonical")

    buckets = rows.select("doc_id", F.explode(F.array(F.struct(F.lit("own").alias("kind"), F.col("fingerprint").alias("bucket")), F.struct(F.lit("edited").alias("kind"), F.col("edited_fingerprint").alias("bucket")))).alias("b")).select("b.kind", "doc_id", "b.bucket")
    found = variants(buckets, texts, scratch)
    rows = with_variants(with_variants(rows, found, "own", "fingerprint"), found, "edited", "edited_fingerprint")
    after = rows.groupBy(F.col("doc_id").alias("next_id")).agg(F.min("fingerprint").alias("next_fingerprint"))
    both = rows.join(after, "next_id", "left")
    like = lambda a, b: F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))
    return both.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), F.coalesce(like(F.col("fingerprint"), F.col("next_fingerprint")), F.lit(0.0)).alias("near_next"))
