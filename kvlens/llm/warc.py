"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256; every record keeps its exact header bytes in a
second table.  Reading joins the two and checks each payload against its digest.

Defined cases: a null payload is empty; repeated rows give repeated records; a null id gives a record
that may revisit another but is never revisited; a missing or damaged payload raises an error; other
columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlens.llm.common import Scratch, keep_ids

#: Records that share one copy of a payload in a join; larger groups of copies are split over shards.
ROWS_PER_SHARD = 128
#: Most digests (64 bytes each) that are broadcast after their count has been checked.
BROADCAST_DIGESTS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Archive:
    headers: DataFrame  # record_id, header, digest, shard
    payloads: DataFrame  # digest, payload, shards


def _record_uri(col):
    return F.concat(F.lit("<urn:page:"), col.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_revisit: int = 1000, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Write headers and payloads as two tables.

    Only digests are shuffled to find copies (with map-side maxima, so a payload that a third of all rows
    share costs one row a task).  The row with the largest id of each payload stores the bytes; all others
    are left out by their ids before any payload is written.
    """
    raw = pages.select(F.col(id_col).alias("record_id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    index = scratch.save(raw.select("record_id", "uri", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n")), "index")
    groups = scratch.save(index.groupBy("digest").agg(F.max("record_id").alias("holder"), F.ceil(F.count(F.lit(1)) / ROWS_PER_SHARD).cast("int").alias("shards")), "groups")
    placed = index.join(groups, "digest")
    copy = F.col("holder").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("holder"))
    revisit = copy & (F.col("n") >= min_revisit)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = F.regexp_replace(F.coalesce("uri", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.coalesce(_record_uri(F.col("record_id")), F.lit("<urn:page:>"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_uri(F.col("holder"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string")),
        line("WARC-Target-URI", uri),
    )
    shard = F.pmod(F.xxhash64("record_id", "uri"), F.col("shards")).cast("int")
    headers = scratch.save(placed.select("record_id", header.cast("binary").alias("header"), "digest", shard.alias("shard")), "headers")

    copies = scratch.save(placed.where(copy & F.col("record_id").isNotNull()).select("record_id").distinct(), "copies")
    stored = keep_ids(raw.where(F.col("record_id").isNotNull()), copies, "record_id", "left_anti").withColumn("digest", F.sha2("payload", 256))
    # Ids may repeat and may be null: these few rows, and only these, are made distinct by their digest.
    repeated = scratch.save(index.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("digest").alias("d")).where("n > 1 AND record_id IS NOT NULL").select("record_id"), "repeated")
    n_repeated = repeated.count()
    orphans = groups.where("holder IS NULL").select("digest")
    parts = [keep_ids(stored, repeated, "record_id", "left_anti", n_repeated)]
    if n_repeated:
        parts.append(keep_ids(raw, repeated, "record_id", "left_semi", n_repeated).withColumn("digest", F.sha2("payload", 256)).join(groups.select("digest", F.col("holder").alias("record_id")), ["digest", "record_id"], "left_semi"))
    if orphans.limit(1).count():
        parts.append(raw.where(F.col("record_id").isNull()).withColumn("digest", F.sha2("payload", 256)).join(orphans, "digest", "left_semi"))
    single = parts[0].select("digest", "payload")
    if len(parts) > 1:
        rest = parts[1] if len(parts) == 2 else parts[1].unionByName(parts[2], allowMissingColumns=True)
        single = single.unionByName(rest.groupBy("digest").agg(F.first("payload").alias("payload")))
    # Only payloads with many copies have shards, at most one in ROWS_PER_SHARD records.
    hot = scratch.save(groups.where("shards > 1").select("digest", "shards"), "hot")
    sharded = single.join(F.broadcast(hot) if hot.count() <= BROADCAST_DIGESTS else hot, "digest", "left")
    payloads = scratch.save(sharded.select("digest", "payload", F.coalesce("shards", F.lit(1)).alias("shards")), "payloads")
    scratch.drop(index, copies, repeated)
    return Archive(headers, payloads)


def read_archive(archive: Archive) -> DataFrame:
    """Every record again: record_id, header, payload (checked against its digest)."""
    shards = archive.payloads.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    joined = archive.headers.join(shards.select("digest", "shard", "payload"), ["digest", "shard"], "left")
    sound = F.sha2("payload", 256) == F.col("digest")
    payload = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload is missing or damaged: "), F.col("digest"))).cast("binary"))
    return joined.select("record_id", "header", payload.alias("payload"))


def record_bytes(records: DataFrame) -> DataFrame:
    """The records as an archive file would hold them: header, empty line, block, two line ends."""
    block = F.when(F.col("header").cast("string").rlike(r"(?m)^WARC-Type: revisit\r?$"), F.lit(b"")).otherwise(F.col("payload"))
    return records.select("record_id", F.concat("header", F.lit(b"\r\n"), block, F.lit(b"\r\n\r\n")).alias("record"))


def describe(records: DataFrame) -> DataFrame:
    """What the read records say: sizes, digest, type and what a revisit refers to."""
    text = F.col("header").cast("string")
    refers = F.regexp_extract(text, r"(?m)^WARC-Refers-To: <urn:page:([^>]*)>\r?$", 1)
    return records.select(
        F.col("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        F.regexp_extract(text, r"(?m)^WARC-Type: (\w+)\r?$", 1).alias("record_type"),
        F.when(refers != "", refers).cast("long").alias("refers_to"),
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    return describe(read_archive(write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch)))


OP1_SQL = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < holder THEN holder END AS refers_to
FROM (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
             sha1(coalesce(html, '')) AS payload_digest,
             max(page_id) OVER (PARTITION BY coalesce(html, '')) AS holder
      FROM pages)
"""
