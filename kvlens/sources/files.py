"""Readers of traces, connector events, metrics and object files, and the sinks that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACE = "timestamp_unix_ms BIGINT, event_type STRING, transfer_id STRING, object_id STRING, chunk_index BIGINT, bytes BIGINT, path_name STRING, duration_ms BIGINT, reason_code STRING"
CONNECTOR = "event STRING, timestamp_unix_ms BIGINT, operation STRING, opaque_engine_key_hash STRING, object_id STRING, bytes BIGINT, duration_ms DOUBLE, reason_code STRING"


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Trace lines; blank lines and JSON that isn't an object are passed over, a line that isn't JSON raises with its file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where("trim(value) <> ''")
    valid = F.try_parse_json("value").isNotNull()
    checked = F.when(valid, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not JSON in "), F.col("file"), F.lit(": "), F.substring("value", 1, 80))).cast("string"))
    return lines.withColumn("value", checked).where(F.ltrim("value").startswith("{")).select(F.from_json("value", TRACE).alias("e")).select("e.*")


def read_connector(spark: SparkSession, path: str, on_bad: str = "count") -> DataFrame:
    """Connector events.  ``count`` keeps bad lines in _corrupt_record, ``skip`` leaves them out."""
    if on_bad == "skip":
        return spark.read.schema(CONNECTOR).json(path, mode="DROPMALFORMED")
    return spark.read.schema(CONNECTOR + ", _corrupt_record STRING").json(path, mode="PERMISSIVE")


def connector_counts(events: DataFrame) -> DataFrame:
    """One row: events by kind, bytes and the number of lines that couldn't be read."""
    ok = F.col("_corrupt_record").isNull()
    kind = lambda e: F.count_if(ok & (F.col("event") == e))
    return events.agg(F.count_if(~ok).alias("parse_error_count"), kind("connector_get_completed").alias("get_count"), kind("connector_put_completed").alias("put_count"), kind("connector_error").alias("error_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def parse_prometheus(lines: DataFrame, line: str = "value", order: str = "line_no") -> DataFrame:
    """name, value of metric lines; comments go, labels are stripped, of a name's series the last line wins."""
    body = F.trim(F.col(line))
    found = lines.where((body != "") & ~body.startswith("#")).select(F.col(order).alias("_at"), F.regexp_extract(body, r"^([A-Za-z_:][A-Za-z0-9_:]*)", 1).alias("name"), F.element_at(F.split(body, r"\s+"), 2).try_cast("double").alias("value"))
    return found.where("name <> '' AND value IS NOT NULL").groupBy("name").agg(F.max(F.struct("_at", "value")).alias("m")).select("name", "m.value")


def read_object_files(spark: SparkSession, root: str) -> DataFrame:
    """object_id, kind (meta, payload, invalid), path, n_bytes, sha256 of every file under a store's folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    digest = F.regexp_extract(name, r"^([0-9a-f]{64})\.(meta\.json|payload\.bin)$", 1)
    kind = F.when(digest == "", "invalid").when(name.endswith(".meta.json"), "meta").otherwise("payload")
    return files.select(F.when(digest != "", F.concat(F.lit("blake3:"), digest)).alias("object_id"), kind.alias("kind"), "path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def artifact_manifest(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), sha256, size_bytes, artifact_type of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.regexp_extract("path", r".*?" + root.rstrip("/").rsplit("/", 1)[-1] + r"/(.*)$", 1)
    kind = F.when(below.endswith(".jsonl"), "jsonl").when(below.endswith(".json"), "json").when(below.endswith(".csv"), "csv").when(below.endswith(".md"), "markdown").when(below.endswith(".log"), "log").otherwise("other")
    return files.select(below.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), kind.alias("artifact_type"))


def verify_artifacts(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """path, problem (missing, size, hash) of the manifest's files that aren't as it says."""
    now = found.select("path", F.col("sha256").alias("_hash"), F.col("size_bytes").alias("_size"))
    problem = F.when(F.col("_hash").isNull(), "missing").when(F.col("_size") != F.col("size_bytes"), "size").when(F.col("_hash") != F.col("sha256"), "hash")
    return manifest.join(now, "path", "left").withColumn("problem", problem).where("problem IS NOT NULL").select("path", "problem")


def numbered(lines: DataFrame) -> DataFrame:
    """Lines of one file with line_no, for small files such as a scrape."""
    return lines.withColumn("line_no", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


def write_events(events: DataFrame, path: str) -> None:
    """Append events as JSON lines, absent fields left out."""
    events.write.mode("append").json(path)


def write_comparison_csv(rows: DataFrame, path: str) -> None:
    """A comparison as CSV with a header; lists are joined by '; '."""
    flat = [F.concat_ws("; ", c).alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").csv(path, header=True)
