"""Phases of a benchmark: which requests are measured, which fill the cache before, which warm the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlens.operators.serving import first_per_prefix

WARMUP = "engine_warmup-prefix-"


def measured(requests: DataFrame, per_prefix: int | None = None) -> DataFrame:
    """The measured requests, or the first ``per_prefix`` of each prefix."""
    return requests.where("phase = 'measured'") if per_prefix is None else first_per_prefix(requests, per_prefix).drop("place")


def population(requests: DataFrame, per_prefix: int) -> DataFrame:
    """prefix_id, place, request_id, source_id: ``per_prefix`` requests of each measured prefix; where it has fewer,
    its last one is taken again.  Only the first ``per_prefix`` rows of a prefix are numbered."""
    first = first_per_prefix(requests, per_prefix).select("prefix_id", F.col("request_id").alias("source_id"), "place")
    first = first.withColumn("last", F.max("place").over(Window.partitionBy("prefix_id")))
    upto = F.when(F.col("place") == F.col("last"), F.lit(per_prefix - 1).cast("long")).otherwise(F.col("place") - 1)
    each = first.withColumn("place", F.explode(F.sequence(F.col("place") - 1, upto))) if per_prefix else first.limit(0)
    name = F.concat(F.lit("cache_population-"), F.lpad(F.col("place").cast("string"), F.greatest(F.lit(2), F.length(F.col("place").cast("string"))), F.lit("0")), F.lit("-"), "source_id")
    return each.select("prefix_id", "place", name.alias("request_id"), "source_id")


def warmup(requests: DataFrame, count: int) -> DataFrame:
    """request_id, prefix_id of ``count`` requests, numbered from 0; numbers whose prefix is measured are left out."""
    own = requests.where("phase = 'measured'").where(F.col("prefix_id").startswith(WARMUP)).select("prefix_id").distinct()
    padded = lambda n: F.lpad(F.col("id").cast("string"), F.greatest(F.lit(n), F.length(F.col("id").cast("string"))), F.lit("0"))
    numbers = requests.sparkSession.range(count + own.count())
    named = numbers.select("id", F.concat(F.lit("engine_warmup-"), padded(5)).alias("request_id"), F.concat(F.lit(WARMUP), padded(4)).alias("prefix_id"))
    return named.join(own, "prefix_id", "left_anti").orderBy("id").limit(count).select("request_id", "prefix_id")


def leaks(requests: DataFrame) -> DataFrame:
    """prefix_id, requests: warm-up requests whose prefix is measured too, by prefix."""
    warm = requests.where("phase = 'engine_warmup'").groupBy("prefix_id").agg(F.count(F.lit(1)).alias("requests"))
    return warm.join(requests.where("phase = 'measured'").select("prefix_id"), "prefix_id", "left_semi")


def phase_counts(requests: DataFrame, *by: str) -> DataFrame:
    return requests.groupBy(*by, "phase").agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("prefix_id").alias("prefixes"))
