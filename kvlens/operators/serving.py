"""Serving benchmarks: request summaries, phases, comparisons with a baseline, answers compared, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Fixed value: white space as text functions see it, Unicode's and the ASCII separators.
WHITE = r"[ \t\n\r\f\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def succeeded(errors: bool = False) -> Column:
    """A status from 200 to 299 and, with ``errors``, no error; without a status a request hasn't succeeded."""
    ok = F.coalesce((F.col("status") >= 200) & (F.col("status") < 300), F.lit(False))
    return ok & F.col("error").isNull() if errors else ok


def summary(requests: DataFrame, *by: str) -> DataFrame:
    """Counts and rates over all requests, latencies over successes only (linear percentiles), rounded to 6 places."""
    ok = succeeded("error" in requests.columns)
    good = lambda c: F.when(ok, F.col(c))
    values = {
        "request_count": F.count(F.lit(1)),
        "success_count": F.count_if(ok),
        "error_count": F.count_if(~ok),
        "error_rate": F.round(F.count_if(~ok) / F.count(F.lit(1)), 6),
        "p50_latency_ms": F.round(F.percentile(good("latency_ms"), F.lit(0.5)), 6),
        "p95_latency_ms": F.round(F.percentile(good("latency_ms"), F.lit(0.95)), 6),
        "mean_latency_ms": F.round(F.avg(good("latency_ms")), 6),
        "p50_ttft_ms": F.round(F.percentile(good("ttft_ms"), F.lit(0.5)), 6),
        "output_tokens": F.coalesce(F.sum(good("output_token_count")), F.lit(0)),
    }
    return requests.groupBy(*by).agg(*(v.alias(k) for k, v in values.items()))


def repeated_prefixes(requests: DataFrame) -> DataFrame:
    """Prefixes that several requests of a mode share; counted in the map tasks first."""
    per = requests.groupBy("mode", "prefix_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("mode").agg(F.count_if(F.col("n") > 1).alias("repeated_prefixes"), F.sum("n").alias("requests"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("reuses"))


def first_per_prefix(requests: DataFrame, n: int) -> DataFrame:
    """The first n measured requests of each prefix; the rank's limit is applied before the shuffle as well."""
    place = F.row_number().over(Window.partitionBy("prefix_id").orderBy("ord"))
    return requests.where("phase = 'measured'").withColumn("place", place).where(F.col("place") <= n).withColumn("place", F.col("place").cast("long"))


def expected_reuse(turns: DataFrame, group: str, *order: str) -> DataFrame:
    """Whether a row comes after the first of its group, in a total order; rows without a group are one group.

    Only the group's minimum is shuffled, not a window.
    """
    place = F.struct(*(x for c in order for x in (F.col(c).isNull(), F.col(c))))
    first = turns.groupBy(F.col(group).alias("_group")).agg(F.min(place).alias("_first"))
    return turns.join(first, turns[group].eqNullSafe(first["_group"])).withColumn("expected_cache_reuse", place > F.col("_first")).drop("_group", "_first")


def compare_modes(results: DataFrame) -> DataFrame:
    """Each result against the first completed one in run order (which is compared with itself too).

    ``results``: run_order, mode, status, summary columns, and maybe skip_reason and error.  Results that weren't
    completed have no deltas; without a completed one there are no rows.
    """
    compared = {"latency_delta": "p50_latency_ms", "ttft_delta": "p50_ttft_ms", "error_rate_delta": "error_rate"}
    base = results.where("status = 'completed'").orderBy("run_order", "mode").limit(1).select(F.col("mode").alias("baseline_mode"), *(F.col(c).alias(f"_{c}") for c in compared.values()))
    joined = results.crossJoin(F.broadcast(base))  # the baseline is one row
    done = F.col("status") == "completed"
    delta = lambda c: F.when(done, F.round(F.col(c) - F.col(f"_{c}"), 6))
    percent = lambda c: F.when(done, F.round(F.try_divide(F.col(c) - F.col(f"_{c}"), F.col(f"_{c}")) * 100, 6))
    given = [F.col(c) for c in ("skip_reason", "error") if c in results.columns]
    reason = F.when(~done, F.coalesce(*given, F.lit("not completed")))
    note = F.coalesce(reason, F.when(delta("p50_ttft_ms").isNull(), F.lit("TTFT unavailable for one or both modes")), F.lit(""))
    return joined.select(
        "run_order", "baseline_mode", F.col("mode").alias("candidate_mode"), F.when(done, "compared").otherwise("skipped").alias("status"),
        delta("p50_latency_ms").alias("latency_delta_ms"), percent("p50_latency_ms").alias("latency_delta_pct"),
        delta("p50_ttft_ms").alias("ttft_delta_ms"), percent("p50_ttft_ms").alias("ttft_delta_pct"), delta("error_rate").alias("error_rate_delta"),
        note.alias("notes"), reason.alias("skipped_reason"),
    )


def normalized(text: Column, lower: bool = False) -> Column:
    """Trimmed, white space collapsed, lower case if asked."""
    plain = F.regexp_replace(F.regexp_replace(text, f"{WHITE}+", " "), r"^ | $", "")
    return F.lower(plain) if lower else plain


def compare_responses(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """request_id, outcome: exact, normalized, mismatch, missing_reference, missing_candidate.

    A request_id that occurs twice on a side is an error, which the first duplicate raises.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        one = df.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.min("output_text").alias("text"))
        checked = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("duplicate request_id "), F.col("request_id"))).cast("string")).otherwise(F.col("text"))
        return one.select("request_id", checked.alias(name), F.lit(True).alias(f"has_{name}"))

    both = side(reference, "r").join(side(candidate, "c"), "request_id", "full_outer")
    outcome = F.when(F.col("has_r").isNull(), "missing_reference").when(F.col("has_c").isNull(), "missing_candidate").when(F.col("r").eqNullSafe(F.col("c")), "exact").when(normalized(F.col("r")).eqNullSafe(normalized(F.col("c"))), "normalized").otherwise("mismatch")
    return both.select("request_id", outcome.alias("outcome"))


def gate_failures(results: DataFrame, local_mode: str, store_mode: str) -> DataFrame:
    """run_order, place, failure: the rules that each result breaks, in their order.

    ``results``: run_order, repetition, mode, status, skip_reason, error, measured_requests, missing_artifacts,
    local_activity, store_put_get, store_activity, fsck_clean.  A result that wasn't completed breaks that rule only.
    """
    label = F.concat(F.lit("rep"), F.col("repetition").cast("string"), F.lit(":"), F.col("mode"))
    says = lambda text: F.concat(label, F.lit(text))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    done = F.coalesce(F.col("status") == "completed", F.lit(False))
    local, store = F.col("mode") == local_mode, F.col("mode") == store_mode
    rules = [
        (~done, F.concat(label, F.lit(" did not complete: "), F.coalesce("skip_reason", "error", F.lit("None")))),
        (done & (F.coalesce("measured_requests", F.lit(0)) <= 0), says(" has zero measured samples")),
        (done & F.coalesce("missing_artifacts", F.lit(False)), says(" is missing required artifacts")),
        (done & local & no("local_activity"), says(" did not report local cache store and retrieve activity")),
        (done & store & no("store_put_get"), says(" did not report connector PUT and GET activity")),
        (done & store & no("store_activity"), says(" did not report store object or byte activity")),
        (done & store & no("fsck_clean"), says(" store audit was not clean")),
    ]
    each = F.array_compact(F.array(*(F.when(hit, F.struct(F.lit(i).alias("place"), text.alias("failure"))) for i, (hit, text) in enumerate(rules))))
    return results.select("run_order", F.explode(each).alias("f")).select("run_order", "f.place", "f.failure")


def gate(results: DataFrame, expected: int, correctness: str, dry_run: bool, local_mode: str, store_mode: str) -> DataFrame:
    """One row: status (pass, dry_run, failed), failure_count, failures joined by newlines in their order.

    ``expected``: results that were asked for; ``correctness``: pass, fail or skipped.  A matrix has few results.
    """
    whole = results.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array_compact(F.array(
        F.when(F.lit(dry_run), F.struct(F.lit(0).alias("place"), F.lit("dry-run does not execute real serving").alias("failure"))),
        F.when(F.col("n") != expected, F.struct(F.lit(1).alias("place"), F.concat(F.lit(f"expected {expected} mode results, found "), F.col("n").cast("string")).alias("failure"))),
        F.when(F.lit(correctness) == "skipped", F.struct(F.lit(2).alias("place"), F.lit("correctness checking did not execute").alias("failure"))),
        F.when(F.lit(correctness) == "fail", F.struct(F.lit(2).alias("place"), F.lit("correctness checking failed").alias("failure"))),
    ))).alias("f")).select(F.lit(-1).cast("long").alias("run_order"), "f.place", "f.failure")
    found = whole.unionByName(gate_failures(results, local_mode, store_mode).withColumn("run_order", F.col("run_order").cast("long")))
    rows = F.array_sort(F.collect_list(F.struct("run_order", "place", "failure")))
    one = found.agg(F.count(F.lit(1)).alias("failure_count"), F.array_join(F.transform(rows, lambda r: r["failure"]), "\n").alias("failures"))
    status = F.when(F.col("failure_count") == 0, "pass").otherwise("dry_run" if dry_run else "failed")
    return one.select(status.alias("status"), "failure_count", "failures")


def workload_summary(requests: DataFrame, *by: str) -> DataFrame:
    """Requests, distinct prefixes, requests beyond a prefix's first, their share, expected reuse and mean prompt length.

    ``requests``: prefix_id, expected_cache_reuse, prompt_chars.  Prefixes are counted before they are summed, so
    a hot one is a row a map task.
    """
    per = requests.groupBy(*by, "prefix_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("expected_cache_reuse").alias("reuse"), F.sum("prompt_chars").alias("chars"))
    n, repeated = F.sum("n"), F.sum(F.col("n") - 1)
    return per.groupBy(*by).agg(
        n.alias("request_count"), F.count(F.lit(1)).alias("actual_repeat_groups"), F.sum("reuse").alias("expected_cache_reuse_count"), repeated.alias("repeated_prefix_request_count"),
        F.round(repeated / n, 6).alias("repeated_prefix_ratio"), F.round(F.coalesce(F.sum("chars"), F.lit(0)) / n, 6).alias("average_prompt_chars"),
    )


def counter_delta(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """after - before of the keys that both have; can be negative, as counters may be reset."""
    a = before.select(*keys, F.col(value).alias("_before"))
    return a.join(after.select(*keys, F.col(value).alias("_after")), keys).select(*keys, (F.col("_after") - F.col("_before")).alias("delta"))


def pattern_sum(metrics: DataFrame, fragments: list[str]) -> DataFrame:
    """One row: the sum of all metrics whose name has every fragment, null if none has."""
    hit = F.lit(True)
    for f in fragments:
        hit = hit & F.lower("name").contains(f.lower())
    return metrics.agg(F.sum(F.when(hit, F.col("value"))).alias("total"), F.count_if(hit).alias("matches"))
