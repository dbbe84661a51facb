"""Aggregations over stored results and attempt logs.

Every aggregate is a hash aggregate with Spark's partial (map-side) step, so
a hot key (one domain or method holding a third of the rows) ships one
partial row per map task.  Several statistics share one scan where the
reference ran one query each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions import scoring as S
from pagelake.operators import store

# Best-method rule (A9): minimum requests and score weights.
BEST_MIN_REQUESTS = 10
BEST_WEIGHTS = (0.7, 0.3)


def _r(c: Column, n: int) -> Column:
    return F.round(F.coalesce(c, F.lit(0.0)), n)


def totals(results: DataFrame) -> DataFrame:
    """A1 + A5 in one pass: counts, success rate (%, 2 dp) and time stats (3 dp).

    ``success_rate`` counts only 'success' over all rows and ``failed_results``
    only 'failed' (Q6); averages are 0 on empty input (Q27).
    """
    n = F.count(F.lit(1))
    s = F.count_if(F.col("status") == "success")
    return results.agg(
        n.alias("total_results"),
        s.alias("successful_results"),
        F.count_if(F.col("status") == "failed").alias("failed_results"),
        F.when(n > 0, F.round(s / n * 100, 2)).otherwise(F.lit(0.0)).alias("success_rate"),
        _r(F.avg("response_time"), 3).alias("avg_response_time"),
        _r(F.min("response_time"), 3).alias("min_response_time"),
        _r(F.max("response_time"), 3).alias("max_response_time"),
    )


def by_method(results: DataFrame) -> DataFrame:
    """A2: per method (not 'none'): count and average time (3 dp)."""
    return (
        results.where(F.col("method_used") != "none")
        .groupBy("method_used")
        .agg(F.count(F.lit(1)).alias("count"), _r(F.avg("response_time"), 3).alias("avg_response_time"))
    )


def top_domains(results: DataFrame, n: int = 10) -> DataFrame:
    """A3 + L3: the ``n`` domains with most rows (ties by domain, Q8)."""
    return (
        results.groupBy("domain")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col("domain"))
        .limit(n)
    )


def daily_activity(results: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """A4: rows per day since ``as_of - days``, newest day first (Q7 fixed)."""
    return (
        results.where(F.col("timestamp") >= F.date_sub(F.to_date(as_of), days))
        .groupBy(F.to_date("timestamp").alias("date"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("date").desc())
    )


def request_metrics(attempts: DataFrame) -> DataFrame:
    """Totals, 2xx successes, rate, requests/s over max(1, uptime), times.

    Uptime is the span of the attempts' own timestamps.
    """
    n = F.count(F.lit(1))
    ok = F.count_if((F.col("status_code") >= 200) & (F.col("status_code") < 300))
    uptime = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    return attempts.agg(
        n.alias("total_requests"),
        ok.alias("successful_requests"),
        (n - ok).alias("failed_requests"),
        (ok / F.greatest(n, F.lit(1))).alias("success_rate"),
        (n / F.greatest(uptime / 1e6, F.lit(1.0))).alias("requests_per_second"),
        F.coalesce(F.sum("response_time") / F.greatest(n, F.lit(1)), F.lit(0.0)).alias("avg_response_time"),
        F.coalesce(F.min("response_time"), F.lit(0.0)).alias("min_response_time"),
        F.coalesce(F.max("response_time"), F.lit(0.0)).alias("max_response_time"),
    )


def frequency_maps(attempts: DataFrame, error_col: str = "error_type") -> DataFrame:
    """Counts by status code, method, proxy and error type in one pass.

    One ``GROUPING SETS`` aggregate; NULL proxy / error values are skipped.
    Output is long: (dimension, value, count).
    """
    df = attempts.select(
        F.col("status_code").cast("string").alias("status_code"),
        F.col("method"),
        F.col("proxy_id"),
        F.col(error_col).alias("error_type"),
    )
    dims = ["status_code", "method", "proxy_id", "error_type"]
    g = df.groupingSets([[d] for d in dims], *dims).agg(
        F.count(F.lit(1)).alias("count"), *[F.grouping(d).alias(f"_g_{d}") for d in dims]
    )
    dim_name = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.lit(d)) for d in dims])
    value = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.col(d)) for d in dims])
    return g.select(dim_name.alias("dimension"), value.alias("value"), "count").where(F.col("value").isNotNull())


def method_performance(attempts: DataFrame) -> DataFrame:
    """Per method requests, successes, total time, success rate, average."""
    return attempts.groupBy("method").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status") == "success").alias("successful_requests"),
        F.sum("response_time").alias("total_response_time"),
        (F.count_if(F.col("status") == "success") / F.count(F.lit(1))).alias("success_rate"),
        F.avg("response_time").alias("avg_response_time"),
    )


def best_method(perf: DataFrame) -> DataFrame:
    """Method with the highest 0.7·rate + 0.3/(avg+1) among those with
    >= 10 requests and a positive score (first in method order on ties)."""
    w_rate, w_time = BEST_WEIGHTS
    score = F.col("success_rate") * w_rate + (1 / (F.col("avg_response_time") + 1)) * w_time
    return (
        perf.where(F.col("requests") >= BEST_MIN_REQUESTS)
        .withColumn("score", score)
        .where(F.col("score") > 0)
        .orderBy(F.col("score").desc(), F.col("method"))
        .limit(1)
    )


def status_rollup(results: DataFrame, domain: str | None = None) -> DataFrame:
    """Per status count and time avg/min/max, plus the grand total row
    (status NULL) from one ``ROLLUP``."""
    df = results.where(F.col("domain") == domain) if domain else results
    return df.rollup("status").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("response_time").alias("avg_response_time"),
        F.min("response_time").alias("min_response_time"),
        F.max("response_time").alias("max_response_time"),
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """Total, successes, failures, rate %, and the sum of non-null times
    divided by all rows (Q28: ``avg_response_time_all``)."""
    n = F.count(F.lit(1))
    s = F.count_if(F.col("status") == "success")
    return results.agg(
        n.alias("total_urls"),
        s.alias("successful"),
        (n - s).alias("failed"),
        (s / n * 100).alias("success_rate"),
        (F.coalesce(F.sum(F.when(F.col("response_time") != 0, F.col("response_time"))), F.lit(0.0)) / n).alias(
            "avg_response_time_all"
        ),
    )


def export_summary(results: DataFrame) -> DataFrame:
    """Totals and the sums of link and image counts."""
    return results.agg(
        F.count(F.lit(1)).alias("total_results"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") != "success").alias("failed"),
        F.sum(F.size("links")).alias("total_links"),
        F.sum(F.size("images")).alias("total_images"),
    )


def domain_report(results: DataFrame, n: int = 10) -> DataFrame:
    """Per domain count, mean time, success % (2 dp); top ``n`` by count."""
    return (
        results.groupBy("domain")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg("response_time").alias("mean_response_time"),
            F.round(F.avg(F.when(F.col("status") == "success", 1.0).otherwise(0.0)) * 100, 2).alias("success_pct"),
        )
        .orderBy(F.col("count").desc(), F.col("domain"))
        .limit(n)
    )


def overall_report(results: DataFrame) -> DataFrame:
    """Overall rates and the date range."""
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.round(F.avg(F.when(F.col("status") == "success", 1.0).otherwise(0.0)) * 100, 2).alias("success_pct"),
        F.avg("response_time").alias("mean_response_time"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )


QUARTILES = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0}


def quantiles_by_rank(df: DataFrame, key: str, value: str, points: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per ``key``, a hot key spread over many tasks.

    Rows are numbered within their key by one saved range sort; a quantile is
    read off the one or two rows at its rank, so what is aggregated per key are
    a few rows, never a buffer of all its values.  NULL values do not count; a
    NULL key is a key.
    """
    rows = df.select(key, value).where(F.col(value).isNotNull())
    ranked = store.numbered(rows, [F.col(value)], [key], "_rank", "_total")
    place = {name: (F.col("_total") - 1) * F.lit(q) + 1 for name, q in points.items()}
    sides = {name: (F.floor(p), F.ceil(p)) for name, p in place.items()}
    wanted = F.lit(False)
    for low, high in sides.values():
        wanted = wanted | (F.col("_rank") == low) | (F.col("_rank") == high)
    few = ranked.where(wanted)
    aggs = [F.max("_total").alias("_total")]
    for name, (low, high) in sides.items():
        aggs += [F.max(F.when(F.col("_rank") == side, F.col(value))).alias(f"_{name}_{at}") for at, side in (("lo", low), ("hi", high))]
    out = few.groupBy(key).agg(*aggs)
    between = lambda n: F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * (place[n] - sides[n][0])
    return out.select(key, *[between(n).alias(n) for n in points])


def time_quartiles(results: DataFrame, n_domains: int = 10) -> DataFrame:
    """Response-time quartiles for the first ``n_domains`` domains (by name), exact."""
    first = results.select("domain").distinct().orderBy("domain").limit(n_domains)
    # ``n_domains`` rows at most.
    few = results.select("domain", "response_time").join(F.broadcast(first), "domain", "left_semi")
    found = quantiles_by_rank(few, "domain", "response_time", QUARTILES)
    return first.join(found, "domain", "left")


def run_report(runs: DataFrame, type_col: str = "test_type", ok_col: str = "passed") -> DataFrame:
    """Per type total / passed / failed / rate, grade ≥ .9 A, ≥ .7 B, else C."""
    rate = F.count_if(F.col(ok_col)) / F.count(F.lit(1))
    return runs.groupBy(type_col).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(ok_col)).alias("passed"),
        F.count_if(~F.col(ok_col)).alias("failed"),
        rate.alias("pass_rate"),
        F.when(rate >= 0.9, "excellent").when(rate >= 0.7, "good").otherwise("needs_work").alias("grade"),
    )


def run_report_overall(runs: DataFrame, type_col: str = "test_type", ok_col: str = "passed", time_col: str = "response_time") -> DataFrame:
    """The run report by type and, as ``overall``, of all runs, with the
    has-any flags and time statistics; one GROUPING SETS pass."""
    rate = F.count_if(F.col(ok_col)) / F.count(F.lit(1))
    found = runs.groupingSets([[type_col], []], type_col).agg(
        F.grouping(type_col).alias("_all"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(ok_col)).alias("passed"),
        F.count_if(~F.col(ok_col)).alias("failed"),
        rate.alias("pass_rate"),
        F.when(rate >= 0.9, "excellent").when(rate >= 0.7, "good").otherwise("needs_work").alias("grade"),
        F.bool_or(F.col(ok_col)).alias("has_passed"),
        F.bool_or(~F.col(ok_col)).alias("has_failed"),
        F.min(time_col).alias("min_time"),
        F.avg(time_col).alias("mean_time"),
        F.max(time_col).alias("max_time"),
    )
    name = F.when(F.col("_all") == 1, "overall").otherwise(F.col(type_col)).alias(type_col)
    return found.select(name, *[c for c in found.columns if c not in (type_col, "_all")])


def task_durations(tasks: DataFrame) -> DataFrame:
    """By state the tasks, those that have ended, and the seconds they took (null: none has)."""
    seconds = F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")
    return tasks.groupBy("status").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count(seconds).alias("ended"),
        F.min(seconds).alias("min_seconds"),
        F.avg(seconds).alias("mean_seconds"),
        F.max(seconds).alias("max_seconds"),
    )


def step_durations(steps: DataFrame) -> DataFrame:
    """Total and count of step durations per request."""
    return steps.groupBy("request_id").agg(
        F.sum("duration").alias("total_duration"), F.count(F.lit(1)).alias("steps")
    )


def ip_check_summary(checks: DataFrame) -> DataFrame:
    """Checks, successes, distinct agents > 1, timing spread max − min."""
    return checks.agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("ok")).alias("successes"),
        (F.count_distinct("agent") > 1).alias("agents_vary"),
        (F.max("response_time") - F.min("response_time")).alias("timing_variation"),
    )


def with_status_class(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn("status_class", S.status_class(F.col("status_code")))
