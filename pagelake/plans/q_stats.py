"""Registered statistics over stored results and attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.functions import scoring as S
from pagelake.operators import stats as A
from pagelake.plans import sqlfrag as Q
from pagelake.plans.registry import query
from pagelake.sources import tables


def _results(spark, sf_dir):
    return tables.scrape_results(spark, sf_dir)


def _attempts(spark, sf_dir):
    a = tables.attempts(spark, sf_dir)
    # X9 on the stand-in: the error class of a failed attempt.
    err = S.error_status(F.lit(None).cast("string"), F.col("status_code"), F.lit(None).cast("string"))
    return a.withColumn("error_type", F.when(F.col("status") == "failed", err))


ERROR_TYPE_SQL = (
    "CASE WHEN status = 'failed' THEN CASE WHEN status_code = 429 THEN 'rate_limited' "
    "WHEN status_code = 403 THEN 'blocked' ELSE 'failed' END END"
)


@query(
    "a1_a5_totals",
    Q.with_results(
        """SELECT count(*) AS total_results,
       count(*) FILTER (WHERE status = 'success') AS successful_results,
       count(*) FILTER (WHERE status = 'failed') AS failed_results,
       CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE status = 'success') / count(*) * 100, 2) ELSE 0.0 END AS success_rate,
       round(coalesce(avg(response_time), 0), 3) AS avg_response_time,
       round(coalesce(min(response_time), 0), 3) AS min_response_time,
       round(coalesce(max(response_time), 0), 3) AS max_response_time
FROM scrape_results"""
    ),
)
def a1_totals(spark, sf_dir):
    """A1 + A5: totals, success rate and response-time stats in one pass."""
    return A.totals(_results(spark, sf_dir))


@query(
    "a2_by_method",
    Q.with_results(
        """SELECT method_used, count(*) AS count, round(coalesce(avg(response_time), 0), 3) AS avg_response_time
FROM scrape_results WHERE method_used <> 'none' GROUP BY method_used"""
    ),
)
def a2_method(spark, sf_dir):
    """A2: per-method count and average time."""
    return A.by_method(_results(spark, sf_dir))


@query(
    "a3_top_domains",
    Q.with_results("SELECT domain, count(*) AS count FROM scrape_results GROUP BY domain ORDER BY count DESC, domain LIMIT 10"),
)
def a3_domains(spark, sf_dir):
    """A3 + L3: top 10 domains by stored rows."""
    return A.top_domains(_results(spark, sf_dir), 10)


@query(
    "a4_daily_activity",
    Q.with_results(
        f"""SELECT CAST(timestamp AS DATE) AS date, count(*) AS count FROM scrape_results
WHERE timestamp >= CAST({Q.AS_OF_SQL} AS DATE) - INTERVAL 7 DAY GROUP BY 1 ORDER BY 1 DESC"""
    ),
)
def a4_daily(spark, sf_dir):
    """A4: rows per day over the 7 days before as-of."""
    return A.daily_activity(_results(spark, sf_dir), tables.as_of(), 7)


@query(
    "a6_request_metrics",
    Q.with_attempts(
        """SELECT count(*) AS total_requests,
       count(*) FILTER (WHERE status_code >= 200 AND status_code < 300) AS successful_requests,
       count(*) - count(*) FILTER (WHERE status_code >= 200 AND status_code < 300) AS failed_requests,
       round(count(*) FILTER (WHERE status_code >= 200 AND status_code < 300) / greatest(count(*), 1), 6) AS success_rate,
       round(count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1.0), 6) AS requests_per_second,
       round(coalesce(sum(response_time) / greatest(count(*), 1), 0), 6) AS avg_response_time,
       coalesce(min(response_time), 0) AS min_response_time,
       coalesce(max(response_time), 0) AS max_response_time
FROM attempts"""
    ),
)
def a6_metrics(spark, sf_dir):
    """A6 + S11: request metrics over the attempt log (uptime = span of timestamps)."""
    m = A.request_metrics(_attempts(spark, sf_dir))
    return m.select(
        "total_requests",
        "successful_requests",
        "failed_requests",
        F.round("success_rate", 6).alias("success_rate"),
        F.round("requests_per_second", 6).alias("requests_per_second"),
        F.round("avg_response_time", 6).alias("avg_response_time"),
        "min_response_time",
        "max_response_time",
    )


@query(
    "a7_frequency_maps",
    Q.with_attempts(
        f"""SELECT dimension, value, count FROM (
  SELECT 'status_code' AS dimension, CAST(status_code AS VARCHAR) AS value, count(*) AS count FROM attempts GROUP BY 2
  UNION ALL SELECT 'method', method, count(*) FROM attempts GROUP BY 2
  UNION ALL SELECT 'proxy_id', proxy_id, count(*) FROM attempts GROUP BY 2
  UNION ALL SELECT 'error_type', {ERROR_TYPE_SQL}, count(*) FROM attempts GROUP BY 2
) WHERE value IS NOT NULL"""
    ),
)
def a7_freq(spark, sf_dir):
    """Status-code, method, proxy and error-type counts from one GROUPING SETS pass."""
    return A.frequency_maps(_attempts(spark, sf_dir))


PERF_SQL = """SELECT method, count(*) AS requests, count(*) FILTER (WHERE status = 'success') AS successful_requests,
       round(sum(response_time), 6) AS total_response_time,
       round(count(*) FILTER (WHERE status = 'success') / count(*), 6) AS success_rate,
       round(avg(response_time), 6) AS avg_response_time
FROM attempts GROUP BY method"""


@query("a8_method_performance", Q.with_attempts(PERF_SQL))
def a8_perf(spark, sf_dir):
    """Per-method requests, successes, total time, rate, average."""
    p = A.method_performance(_attempts(spark, sf_dir))
    return p.select(
        "method",
        "requests",
        "successful_requests",
        F.round("total_response_time", 6).alias("total_response_time"),
        F.round("success_rate", 6).alias("success_rate"),
        F.round("avg_response_time", 6).alias("avg_response_time"),
    )


@query(
    "a9_best_method",
    Q.with_attempts(
        f"""SELECT method, round(success_rate * 0.7 + (1 / (avg_response_time + 1)) * 0.3, 6) AS score FROM (
  SELECT method, count(*) AS requests, count(*) FILTER (WHERE status = 'success') / count(*) AS success_rate,
         avg(response_time) AS avg_response_time FROM attempts GROUP BY method)
WHERE requests >= 10 AND success_rate * 0.7 + (1 / (avg_response_time + 1)) * 0.3 > 0
ORDER BY score DESC, method LIMIT 1"""
    ),
)
def a9_best(spark, sf_dir):
    """The best-performing method (>= 10 requests, highest score)."""
    b = A.best_method(A.method_performance(_attempts(spark, sf_dir)))
    return b.select("method", F.round("score", 6).alias("score"))


@query(
    "a15_status_rollup",
    Q.with_results(
        """SELECT status, count(*) AS count, round(avg(response_time), 6) AS avg_response_time,
       min(response_time) AS min_response_time, max(response_time) AS max_response_time
FROM scrape_results GROUP BY ROLLUP (status)"""
    ),
)
def a15_rollup(spark, sf_dir):
    """Per-status count and time stats plus the grand total (ROLLUP)."""
    r = A.status_rollup(_results(spark, sf_dir))
    return r.withColumn("avg_response_time", F.round("avg_response_time", 6))


@query(
    "a16_batch_summary",
    Q.with_results(
        """SELECT count(*) AS total_urls, count(*) FILTER (WHERE status = 'success') AS successful,
       count(*) - count(*) FILTER (WHERE status = 'success') AS failed,
       round(count(*) FILTER (WHERE status = 'success') / count(*) * 100, 6) AS success_rate,
       round(coalesce(sum(response_time) FILTER (WHERE response_time <> 0), 0) / count(*), 6) AS avg_response_time_all
FROM scrape_results"""
    ),
)
def a16_batch(spark, sf_dir):
    """Batch summary; the average divides by all rows (Q28)."""
    b = A.batch_summary(_results(spark, sf_dir))
    return b.select(
        "total_urls",
        "successful",
        "failed",
        F.round("success_rate", 6).alias("success_rate"),
        F.round("avg_response_time_all", 6).alias("avg_response_time_all"),
    )


@query(
    "a17_export_summary",
    Q.with_results(
        """SELECT count(*) AS total_results, count(*) FILTER (WHERE status = 'success') AS successful,
       count(*) FILTER (WHERE status <> 'success') AS failed,
       CAST(sum(len(links)) AS BIGINT) AS total_links, CAST(sum(len(images)) AS BIGINT) AS total_images
FROM scrape_results"""
    ),
)
def a17_export(spark, sf_dir):
    """Export summary with link and image totals."""
    return A.export_summary(_results(spark, sf_dir))


@query(
    "a18_domain_report",
    Q.with_results(
        """SELECT domain, count(*) AS count, round(avg(response_time), 6) AS mean_response_time,
       round(avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END) * 100, 2) AS success_pct
FROM scrape_results GROUP BY domain ORDER BY count DESC, domain LIMIT 10"""
    ),
)
def a18_domains(spark, sf_dir):
    """Per-domain report, top 10 by count."""
    d = A.domain_report(_results(spark, sf_dir), 10)
    return d.withColumn("mean_response_time", F.round("mean_response_time", 6))


@query(
    "a18_overall",
    Q.with_results(
        """SELECT count(*) AS total, round(avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END) * 100, 2) AS success_pct,
       round(avg(response_time), 6) AS mean_response_time, min(timestamp) AS first_seen, max(timestamp) AS last_seen
FROM scrape_results"""
    ),
)
def a18_overall(spark, sf_dir):
    """Overall rates and date range."""
    o = A.overall_report(_results(spark, sf_dir))
    return o.withColumn("mean_response_time", F.round("mean_response_time", 6))


@query(
    "a19_time_quartiles",
    Q.with_results(
        """SELECT domain, round(quantile_cont(response_time, 0.0), 6) AS q0, round(quantile_cont(response_time, 0.25), 6) AS q25,
       round(quantile_cont(response_time, 0.5), 6) AS q50, round(quantile_cont(response_time, 0.75), 6) AS q75,
       round(quantile_cont(response_time, 1.0), 6) AS q100
FROM scrape_results WHERE domain IN (SELECT DISTINCT domain FROM scrape_results ORDER BY domain LIMIT 10)
GROUP BY domain"""
    ),
)
def a19_quartiles(spark, sf_dir):
    """Exact response-time quartiles of the first 10 domains."""
    q = A.time_quartiles(_results(spark, sf_dir), 10)
    return q.select("domain", *[F.round(c, 6).alias(c) for c in ("q0", "q25", "q50", "q75", "q100")])


@query(
    "a19_status_method_counts",
    Q.with_results(
        """SELECT 'status' AS dimension, status AS value, count(*) AS count FROM scrape_results GROUP BY status
UNION ALL SELECT 'method', method_used, count(*) FROM scrape_results GROUP BY method_used"""
    ),
)
def a19_counts(spark, sf_dir):
    """Chart counts by status and by method (one GROUPING SETS pass)."""
    r = _results(spark, sf_dir)
    g = r.groupingSets([["status"], ["method_used"]], "status", "method_used").agg(
        F.count(F.lit(1)).alias("count"), F.grouping("status").alias("_gs")
    )
    return g.select(
        F.when(F.col("_gs") == 0, F.lit("status")).otherwise(F.lit("method")).alias("dimension"),
        F.when(F.col("_gs") == 0, F.col("status")).otherwise(F.col("method_used")).alias("value"),
        "count",
    )


@query(
    "a19_points",
    Q.with_results("""SELECT id, timestamp, response_time, status_code FROM scrape_results"""),
)
def a19_points(spark, sf_dir):
    """The (time, response time, code) point of every result."""
    return _results(spark, sf_dir).select("id", "timestamp", "response_time", "status_code")
