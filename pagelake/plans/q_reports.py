"""Registered reports: research, trends, alerts, service health, change detection,
pagination, moving rates (A10–A14, A20, F11, F12, W8, W9, W16, P5–P7)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.operators import ordered as O
from pagelake.operators import reliability as R
from pagelake.operators import reports as RP
from pagelake.operators import stats as A
from pagelake.plans import q_reliability
from pagelake.plans import sqlfrag as Q
from pagelake.plans.registry import query
from pagelake.sources import tables


def _research(spark, sf_dir):
    li = tables.read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("category"), F.col("l_quantity").alias("value")
    )


@query(
    "a10_research_stats",
    """SELECT count(*) AS total_records, round(avg(l_quantity), 9) AS mean, min(l_quantity) AS min, max(l_quantity) AS max,
       max(l_quantity) - min(l_quantity) AS range FROM lineitem""",
)
def a10_stats(spark, sf_dir):
    """A10: research data summary (n, mean, min, max, range); value = l_quantity."""
    s = RP.research_stats(_research(spark, sf_dir))
    return s.withColumn("mean", F.round("mean", 9))


@query(
    "a11_research_breakdown",
    """SELECT 'category' AS breakdown, l_linestatus AS key, count(*) AS count, round(avg(l_quantity), 9) AS average
FROM lineitem GROUP BY l_linestatus
UNION ALL SELECT 'source', l_returnflag, count(*), NULL FROM lineitem GROUP BY l_returnflag""",
)
def a11_breakdown(spark, sf_dir):
    """count/average by category and count by source in one GROUPING SETS pass."""
    b = RP.research_breakdown(_research(spark, sf_dir))
    return b.withColumn("average", F.round("average", 9))


@query(
    "a12_trending_topics",
    """SELECT topic, count(DISTINCT doc_id) AS mentions, count(DISTINCT doc_id) * 10 AS trend_score
FROM documents JOIN (VALUES ('example'), ('demo'), ('test'), ('social'), ('media'), ('content')) w(topic)
  ON contains(lower(text), topic)
GROUP BY topic HAVING count(DISTINCT doc_id) > 0""",
)
def a12_trending(spark, sf_dir):
    """A12 + J6: trending topics over whole documents (fixed word list, broadcast)."""
    return RP.trending_topics(tables.read(spark, sf_dir, "documents"), "text", "doc_id")


def _method_services(spark, sf_dir):
    a = tables.attempts(spark, sf_dir).withColumn("ok", F.col("status") == "success")
    perf = A.method_performance(a)
    snap = O.breaker_replay(a).groupBy("method").agg(F.max_by("state", F.struct("ts", "attempt_id")).alias("breaker"))
    j = perf.join(snap, "method")
    status = F.when((F.col("breaker") == "closed") & (F.col("success_rate") >= 0.7), "healthy").otherwise("unhealthy")
    return j.select("method", "success_rate", "breaker", status.alias("status"))


@query(
    "a14_f12_service_health",
    q_reliability.BREAKER_CTE
    + """,
m AS (SELECT method, count(*) FILTER (WHERE status = 'success') / count(*) AS success_rate FROM attempts GROUP BY method),
z AS (SELECT method, kind FROM br WHERE rn > 0 QUALIFY row_number() OVER (PARTITION BY method ORDER BY rn DESC) = 1),
h AS (SELECT m.method, z.kind = 'c' AND m.success_rate >= 0.7 AS healthy FROM m JOIN z ON z.method = m.method)
SELECT count(*) AS total_services, count(*) FILTER (WHERE healthy) AS healthy_services,
       CASE WHEN bool_and(healthy) THEN 'healthy' ELSE 'degraded' END AS overall, count(*) FILTER (WHERE NOT healthy) AS alerts
FROM h""",
)
def a14_services(spark, sf_dir):
    """A14 + F12: per-method service health (closed breaker and rate >= 0.7), overall and alerts."""
    return RP.service_health(_method_services(spark, sf_dir))


@query(
    "f11_j9_metric_alerts",
    Q.with_attempts(
        """, m AS (
  SELECT 'avg_response_time_ms' AS metric, avg(response_time) * 1000 AS value FROM attempts
  UNION ALL SELECT 'max_response_time_ms', max(response_time) * 1000 FROM attempts
  UNION ALL SELECT 'error_rate_pct', count(*) FILTER (WHERE status <> 'success') / count(*) * 100 FROM attempts
  UNION ALL SELECT 'requests', count(*) FROM attempts)
SELECT m.metric, round(m.value, 6) AS value, CAST(coalesce(t.threshold, 100.0) AS DOUBLE) AS threshold
FROM m LEFT JOIN (VALUES ('error_rate_pct', 5.0), ('max_response_time_ms', 5000.0)) t(metric, threshold) USING (metric)
WHERE m.value > coalesce(t.threshold, 100.0)"""
    ),
)
def f11_alerts(spark, sf_dir):
    """F11 + J9 + F13: metrics over their threshold (default 100; error rate > 5 %)."""
    a = tables.attempts(spark, sf_dir)
    m = a.agg(
        (F.avg("response_time") * 1000).alias("avg_response_time_ms"),
        (F.max("response_time") * 1000).alias("max_response_time_ms"),
        (F.count_if(F.col("status") != "success") / F.count(F.lit(1)) * 100).alias("error_rate_pct"),
        F.count(F.lit(1)).cast("double").alias("requests"),
    )
    long = m.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in m.columns])
        ).alias("m")
    ).select("m.metric", "m.value")
    thr = a.sparkSession.createDataFrame([("error_rate_pct", 5.0), ("max_response_time_ms", 5000.0)], "metric string, threshold double")
    out = RP.metric_alerts(long, thr)
    return out.select("metric", F.round("value", 6).alias("value"), "threshold")


@query(
    "a20_run_report",
    Q.with_attempts(
        """SELECT method AS test_type, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS passed,
       count(*) FILTER (WHERE status <> 'success') AS failed,
       round(count(*) FILTER (WHERE status = 'success') / count(*), 9) AS pass_rate,
       CASE WHEN count(*) FILTER (WHERE status = 'success') / count(*) >= 0.9 THEN 'excellent'
            WHEN count(*) FILTER (WHERE status = 'success') / count(*) >= 0.7 THEN 'good' ELSE 'needs_work' END AS grade
FROM attempts GROUP BY method"""
    ),
)
def a20_report(spark, sf_dir):
    """Run report by type (method) with pass rate and grade."""
    a = tables.attempts(spark, sf_dir).select(F.col("method").alias("test_type"), (F.col("status") == "success").alias("passed"))
    r = A.run_report(a)
    return r.withColumn("pass_rate", F.round("pass_rate", 9))


@query(
    "w8_change_detection",
    """SELECT user_id, event_id, CASE WHEN prev_type <> event_type THEN prev_type || ' -> ' || event_type END AS type_change,
       CASE WHEN prev_value <> value THEN CAST(prev_value AS VARCHAR) || ' -> ' || CAST(value AS VARCHAR) END AS value_change
FROM (SELECT user_id, event_id, event_type, value,
             lag(event_type) OVER w AS prev_type, lag(value) OVER w AS prev_value
      FROM events WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE prev_type IS NOT NULL AND (prev_type <> event_type OR prev_value <> value)""",
)
def w8_changes(spark, sf_dir):
    """Per-key change report between successive successful observations.

    Stand-in: events per user; 'error' events are failed visits and do not
    update the state; the first sighting is no change.
    """
    from pagelake.operators import changes as C

    ev = tables.events(spark, sf_dir).where(F.col("event_type") != "error")
    c = C.changes(ev, "user_id", ["ts", "event_id"], ["event_type", "value"])
    return c.select(
        "user_id",
        "event_id",
        F.col("changes")["event_type"].alias("type_change"),
        F.col("changes")["value"].alias("value_change"),
    )


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)


@query(
    "w9_take_while",
    f"""SELECT l_orderkey, l_linenumber, l_partkey FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag,
    coalesce(max(CASE WHEN l_returnflag = 'R' OR is_last THEN 1 ELSE 0 END)
      OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stop
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL.replace(', ', ' DESC, ')} DESC) = 1 AS is_last
        FROM lineitem))
WHERE stop = 0 AND l_returnflag <> 'R'""",
)
def w9_take(spark, sf_dir):
    """Pagination take-while — line items of each order in line order until
    the first returned ('R', a failed page) or the last line (no next page)."""
    li = tables.read(spark, sf_dir, "lineitem")
    last = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*[F.col(c).desc() for c in LINE_ORDER])) == 1
    li = li.withColumn("_last", last).withColumn("_ord", F.struct(*LINE_ORDER))
    out = RP.take_while_ok(li, "l_orderkey", "_ord", F.col("l_returnflag") == "R", ~F.col("_last"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "w16_daily_rate_7d",
    Q.with_attempts(
        """, d AS (SELECT CAST(ts AS DATE) AS day, avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END) AS success_rate
          FROM attempts GROUP BY 1)
SELECT day, round(success_rate, 9) AS success_rate,
       round(avg(success_rate) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 9) AS rate_7d
FROM d"""
    ),
)
def w16_rate(spark, sf_dir):
    """Daily success rate vs its 7-day moving average (RANGE frame)."""
    d = RP.daily_rate_vs_week(tables.attempts(spark, sf_dir))
    return d.select("day", F.round("success_rate", 9).alias("success_rate"), F.round("rate_7d", 9).alias("rate_7d"))


@query(
    "p5_listings_zip",
    """SELECT o_orderkey, pos, part, qty FROM (
  SELECT o_orderkey, unnest(range(len(parts))) AS pos, parts, qtys FROM (
    SELECT l_orderkey AS o_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS parts,
           list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) FILTER (WHERE l_returnflag <> 'R') AS qtys
    FROM lineitem GROUP BY l_orderkey))
, LATERAL (SELECT parts[pos + 1] AS part, qtys[pos + 1] AS qty)""",
)
def p5_listings(spark, sf_dir):
    """P5: zip parallel lists (parts, quantities of non-returned lines) per order,
    driven by the parts list, NULL-padded where the other list is shorter.

    An order holds a handful of lines, so each list is a plain ``row_number``
    per order (one shuffle on the order key, shared by both windows and the
    join) and the zip is a left join on (order, position)."""
    li = tables.read(spark, sf_dir, "lineitem")
    per_order = W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    parts = li.select(
        F.col("l_orderkey").alias("o_orderkey"), (F.row_number().over(per_order) - 1).alias("pos"), F.col("l_partkey").alias("part")
    )
    kept = li.where(F.col("l_returnflag") != "R")
    qtys = kept.select(
        F.col("l_orderkey").alias("o_orderkey"), (F.row_number().over(per_order) - 1).alias("pos"), F.col("l_quantity").alias("qty")
    )
    return parts.join(qtys, ["o_orderkey", "pos"], "left")


@query(
    "p6_news_article",
    """SELECT page_id, coalesce(""" + Q.strip(Q.first_group("html", r"(?i)<title>([^\n]*?)</title>")) + """, 'No title') AS headline,
       """ + Q.word_count(Q.visible_text("html")) + """ AS word_count
FROM pages""",
)
def p6_news(spark, sf_dir):
    """P6 + H1b: news record per page: headline ('No title' default) and word count."""
    from pagelake.functions import html as H

    p = tables.pages(spark, sf_dir)
    return p.select(
        "page_id", H.title_or_default(F.col("html")).alias("headline"), H.word_count(H.visible_text(F.col("html"))).alias("word_count")
    )


@query(
    "a27_task_status",
    """SELECT status, count(*) AS tasks FROM (
  SELECT CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'failed' END AS status
  FROM orders) GROUP BY status""",
)
def a27_tasks(spark, sf_dir):
    """Task counts by latest state (stand-in: orders as tasks, F/O/P → completed/running/failed)."""
    from pagelake.operators import store as ST

    o = tables.read(spark, sf_dir, "orders")
    t = o.select(
        F.col("o_orderkey").alias("task_id"),
        F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed").alias("status"),
    )
    latest = ST.latest_per_key_agg(t, "task_id", "ts", "task_id")
    return latest.groupBy("status").agg(F.count(F.lit(1)).alias("tasks"))


@query(
    "a20_run_overall",
    Q.with_attempts(
        """, r AS (SELECT method AS test_type, status = 'success' AS ok, response_time FROM attempts
  UNION ALL SELECT 'overall', status = 'success', response_time FROM attempts)
SELECT test_type, count(*) AS total, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed,
       round(count(*) FILTER (WHERE ok) / count(*), 9) AS pass_rate,
       CASE WHEN count(*) FILTER (WHERE ok) / count(*) >= 0.9 THEN 'excellent'
            WHEN count(*) FILTER (WHERE ok) / count(*) >= 0.7 THEN 'good' ELSE 'needs_work' END AS grade,
       bool_or(ok) AS has_passed, bool_or(NOT ok) AS has_failed,
       min(response_time) AS min_time, round(avg(response_time), 6) AS mean_time, max(response_time) AS max_time
FROM r GROUP BY test_type"""
    ),
)
def a20_overall(spark, sf_dir):
    """Run report by type and overall, with has-any flags and time statistics."""
    a = tables.attempts(spark, sf_dir)
    a = a.select(F.col("method").alias("test_type"), (F.col("status") == "success").alias("passed"), "response_time")
    r = A.run_report_overall(a)
    return r.withColumn("pass_rate", F.round("pass_rate", 9)).withColumn("mean_time", F.round("mean_time", 6))


@query(
    "a27_task_durations",
    """SELECT status, count(*) AS tasks, count(seconds) AS ended, min(seconds) AS min_seconds,
       round(avg(seconds), 6) AS mean_seconds, max(seconds) AS max_seconds
FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'failed' END AS status,
             CASE WHEN o_orderstatus <> 'O' THEN 86400 * (1 + o_orderkey % 30) + o_orderkey % 3600 END AS seconds
      FROM orders) GROUP BY status""",
)
def a27_durations(spark, sf_dir):
    """Task durations by state (stand-in: an order starts at its date and,
    unless it is running, ends after days and seconds taken from its key)."""
    o = tables.read(spark, sf_dir, "orders")
    start = F.col("o_orderdate").cast("timestamp")
    took = 86400 * (1 + F.col("o_orderkey") % 30) + F.col("o_orderkey") % 3600
    t = o.select(
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed").alias("status"),
        start.alias("started_at"),
        F.when(F.col("o_orderstatus") != "O", F.timestamp_seconds(F.unix_timestamp(start) + took)).alias("completed_at"),
    )
    return A.task_durations(t).withColumn("mean_seconds", F.round("mean_seconds", 6))


__all__ = ["R"]
