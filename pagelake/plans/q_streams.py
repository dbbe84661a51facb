"""Registered streaming queries.

Each one runs a Structured Streaming query over a driver table read as a
file stream (``Trigger.AvailableNow``), into a sink folder under the shared
checkpoint folder, and returns the sink read back.  The SQL oracle is the
batch twin's answer on the same table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.functions import html as H
from pagelake.functions import urls as U
from pagelake.plans import q_io, q_reliability, q_reports
from pagelake.plans import sqlfrag as Q
from pagelake.plans.registry import QUERIES, query
from pagelake.sinks import writers as K
from pagelake.sources import tables
from pagelake.streaming import inorder as IO
from pagelake.streaming import streams as ST


def _replayed(spark, sf_dir, name, source, key, fold):
    """Rows that a stream over the events table tells, folded in event order to the table's end."""
    told, _ = IO.replay(spark, source, tables.events(spark, sf_dir), key, fold, ST.scratch(spark, name))
    return told


def _attempts_replayed(spark, sf_dir, name, key, fold):
    return _replayed(spark, sf_dir, name, lambda: ST.attempt_stream(spark, sf_dir), key, fold)


def _read(spark, path, fmt="parquet"):
    return spark.read.format(fmt).load(path)


@query(
    "t1_page_pipeline",
    f"""SELECT page_id, url, domain, title, links_count FROM (
  SELECT page_id, url, {Q.netloc('url')} AS domain, {Q.title('html')} AS title,
         len({Q.links('html', 'url')}) AS links_count, length(html) AS content_length FROM pages)
WHERE title IS NOT NULL AND content_length > 0""",
)
def t1_pipeline(spark, sf_dir):
    """T1 + G6: pages stream → extract step → select step → valid rows out,
    failing rows to the dead-letter folder."""
    d = ST.scratch(spark, "t1")
    steps = [
        lambda df: df.select(
            "page_id",
            "url",
            U.netloc(F.col("url")).alias("domain"),
            H.title(F.col("html")).alias("title"),
            F.size(H.links(F.col("html"), F.col("url"))).alias("links_count"),
            H.content_length(F.col("html")).alias("content_length"),
        ),
    ]
    ok = lambda df: df["title"].isNotNull() & (df["content_length"] > 0)
    ST.run_pipeline(ST.table_stream(spark, sf_dir, "pages"), steps, ok, f"{d}/out", f"{d}/dead", f"{d}/ckpt")
    return _read(spark, f"{d}/out").select("page_id", "url", "domain", "title", "links_count")


@query(
    "t2_change_alerts",
    QUERIES["w8_change_detection"].sql,
)
def t2_changes(spark, sf_dir):
    """Change alerts per user from a stream, last observation in state (W8's answer)."""
    source = lambda: ST.table_stream(spark, sf_dir, "events").where(F.col("event_type") != "error")
    return IO.change_rows(_replayed(spark, sf_dir, "t2", source, "user_id", IO.ChangeFold()))


@query(
    "t3_minute_metrics",
    Q.with_attempts(
        """SELECT date_trunc('minute', ts) AS window_start, method, count(*) AS attempts,
       count(*) FILTER (WHERE status = 'success') AS successes,
       round(sum(response_time) / count(*), 6) AS mean_response_time
FROM attempts GROUP BY 1, 2"""
    ),
)
def t3_metrics(spark, sf_dir):
    """Attempts per method per tumbling minute, watermark 10 minutes, update mode into the upsert log."""
    d = ST.scratch(spark, "t3")
    ST.to_upsert_log(ST.minute_metrics(ST.attempt_stream(spark, sf_dir)), f"{d}/out", f"{d}/ckpt")
    return ST.read_upsert_log(spark, f"{d}/out", ["window_start", "method"])


@query(
    "t3_sliding_rate",
    Q.with_attempts(
        """SELECT make_timestamp((slot - j) * 900000000) AS window_start, make_timestamp((slot - j + 4) * 900000000) AS window_end, method,
       count(*) AS attempts, count(*) FILTER (WHERE status = 'success') AS successes, round(count(*) / 3600.0, 9) AS requests_per_second
FROM (SELECT method, status, epoch_us(ts) // 900000000 AS slot FROM attempts) a CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS j) k
GROUP BY slot - j, method"""
    ),
)
def t3_sliding(spark, sf_dir):
    """Request rate per method over one-hour windows that slide by 15 minutes, update mode into the upsert log."""
    d = ST.scratch(spark, "t3-sliding")
    ST.to_upsert_log(ST.sliding_rate(ST.attempt_stream(spark, sf_dir)), f"{d}/out", f"{d}/ckpt")
    return ST.read_upsert_log(spark, f"{d}/out", ["window_start", "window_end", "method"])


@query("t4_proxy_health", q_reliability.WALK_SQL)
def t4_health(spark, sf_dir):
    """T4: proxy health walk as a stateful stream keyed by proxy, in event order (W2's answer)."""
    told = _attempts_replayed(spark, sf_dir, "t4", "proxy_id", IO.HealthFold()).where("kind = 'attempt'")
    return told.select("proxy_id", "attempt_id", "health_score", F.round("success_rate", 12).alias("success_rate"))


SWEEP_SQL = (
    q_reliability.WALK_CTE
    + """,
s AS (SELECT w.proxy_id, w.rn, w.h, (epoch_us(o.ts) + 299999999) // 300000000 AS slot
  FROM walk w JOIN o ON o.proxy_id = w.proxy_id AND o.rn = w.rn),
l AS (SELECT proxy_id, slot, row_number() OVER (PARTITION BY proxy_id, slot ORDER BY rn DESC) AS back,
  CASE WHEN h < 0.3 THEN 'blocked' WHEN h < 0.5 THEN 'rate_limited' ELSE 'active' END AS status_before,
  CASE WHEN h < 0.2 THEN 'blocked' WHEN h < 0.4 THEN 'rate_limited' ELSE 'active' END AS status FROM s)
SELECT proxy_id, make_timestamp(slot * 300000000) AS swept_at, status_before, status FROM l WHERE back = 1 AND status_before <> status"""
)


@query("t4_status_sweep", SWEEP_SQL)
def t4_sweep(spark, sf_dir):
    """T4: the check every 300 s, by timer, and the proxies whose status it changes."""
    told = _attempts_replayed(spark, sf_dir, "t4-sweep", "proxy_id", IO.HealthFold()).where("kind = 'sweep'")
    return told.select("proxy_id", F.timestamp_micros("at_us").cast("timestamp_ntz").alias("swept_at"), "status_before", "status")


@query("t5_breaker_stream", q_reliability.BREAKER_SQL)
def t5_breaker(spark, sf_dir):
    """T5: circuit-breaker state as a stateful stream keyed by method, in event order (W4's answer)."""
    told = _attempts_replayed(spark, sf_dir, "t5", "method", IO.BreakerFold()).where("kind = 'attempt'")
    return told.select("method", "attempt_id", "allowed", "state", "failure_count_at_least")


CHANGES_SQL = (
    q_reliability.BREAKER_CTE
    + """,
p AS (SELECT br.method, br.rn, br.kind, br.allowed, lag(br.kind) OVER (PARTITION BY br.method ORDER BY br.rn) AS before FROM br),
q AS (SELECT p.method, p.kind, p.before, epoch_us(o.ts) AS us FROM p JOIN o ON o.method = p.method AND o.rn = p.rn WHERE p.allowed)
SELECT method, make_timestamp(us) AS changed_at, CASE WHEN before = 'c' THEN 'closed' ELSE 'half_open' END AS state_before,
       CASE WHEN kind = 'c' THEN 'closed' ELSE 'open' END AS state FROM q WHERE kind = 'o' OR before = 'o'
UNION ALL
SELECT method, make_timestamp(us + 60000000), 'open', 'half_open' FROM q WHERE kind = 'o'"""
)


@query("t5_breaker_changes", CHANGES_SQL)
def t5_changes(spark, sf_dir):
    """T5: every change of a breaker's state; half-open comes by timer, 60 s after the last failure."""
    told = _attempts_replayed(spark, sf_dir, "t5-changes", "method", IO.BreakerFold()).where("kind = 'change'")
    return told.select("method", F.timestamp_micros("at_us").cast("timestamp_ntz").alias("changed_at"), "state_before", "state")


@query(
    "t7_deal_alerts",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_extendedprice / l.l_quantity AS unit_price, p.p_retailprice
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE l.l_extendedprice / l.l_quantity <= p.p_retailprice""",
)
def t7_deals(spark, sf_dir):
    """Stateless deal-alert stream over line items joined with the static part table."""
    d = ST.scratch(spark, "t7")
    alerts = ST.deal_alerts(ST.table_stream(spark, sf_dir, "lineitem"), tables.read(spark, sf_dir, "part"))
    ST.to_files(alerts, f"{d}/out", f"{d}/ckpt")
    return _read(spark, f"{d}/out")


@query("t8_messages", QUERIES["k15_messages"].sql)
def t8_messages(spark, sf_dir):
    """Result messages written by a stream as JSON lines, read back field by field."""
    d = ST.scratch(spark, "t8")
    ST.to_files(ST.messages_stream(spark, sf_dir), f"{d}/out", f"{d}/ckpt", fmt="json")
    schema = (
        "type string, url string, status string, timestamp string, "
        "metrics struct<response_time: double, links_found: bigint, images_found: bigint>"
    )
    m = spark.read.schema("id long, message string").json(f"{d}/out")
    parsed = m.select("id", F.from_json("message", schema).alias("m"))
    return parsed.select("id", "m.type", "m.url", "m.status", "m.timestamp", "m.metrics.*")


@query("t9_task_status", QUERIES["a27_task_status"].sql)
def t9_tasks(spark, sf_dir):
    """Task status stream, latest state per task upserted per batch, then counted (A27's answer)."""
    d = ST.scratch(spark, "t9")
    ST.write_task_log(ST.task_updates(ST.table_stream(spark, sf_dir, "orders")), f"{d}/out", f"{d}/ckpt")
    latest = ST.read_upsert_log(spark, f"{d}/out", ["task_id"])
    return latest.groupBy("status").agg(F.count(F.lit(1)).alias("tasks"))


@query(
    "t10_daily_activity",
    Q.with_attempts("SELECT CAST(ts AS DATE) AS date, count(*) AS count FROM attempts GROUP BY 1"),
)
def t10_daily(spark, sf_dir):
    """Rows per day as a tumbling day window with a watermark (A4 over every day)."""
    d = ST.scratch(spark, "t10")
    ST.to_upsert_log(ST.daily_activity(ST.attempt_stream(spark, sf_dir)), f"{d}/out", f"{d}/ckpt")
    return ST.read_upsert_log(spark, f"{d}/out", ["date"])


__all__ = ["q_io", "q_reports"]


@query(
    "t6_cache_ttl",
    Q.with_attempts(
        """SELECT attempt_id, url, coalesce(age < 3600000000, false) AS hit FROM (
  SELECT attempt_id, url, epoch_us(ts) - max(CASE WHEN status = 'success' THEN epoch_us(ts) END)
         OVER (PARTITION BY url ORDER BY ts, attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS age
  FROM attempts)"""
    ),
)
def t6_cache(spark, sf_dir):
    """TTL cache (3600 s) as keyed stream state with event-time eviction; per request hit or miss (A29's replay)."""
    told = _attempts_replayed(spark, sf_dir, "t6", "url", IO.CacheFold(K.CACHE_TTL_S))
    return told.select("attempt_id", "url", "hit")
