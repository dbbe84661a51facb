"""Registered ordered-state and reliability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.operators import numbering
from pagelake.operators import ordered as O
from pagelake.operators import reliability as R
from pagelake.plans import sqlfrag as Q
from pagelake.plans.registry import query
from pagelake.sources import tables


def _attempts(spark, sf_dir):
    return tables.attempts(spark, sf_dir).withColumn("ok", F.col("status") == "success")


def _proxies(spark, sf_dir):
    a = _attempts(spark, sf_dir)
    rd = lambda n: tables.read(spark, sf_dir, n)
    return R.proxies_from(a, rd("customer"), rd("nation"), rd("region"))


ORDERED = """o AS (SELECT *, status = 'success' AS ok,
  row_number() OVER (PARTITION BY {key} ORDER BY ts, attempt_id) AS rn,
  epoch_us(ts) / 1e6 AS t FROM attempts)"""

WALK_CTE = (
    "WITH RECURSIVE "
    + Q.attempts_cte()
    + ",\n"
    + ORDERED.format(key="proxy_id")
    + """,
walk AS (
  SELECT proxy_id, rn, attempt_id,
         CASE WHEN ok THEN least(CAST(1.0 AS DOUBLE), CAST(1.0 AS DOUBLE) + CAST(0.01 AS DOUBLE))
              ELSE greatest(CAST(0.0 AS DOUBLE), CAST(1.0 AS DOUBLE) - CAST(0.05 AS DOUBLE)) END AS h,
         1 AS total, CASE WHEN ok THEN 0 ELSE 1 END AS failed
  FROM o WHERE rn = 1
  UNION ALL
  SELECT o.proxy_id, o.rn, o.attempt_id,
         CASE WHEN o.ok THEN least(CAST(1.0 AS DOUBLE), w.h + CAST(0.01 AS DOUBLE))
              ELSE greatest(CAST(0.0 AS DOUBLE), w.h - CAST(0.05 AS DOUBLE)) END,
         w.total + 1, w.failed + CASE WHEN o.ok THEN 0 ELSE 1 END
  FROM walk w JOIN o ON o.proxy_id = w.proxy_id AND o.rn = w.rn + 1
)"""
)
WALK_SQL = WALK_CTE + "\nSELECT proxy_id, attempt_id, h AS health_score, round((total - failed) / total, 12) AS success_rate FROM walk"


@query("w2_health_walk", WALK_SQL)
def w2_walk(spark, sf_dir):
    """Proxy health after each attempt (+0.01 / −0.05 clamped) and success rate."""
    w = O.health_walk(_attempts(spark, sf_dir))
    return w.select("proxy_id", "attempt_id", "health_score", F.round("success_rate", 12).alias("success_rate"))


BREAKER_SQL = (
    "WITH RECURSIVE "
    + Q.attempts_cte()
    + ",\n"
    + ORDERED.format(key="method")
    + """,
br AS (
  SELECT method, 0 AS rn, NULL::BIGINT AS attempt_id, 'c' AS kind, 0 AS k, NULL::DOUBLE AS tf, NULL::BOOLEAN AS allowed
  FROM (SELECT DISTINCT method FROM o)
  UNION ALL
  SELECT o.method, o.rn, o.attempt_id,
    CASE WHEN b.kind = 'c' OR o.t - b.tf > 60 THEN
           CASE WHEN o.ok THEN 'c' WHEN b.k + 1 >= 5 THEN 'o' ELSE 'c' END
         ELSE 'o' END,
    CASE WHEN b.kind = 'c' OR o.t - b.tf > 60 THEN CASE WHEN o.ok THEN 0 ELSE b.k + 1 END ELSE b.k END,
    CASE WHEN (b.kind = 'c' OR o.t - b.tf > 60) AND NOT o.ok THEN o.t ELSE b.tf END,
    b.kind = 'c' OR o.t - b.tf > 60
  FROM br b JOIN o ON o.method = b.method AND o.rn = b.rn + 1
)
SELECT method, attempt_id, allowed, CASE WHEN kind = 'c' THEN 'closed' ELSE 'open' END AS state,
       CAST(CASE WHEN kind = 'c' THEN k ELSE 5 END AS BIGINT) AS failure_count_at_least
FROM br WHERE rn > 0"""
)


BREAKER_CTE = BREAKER_SQL[: BREAKER_SQL.rindex("\nSELECT method")]


@query("w4_circuit_breaker", BREAKER_SQL)
def w4_breaker(spark, sf_dir):
    """Circuit-breaker replay per method (threshold 5, recovery 60 s)."""
    b = O.breaker_replay(_attempts(spark, sf_dir))
    return b.select("method", "attempt_id", "allowed", "state", "failure_count_at_least")


@query(
    "w4_breaker_snapshot",
    BREAKER_SQL.replace(
        """SELECT method, attempt_id, allowed, CASE WHEN kind = 'c' THEN 'closed' ELSE 'open' END AS state,
       CAST(CASE WHEN kind = 'c' THEN k ELSE 5 END AS BIGINT) AS failure_count_at_least
FROM br WHERE rn > 0""",
        """SELECT method, CASE WHEN kind = 'c' THEN 'closed' ELSE 'open' END AS state,
       CAST(CASE WHEN kind = 'c' THEN k ELSE 5 END AS BIGINT) AS failure_count_at_least
FROM br WHERE rn > 0 QUALIFY row_number() OVER (PARTITION BY method ORDER BY rn DESC) = 1""",
    ),
)
def w4_snapshot(spark, sf_dir):
    """W4 status snapshot: the last breaker state per method (W6 on the replay)."""
    b = O.breaker_replay(_attempts(spark, sf_dir))
    last = b.groupBy("method").agg(
        F.max_by(F.struct("state", "failure_count_at_least"), F.struct("ts", "attempt_id")).alias("_s")
    )
    return last.select("method", "_s.state", "_s.failure_count_at_least")


@query(
    "w3_zero_floored_counters",
    Q.with_attempts(
        """, s AS (SELECT proxy_id, attempt_id, ts,
    sum(CASE WHEN status <> 'success' THEN 1 ELSE -1 END) OVER w AS s_rf,
    sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE -1 END) OVER w AS s_cr
  FROM attempts WINDOW w AS (PARTITION BY proxy_id ORDER BY ts, attempt_id ROWS UNBOUNDED PRECEDING))
SELECT proxy_id, attempt_id,
  CAST(s_rf - least(0, min(s_rf) OVER w) AS BIGINT) AS recent_failures,
  CAST(s_cr - least(0, min(s_cr) OVER w) AS BIGINT) AS current_requests
FROM s WINDOW w AS (PARTITION BY proxy_id ORDER BY ts, attempt_id ROWS UNBOUNDED PRECEDING)"""
    ),
)
def w3_counters(spark, sf_dir):
    """Zero-floored counters (recent failures, current requests) per proxy."""
    c = O.zero_floored_counters(_attempts(spark, sf_dir))
    return c.select("proxy_id", "attempt_id", "recent_failures", "current_requests")


@query(
    "w5_failure_streaks",
    Q.with_attempts(
        """, s AS (SELECT method, ts, attempt_id, status,
    sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY method ORDER BY ts, attempt_id ROWS UNBOUNDED PRECEDING) AS sb
  FROM attempts)
SELECT method, count(*) AS streak_length, min(ts) AS start_ts, arg_min(attempt_id, ts) AS start_id,
       max(ts) AS end_ts, arg_max(attempt_id, ts) AS end_id
FROM s WHERE status <> 'success' GROUP BY method, sb HAVING count(*) >= 5"""
    ),
)
def w5_streaks(spark, sf_dir):
    """Consecutive-failure streaks of length >= 5 per method."""
    return O.failure_streaks(_attempts(spark, sf_dir))


@query(
    "w1_moving_avg_100",
    Q.with_attempts(
        """SELECT proxy_id, attempt_id, round(avg(response_time) OVER (PARTITION BY proxy_id ORDER BY ts, attempt_id
       ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 10) AS avg_last_100
FROM attempts WHERE response_time IS NOT NULL AND response_time <> 0"""
    ),
)
def w1_moving(spark, sf_dir):
    """Moving average of the last 100 non-zero response times per proxy."""
    m = O.moving_average_last_n(_attempts(spark, sf_dir), "proxy_id", "ts", "attempt_id", "response_time", 100, "avg_last_100")
    # Response times carry at most 4 decimals, so a mean of at most 100 ends
    # within 10 decimals: rounding there never meets a half-way tie, and both
    # engines land on the same double (at 9 dp, means over 64 rows tie and the
    # engines round the tie differently).
    return m.select("proxy_id", "attempt_id", F.round("avg_last_100", 10).alias("avg_last_100"))


@query(
    "w11_running_totals",
    Q.with_attempts(
        """SELECT method, attempt_id,
  count(*) OVER w AS requests_so_far,
  CAST(sum(CASE WHEN status_code >= 200 AND status_code < 300 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS ok_so_far,
  CAST(sum(CASE WHEN status_code >= 200 AND status_code < 300 THEN 0 ELSE 1 END) OVER w AS BIGINT) AS failed_so_far
FROM attempts WINDOW w AS (PARTITION BY method ORDER BY ts, attempt_id ROWS UNBOUNDED PRECEDING)"""
    ),
)
def w11_running(spark, sf_dir):
    """Running request / success / failure totals per method."""
    r = O.running_totals(_attempts(spark, sf_dir))
    return r.select("method", "attempt_id", "requests_so_far", "ok_so_far", "failed_so_far")


@query(
    "w7_first_success",
    Q.with_attempts(
        """SELECT request_id,
  CASE WHEN ok = 1 THEN method ELSE 'none' END AS method_used,
  CASE WHEN ok = 1 THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN ok = 1 THEN attempt_id END AS attempt_id,
  CASE WHEN ok = 0 THEN 'All scraping methods failed' END AS error_message
FROM (SELECT *, CASE WHEN status = 'success' THEN 1 ELSE 0 END AS ok,
             CASE method WHEN 'scrapy' THEN 1 WHEN 'pydoll' THEN 2 ELSE 3 END AS prio FROM attempts)
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY ok DESC, prio, ts, attempt_id) = 1"""
    ),
)
def w7_first(spark, sf_dir):
    """Progressive scrape outcome per request (first success by method priority)."""
    return R.first_success(_attempts(spark, sf_dir))


@query(
    "x32_retry_gaps",
    Q.with_attempts(
        """SELECT request_id, attempt_id, row_number() OVER w AS attempt_number,
  CASE WHEN lag(status_code) OVER w = 429 THEN pow(2.0, row_number() OVER w - 1)
       WHEN lag(status_code) OVER w IN (500, 502, 503, 504, 408, 429) THEN 5.0 END AS expected_wait_s,
  round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 6) AS actual_gap_s,
  lag(status_code) OVER w IN (500, 502, 503, 504, 408, 429) AS is_retry
FROM attempts WINDOW w AS (PARTITION BY request_id ORDER BY ts, attempt_id)"""
    ),
)
def x32_retry(spark, sf_dir):
    """Retry-gap analysis per request (attempt number, expected vs actual gap)."""
    g = R.retry_gaps(_attempts(spark, sf_dir))
    return g.withColumn("actual_gap_s", F.round("actual_gap_s", 6))


PROXIES_CTE = (
    WALK_CTE
    + """,
proxies AS (
  SELECT u.proxy_id, u.proxy_id || '.example.net' AS host, n.n_name AS country,
         coalesce(r.r_name, 'default') AS pool_name, u.total_requests, u.failed_requests, u.last_used,
         l.h AS health_score, l.sr AS success_rate,
         CASE WHEN l.h < 0.3 THEN 'blocked' WHEN l.h < 0.5 THEN 'rate_limited' ELSE 'active' END AS status
  FROM (SELECT proxy_id, user_id, count(*) AS total_requests, count(*) FILTER (WHERE status <> 'success') AS failed_requests,
               max(ts) AS last_used FROM attempts GROUP BY proxy_id, user_id) u
  JOIN (SELECT proxy_id, h, (total - failed) / total AS sr FROM walk
        QUALIFY row_number() OVER (PARTITION BY proxy_id ORDER BY rn DESC) = 1) l USING (proxy_id)
  LEFT JOIN customer c ON c.c_custkey = u.user_id
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
)"""
)


@query(
    "w12_health_rank",
    PROXIES_CTE
    + """
SELECT proxy_id, pool_name, round(health_score * 0.7 + success_rate * 0.3, 9) AS score,
       row_number() OVER (PARTITION BY pool_name ORDER BY health_score * 0.7 + success_rate * 0.3 DESC, proxy_id) AS rank
FROM proxies""",
)
def w12_rank(spark, sf_dir):
    """Health-based proxy choice rank per pool (0.7·health + 0.3·rate)."""
    r = R.health_rank(_proxies(spark, sf_dir))
    return r.select("proxy_id", "pool_name", F.round("score", 9).alias("score"), "rank")


@query(
    "w13_least_used",
    PROXIES_CTE
    + "\nSELECT proxy_id, pool_name, total_requests FROM proxies "
    "QUALIFY total_requests = min(total_requests) OVER (PARTITION BY pool_name)",
)
def w13_least(spark, sf_dir):
    """Least-used proxies per pool (all ties are candidates)."""
    return R.least_used(_proxies(spark, sf_dir)).select("proxy_id", "pool_name", "total_requests")


@query(
    "w14_a24_geographic",
    PROXIES_CTE
    + """, cc AS (SELECT pool_name, coalesce(country, 'unknown') AS c, count(*) AS country_count FROM proxies GROUP BY 1, 2
        QUALIFY country_count = min(country_count) OVER (PARTITION BY pool_name))
SELECT p.proxy_id, p.pool_name, p.country, cc.country_count FROM proxies p
JOIN cc ON cc.pool_name = p.pool_name AND cc.c = coalesce(p.country, 'unknown')""",
)
def w14_geo(spark, sf_dir):
    """W14 + A24: proxies in the least common country of their pool."""
    g = R.geographic_candidates(_proxies(spark, sf_dir))
    return g.select("proxy_id", "pool_name", "country", "country_count")


SESSIONS_CTE = """,
so AS (SELECT attempt_id % 7 AS session_id, proxy_id, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY attempt_id % 7 ORDER BY ts, attempt_id) AS rn FROM attempts),
sticky AS (
  SELECT session_id, rn, us, us AS created, proxy_id FROM so WHERE rn = 1
  UNION ALL
  SELECT so.session_id, so.rn, so.us, CASE WHEN so.us - k.created >= 1800000000 THEN so.us ELSE k.created END,
         CASE WHEN so.us - k.created >= 1800000000 THEN so.proxy_id ELSE k.proxy_id END
  FROM sticky k JOIN so ON so.session_id = k.session_id AND so.rn = k.rn + 1
)"""


def _session_log(spark, sf_dir):
    """Stand-in: the attempts of seven sticky sessions."""
    return tables.attempts(spark, sf_dir).withColumn("session_id", F.col("attempt_id") % 7)


@query(
    "a21_session_intervals",
    "WITH RECURSIVE "
    + Q.attempts_cte()
    + SESSIONS_CTE
    + """
SELECT DISTINCT session_id, proxy_id, make_timestamp(created) AS created_at, make_timestamp(created + 1800000000) AS expires_at FROM sticky""",
)
def a21_intervals(spark, sf_dir):
    """Interval table of the sticky sessions (1800 s from the request that opens one)."""
    return R.session_intervals(_session_log(spark, sf_dir))


@query(
    "a21_session_proxies",
    "WITH RECURSIVE "
    + Q.attempts_cte()
    + SESSIONS_CTE
    + """
SELECT s.attempt_id, s.proxy_id AS asked_proxy, k.proxy_id AS sticky_proxy
FROM (SELECT attempt_id, proxy_id, attempt_id % 7 AS session_id, row_number() OVER (PARTITION BY attempt_id % 7 ORDER BY ts, attempt_id) AS rn
      FROM attempts) s JOIN sticky k ON k.session_id = s.session_id AND k.rn = s.rn""",
)
def a21_proxies(spark, sf_dir):
    """The proxy that each request gets, by the session interval it falls in."""
    log = _session_log(spark, sf_dir)
    return R.sticky_proxies(log).select("attempt_id", F.col("proxy_id").alias("asked_proxy"), "sticky_proxy")


@query(
    "a21_pool_status",
    PROXIES_CTE
    + SESSIONS_CTE
    + f""", live AS (SELECT DISTINCT session_id, proxy_id, created FROM sticky
  WHERE created <= epoch_us({Q.AS_OF_SQL}) AND epoch_us({Q.AS_OF_SQL}) < created + 1800000000)
SELECT pool_name, count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active,
       count(*) FILTER (WHERE status = 'blocked') AS blocked, count(*) FILTER (WHERE status = 'failed') AS failed,
       count(*) FILTER (WHERE status = 'rate_limited') AS rate_limited,
       CAST(sum((SELECT count(*) FROM live WHERE live.proxy_id = proxies.proxy_id)) AS BIGINT) AS pool_sessions,
       (SELECT count(*) FROM live) AS active_sessions
FROM proxies GROUP BY pool_name""",
)
def a21_pools(spark, sf_dir):
    """Pool status counts from the proxies' final health, with the sticky sessions that are live at the as-of time."""
    p = numbering.saved(_proxies(spark, sf_dir), "proxies")
    live = numbering.saved(R.live_sessions(R.session_intervals(_session_log(spark, sf_dir)), tables.as_of()), "live-sessions")
    return R.pool_status(p).join(R.sessions_by_pool(p, live), "pool_name")


@query(
    "a22_a23_proxy_usage",
    PROXIES_CTE
    + """,
cs AS (SELECT proxy_id, ts, attempt_id, event_type,
    sum(CASE WHEN status <> 'success' THEN 1 ELSE -1 END) OVER w AS s_rf,
    sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE -1 END) OVER w AS s_cr
  FROM attempts WINDOW w AS (PARTITION BY proxy_id ORDER BY ts, attempt_id ROWS UNBOUNDED PRECEDING)),
cf AS (SELECT proxy_id, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS selected_requests,
    CAST(arg_max(s_cr, (ts, attempt_id)) - least(0, min(s_cr)) AS BIGINT) AS current_requests,
    CAST(arg_max(s_rf, (ts, attempt_id)) - least(0, min(s_rf)) AS BIGINT) AS recent_failures
  FROM cs GROUP BY proxy_id)
SELECT proxy_id, total_requests, failed_requests, last_used,
       round((total_requests - failed_requests) / total_requests, 9) AS success_rate,
       health_score, status, selected_requests, current_requests, recent_failures
FROM proxies JOIN cf USING (proxy_id)""",
)
def a22_usage(spark, sf_dir):
    """A22 + A23 + X28: per-proxy usage, selections, open requests, success rate, final health and status."""
    p = _proxies(spark, sf_dir).join(R.proxy_counters(_attempts(spark, sf_dir)), "proxy_id")
    return p.select(
        "proxy_id",
        "total_requests",
        "failed_requests",
        "last_used",
        F.round((F.col("total_requests") - F.col("failed_requests")) / F.col("total_requests"), 9).alias("success_rate"),
        "health_score",
        "status",
        "selected_requests",
        "current_requests",
        "recent_failures",
    )


@query(
    "x28_status_rules",
    PROXIES_CTE
    + """
SELECT proxy_id, status AS status_per_result,
       CASE WHEN health_score < 0.2 THEN 'blocked' WHEN health_score < 0.4 THEN 'rate_limited' ELSE 'active' END AS status_sweep,
       proxy_id || '.example.net:8080:http' AS proxy_key, 'http://' || proxy_id || '.example.net:8080' AS proxy_url
FROM proxies""",
)
def x28_rules(spark, sf_dir):
    """X28 + X29: both status rules (per result / periodic sweep), proxy id and URL."""
    from pagelake.functions import scoring as S

    p = _proxies(spark, sf_dir)
    return p.select(
        "proxy_id",
        F.col("status").alias("status_per_result"),
        S.proxy_status(F.col("health_score"), "sweep").alias("status_sweep"),
        S.proxy_id(F.col("host"), F.col("port"), F.col("proxy_type")).alias("proxy_key"),
        S.proxy_url(F.col("proxy_type"), F.col("host"), F.col("port")).alias("proxy_url"),
    )


@query(
    "f15_active_in_country",
    PROXIES_CTE + "\nSELECT proxy_id, country FROM proxies WHERE status = 'active' AND lower(country) = lower('nation_3')",
)
def f15_country(spark, sf_dir):
    """active proxies of a country, case-insensitive ('nation_3')."""
    return R.active_in_country(_proxies(spark, sf_dir), "nation_3").select("proxy_id", "country")


@query(
    "a26_vpn_rotation",
    Q.with_attempts(
        """, s AS (SELECT proxy_id, attempt_id, ts,
    sum(CASE WHEN status <> 'success' THEN 1 ELSE -1 END) OVER w AS s_rf
  FROM attempts WINDOW w AS (PARTITION BY proxy_id ORDER BY ts, attempt_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT proxy_id, ts, attempt_id, s_rf - least(0, min(s_rf) OVER (PARTITION BY proxy_id ORDER BY ts, attempt_id
        ROWS UNBOUNDED PRECEDING)) AS rf FROM s)
SELECT CAST(sum(rf) AS BIGINT) AS recent_failures_total, sum(rf) >= 3 AS rotate_vpn FROM (
  SELECT proxy_id, rf FROM c QUALIFY row_number() OVER (PARTITION BY proxy_id ORDER BY ts DESC, attempt_id DESC) = 1)"""
    ),
)
def a26_vpn(spark, sf_dir):
    """Sum of the proxies' latest recent-failure counters against the threshold 3."""
    c = O.zero_floored_counters(_attempts(spark, sf_dir))
    return R.vpn_rotation_flag(c)


SERVERS_SQL = """servers AS (
  SELECT s_name AS name, n.n_name AS country, coalesce(CAST(s_acctbal - 100.0 * floor(s_acctbal / 100.0) AS DOUBLE), 0.0) AS load,
         coalesce(CAST(s_suppkey % 250 AS DOUBLE), 0.0) AS latency
  FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey)"""


@query(
    "w15_best_servers",
    "WITH "
    + SERVERS_SQL
    + """
SELECT name, country, round(load, 6) AS load, latency,
       row_number() OVER (PARTITION BY country ORDER BY load, latency, name) AS country_rank,
       round(1 - load / 100, 6) AS server_health
FROM servers""",
)
def w15_servers(spark, sf_dir):
    """S8 + W15 + X35: servers from suppliers ranked per country by load, latency."""
    sv = R.servers_from(tables.read(spark, sf_dir, "supplier"), tables.read(spark, sf_dir, "nation"))
    b = R.best_servers(sv)
    return b.select(
        "name", "country", F.round("load", 6).alias("load"), "latency", "country_rank", F.round("server_health", 6).alias("server_health")
    )


@query(
    "j11_next_server",
    "WITH "
    + SERVERS_SQL
    + """
SELECT name, country FROM servers
WHERE name NOT IN (SELECT name FROM servers ORDER BY load, latency, name LIMIT 1)
ORDER BY load, latency, name LIMIT 1""",
)
def j11_next(spark, sf_dir):
    """J11 + W15: best server other than the current (best) one, via anti join."""
    sv = R.servers_from(tables.read(spark, sf_dir, "supplier"), tables.read(spark, sf_dir, "nation"))
    current = sv.orderBy("load", "latency", "name").limit(1)
    return R.next_server(sv, current).select("name", "country")
