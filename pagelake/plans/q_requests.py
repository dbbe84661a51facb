"""Registered queries over request specs, proxy rows and profiles
(X30, F16, P3, P7, U-d, J7, X32, X36).

The given tables hold no such rows, so each query derives them from a given
table by a rule that its SQL restates.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.operators import records as RC
from pagelake.operators import reliability as R
from pagelake.operators import stats as ST
from pagelake.plans import sqlfrag as Q
from pagelake.plans.registry import query
from pagelake.sources import tables

# Wait conditions of the derived requests, by order key mod 5.
CONDITIONS = [[], ["networkidle"], ["load", "domcontentloaded", "selector"], ["javascript ready"], ["a", "b", "networkidle0"]]
AUTH = ["none", "none", "form", "basic"]  # by customer key mod 4
MAX_RETRIES = 2  # three attempts, as the derived attempt log holds


def requests(spark, sf_dir):
    """One request spec per order."""
    o = tables.read(spark, sf_dir, "orders")
    pick = lambda values, i: F.element_at(values, (i + 1).cast("int"))
    conditions = F.array(*[F.array(*[F.lit(x) for x in c]).cast("array<string>") for c in CONDITIONS])
    return o.select(
        F.col("o_orderkey").alias("request_id"),
        pick(conditions, F.col("o_orderkey") % 5).alias("wait_conditions"),
        pick(F.array(*[F.lit(a) for a in AUTH]), F.col("o_custkey") % 4).alias("auth_type"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderpriority") == "2-HIGH", "high").otherwise("normal").alias("priority"),
        F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("title"), F.lit("h1"))).alias("selectors"),
    )


@query(
    "x30_method_suggestion",
    Q.with_attempts(
        """, perf AS (SELECT method, count(*) AS n, avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END) AS rate, avg(response_time) AS t
  FROM attempts GROUP BY method),
best AS (SELECT method FROM perf WHERE n >= 10 AND rate * 0.7 + (1 / (t + 1)) * 0.3 > 0
  ORDER BY rate * 0.7 + (1 / (t + 1)) * 0.3 DESC, method LIMIT 1),
r AS (SELECT o_orderkey AS request_id, o_orderkey % 5 IN (1, 3, 4) AS js, o_orderkey % 5 IN (2, 4) AS cx,
  o_custkey % 4 IN (2, 3) AS login, o_orderpriority IN ('1-URGENT', '2-HIGH') AS urgent, o_orderstatus = 'F' AS sel FROM orders)
SELECT request_id,
  CASE WHEN js OR login OR cx THEN 'playwright' WHEN urgent THEN 'pydoll' ELSE 'scrapy' END AS speed,
  CASE WHEN js OR login THEN 'playwright' WHEN sel THEN 'pydoll' ELSE 'scrapy' END AS quality,
  CASE WHEN NOT js AND NOT login THEN 'scrapy' WHEN NOT cx THEN 'pydoll' ELSE 'playwright' END AS cost,
  coalesce((SELECT method FROM best), 'playwright') AS reliability
FROM r"""
    ),
)
def x30_methods(spark, sf_dir):
    """Method of each request under all four strategies; reliability from the attempt log."""
    a = tables.attempts(spark, sf_dir)
    perf = a.groupBy("method").agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg((F.col("status") == "success").cast("double")).alias("success_rate"),
        F.avg("response_time").alias("avg_response_time"),
    )
    best = ST.best_method(perf).select(F.col("method").alias("best_method"))
    r = requests(spark, sf_dir)
    for s in ("speed", "quality", "cost"):
        r = R.suggest_method(r, s).withColumnRenamed("suggested_method", s)
    r = R.suggest_method(r, "reliability", best).withColumnRenamed("suggested_method", "reliability")
    return r.select("request_id", "speed", "quality", "cost", "reliability")


PROXY_SQL = """SELECT c_custkey AS proxy_id, c_custkey * 97 % 70000 - 40 AS port, c_acctbal / 10000 AS health_score,
  1 - c_custkey % 7 / 6.0 AS success_rate, ['http', 'socks5', 'vpn', 'ftp'][CAST(c_custkey % 4 AS BIGINT) + 1] AS proxy_type,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 'broken' ELSE 'active' END AS status,
  'pool' || CAST(c_nationkey AS VARCHAR) AS pool_name, CASE WHEN c_custkey % 5 = 0 THEN 'pia' ELSE 'own' END AS provider FROM customer"""


def proxies(spark, sf_dir):
    """One proxy row per customer, some of them wrong."""
    key = F.col("c_custkey")
    kinds = F.array(*[F.lit(k) for k in ("http", "socks5", "vpn", "ftp")])
    return tables.read(spark, sf_dir, "customer").select(
        key.alias("proxy_id"),
        (key * 97 % 70000 - 40).alias("port"),
        (F.col("c_acctbal") / 10000).alias("health_score"),
        (1 - key % 7 / F.lit(6.0)).alias("success_rate"),
        F.element_at(kinds, (key % 4 + 1).cast("int")).alias("proxy_type"),
        F.when(key % 11 == 0, F.lit(None)).when(F.col("c_mktsegment") == "MACHINERY", "broken").otherwise("active").alias("status"),
        F.concat(F.lit("pool"), F.col("c_nationkey").cast("string")).alias("pool_name"),
        F.when(key % 5 == 0, "pia").otherwise("own").alias("provider"),
    )


@query(
    "f16_proxy_rules",
    f"""WITH p AS ({PROXY_SQL})
SELECT proxy_id, concat_ws('|',
  CASE WHEN port BETWEEN 1 AND 65535 THEN NULL ELSE 'port must be between 1 and 65535' END,
  CASE WHEN health_score BETWEEN 0 AND 1 THEN NULL ELSE 'health_score must be between 0.0 and 1.0' END,
  CASE WHEN success_rate BETWEEN 0 AND 1 THEN NULL ELSE 'success_rate must be between 0.0 and 1.0' END,
  CASE WHEN proxy_type IN ('http', 'https', 'socks4', 'socks5', 'vpn') THEN NULL ELSE 'proxy_type is not known' END,
  CASE WHEN status IN ('active', 'inactive', 'blocked', 'failed', 'rate_limited') THEN NULL ELSE 'status is not known' END) AS violations
FROM p""",
)
def f16_proxy_rules(spark, sf_dir):
    """F16: port range, score range and enum rules of each proxy row."""
    return proxies(spark, sf_dir).select("proxy_id", F.concat_ws("|", RC.proxy_violations()).alias("violations"))


@query(
    "ud_vpn_replacement",
    f"""WITH p AS ({PROXY_SQL})
SELECT proxy_id, pool_name, provider FROM p WHERE provider <> 'pia'
UNION ALL SELECT -1, pool_name, 'pia' FROM (SELECT DISTINCT pool_name FROM p)""",
)
def ud_replacement(spark, sf_dir):
    """U-d: VPN proxies of every pool replaced by the new one."""
    p = proxies(spark, sf_dir).select("proxy_id", "pool_name", "provider")
    new = spark.range(1).select(F.lit(-1).cast("long").alias("proxy_id"), F.lit("pia").alias("provider"))
    return RC.replace_vpn(p, new)


@query(
    "p3_processed_records",
    Q.with_results(
        """SELECT id, CASE WHEN status = 'success' THEN 'processed' ELSE 'failed' END AS kind, url,
  CASE WHEN status = 'success' THEN title END AS title, CASE WHEN status = 'success' THEN timestamp END AS timestamp,
  CASE WHEN status <> 'success' THEN error_message END AS error FROM scrape_results"""
    ),
)
def p3_records(spark, sf_dir):
    """Processed records and failed URLs of all results."""
    return RC.processed_records(tables.scrape_results(spark, sf_dir))


@query(
    "p7_social_profiles",
    """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n,
  count(*) OVER (PARTITION BY o_custkey) AS posts FROM orders),
g AS (SELECT o_custkey, max(posts) AS posts, string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY n) FILTER (WHERE n <= 10) AS recent_posts FROM r GROUP BY 1)
SELECT c_custkey AS user_id, c_name AS username, coalesce(posts, 0) AS posts, c_acctbal > 5000 AS is_verified,
  coalesce(recent_posts, '') AS recent_posts FROM customer LEFT JOIN g ON o_custkey = c_custkey""",
)
def p7_profiles(spark, sf_dir):
    """Profile per customer; its orders are the posts, newest first."""
    c = tables.read(spark, sf_dir, "customer")
    people = c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.when(F.col("c_acctbal") > 5000, "badge").alias("verified_badge"))
    o = tables.read(spark, sf_dir, "orders")
    posts = o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").cast("string").alias("post"), "o_orderdate", "o_orderkey")
    out = RC.social_profiles(people, posts, "user_id", [F.col("o_orderdate").desc(), F.col("o_orderkey")])
    return out.withColumn("recent_posts", F.array_join("recent_posts", "|"))


@query(
    "j7_sticky_sessions",
    Q.with_attempts(
        f""", s AS (SELECT user_id AS session_id, max(ts) AS created_at, max_by(proxy_id, (ts, attempt_id)) AS proxy_id,
  user_id % 4 * 86400 AS duration_s FROM attempts GROUP BY user_id),
p AS (SELECT DISTINCT proxy_id, user_id % 3 <> 0 AS active FROM attempts)
SELECT session_id, s.proxy_id FROM s JOIN p ON p.proxy_id = s.proxy_id AND active
WHERE epoch_us({Q.AS_OF_SQL}) - epoch_us(created_at) < duration_s * 1000000"""
    ),
)
def j7_sessions(spark, sf_dir):
    """Session → proxy within its lifetime, if the proxy is still active (one session per user)."""
    a = tables.attempts(spark, sf_dir)
    s = a.groupBy(F.col("user_id").alias("session_id")).agg(
        F.max("ts").alias("created_at"), F.max_by("proxy_id", F.struct("ts", "attempt_id")).alias("proxy_id")
    )
    s = s.withColumn("duration_s", F.col("session_id") % 4 * 86400)
    p = a.select("proxy_id", F.when(F.col("user_id") % 3 != 0, "active").otherwise("blocked").alias("status")).distinct()
    return R.sticky_sessions(s, p, tables.as_of()).select("session_id", "proxy_id")


@query(
    "x32_exhausted",
    Q.with_attempts(
        f"""SELECT request_id, count(*) AS attempts, max_by(status <> 'success', (ts, attempt_id)) AND count(*) > {MAX_RETRIES} AS exhausted
FROM attempts GROUP BY request_id"""
    ),
)
def x32_exhausted(spark, sf_dir):
    """Requests whose last allowed attempt failed too."""
    a = tables.attempts(spark, sf_dir)
    gaps = R.retry_gaps(a).join(a.select("attempt_id", (F.col("status") != "success").alias("failed")), "attempt_id")
    return RC.exhausted_requests(gaps, MAX_RETRIES)


@query(
    "x36_redirected",
    """SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) <> url AS redirected FROM pages""",
)
def x36_redirected(spark, sf_dir):
    """The final URL (the page's without query and fragment) is another one."""
    p = tables.pages(spark, sf_dir)
    final = F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    return p.withColumn("final_url", final).select("page_id", RC.redirected().alias("redirected"))
