"""Registered page-size, attempt-log and request queries (H15, H21, H22, X12,
X20, X23, X38, A31, A32, J10, J13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.functions import html as H
from pagelake.functions import scoring as S
from pagelake.functions import text as T
from pagelake.operators import reliability as R
from pagelake.operators import stats as A
from pagelake.plans import sqlfrag as Q
from pagelake.plans.registry import QUERIES, query
from pagelake.sinks import writers as K
from pagelake.sources import tables

# Methods taken as available in the A32 batch (fixed value of the query).
AVAILABLE_METHODS = ["scrapy", "pydoll"]


def _attempts(spark, sf_dir):
    return tables.attempts(spark, sf_dir)


@query(
    "h15_h21_h22_page_sizes",
    f"""SELECT page_id,
       len(list_filter(regexp_extract_all(html, {Q.lit(H.LINK_RE)}, 1),
           lambda x: starts_with(x, 'http://') OR starts_with(x, 'https://') OR starts_with(x, '/'))) AS links_all,
       len({Q.links('html', 'url')}) AS links_distinct,
       strlen(html) AS download_size, length(substring(html, 1, {H.MAX_HTML_CHARS})) AS capped_length
FROM pages""",
)
def h15_sizes(spark, sf_dir):
    """H15 + H21 + H22: links undeduped and deduped, bytes, and the capped HTML length per page."""
    p = tables.pages(spark, sf_dir)
    html, url = F.col("html"), F.col("url")
    return p.select(
        "page_id",
        F.size(H.links(html, url, distinct=False)).alias("links_all"),
        F.size(H.links(html, url)).alias("links_distinct"),
        H.download_size(html).alias("download_size"),
        F.length(H.capped_html(html)).alias("capped_length"),
    )


@query(
    "x23_x24_issue_lists",
    Q.with_attempts(
        f"""SELECT attempt_id, array_to_string(list_filter([
         CASE WHEN status_code <> 200 THEN 'HTTP ' || CAST(status_code AS VARCHAR) || ' error' END,
         CASE WHEN response_time > 3.0 THEN {Q.lit(S.ISSUE_VERY_SLOW)} WHEN response_time > 1.0 THEN {Q.lit(S.ISSUE_SLOW)} END],
         lambda x: x IS NOT NULL), '|') AS issues,
       len(CASE WHEN status_code <> 200 THEN [{Q.lit(S.REC_SERVER)}] ELSE [] END
           || CASE WHEN response_time > 1.0 THEN [{', '.join(Q.lit(r) for r in S.REC_SLOW)}] ELSE [] END) AS n_recommendations
FROM attempts"""
    ),
)
def x23_issues(spark, sf_dir):
    """X23 + X24: issue strings and the number of recommendations for every attempt."""
    a = _attempts(spark, sf_dir)
    sc, rt = F.col("status_code"), F.col("response_time")
    return a.select(
        "attempt_id",
        F.array_join(S.issues(sc, rt), "|").alias("issues"),
        F.size(S.recommendations(sc, rt)).alias("n_recommendations"),
    )


@query(
    "x38_step_durations",
    Q.with_attempts(
        "SELECT request_id, round(sum(response_time), 6) AS total_duration, count(*) AS steps FROM attempts GROUP BY request_id"
    ),
)
def x38_steps(spark, sf_dir):
    """Total and count of step durations per request (stand-in: a request's attempts are its steps)."""
    steps = _attempts(spark, sf_dir).select("request_id", F.col("response_time").alias("duration"))
    s = A.step_durations(steps)
    return s.select("request_id", F.round("total_duration", 6).alias("total_duration"), "steps")


@query(
    "a31_check_summary",
    Q.with_attempts(
        """SELECT count(*) AS checks, count(*) FILTER (WHERE status = 'success') AS successes,
       count(DISTINCT method) > 1 AS agents_vary, max(response_time) - min(response_time) AS timing_variation
FROM attempts"""
    ),
)
def a31_summary(spark, sf_dir):
    """Checks, successes, whether the agents vary, and the timing spread (agent = method)."""
    a = _attempts(spark, sf_dir).select(
        (F.col("status") == "success").alias("ok"), F.col("method").alias("agent"), "response_time"
    )
    return A.ip_check_summary(a)


def _a32_sql() -> str:
    avail = ", ".join(Q.lit(m) for m in AVAILABLE_METHODS)
    return f"""SELECT r.request_id, r.method,
       CASE WHEN r.method IN ({avail}) THEN o.status ELSE 'failed' END AS status,
       CASE WHEN r.method IN ({avail}) THEN o.error_message ELSE 'MethodUnavailableError' END AS error_type
FROM ({Q.with_attempts("SELECT request_id, arg_min(method, attempt_id) AS method FROM attempts GROUP BY request_id")}) r
LEFT JOIN ({QUERIES["w7_first_success"].sql}) o ON o.request_id = r.request_id"""


@query("a32_batch_outcome", _a32_sql())
def a32_outcome(spark, sf_dir):
    """One row per request of the batch; requests whose method is not
    available get a MethodUnavailableError row, the rest keep their outcome (W7)."""
    a = _attempts(spark, sf_dir)
    requests = a.groupBy("request_id").agg(F.min_by("method", "attempt_id").alias("method"))
    outcome = R.first_success(a).select("request_id", "status", F.col("error_message").alias("error_type"))
    return R.batch_outcome(requests, outcome, AVAILABLE_METHODS)


def _caps_sql() -> str:
    rows = ", ".join(f"({Q.lit(m)}, {js}, {ck}, {sc}, {fm}, {sp})" for m, js, ck, sc, fm, sp in R.CAPABILITIES)
    return Q.with_attempts(
        f"""SELECT a.method, a.attempts, a.successes, c.javascript, c.screenshots, CAST(c.speed_rank AS BIGINT) AS speed_rank
FROM (SELECT method, count(*) AS attempts, count(*) FILTER (WHERE status = 'success') AS successes FROM attempts GROUP BY method) a
JOIN (VALUES {rows}) c(method, javascript, cookies, screenshots, forms, speed_rank) ON c.method = a.method"""
    )


@query("j13_method_capabilities", _caps_sql())
def j13_caps(spark, sf_dir):
    """Attempts and successes per method joined with the fixed capability flags (3-row broadcast)."""
    a = _attempts(spark, sf_dir).groupBy("method").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("status") == "success").alias("successes")
    )
    caps = F.broadcast(R.capability_table(spark))
    return a.join(caps, "method").select("method", "attempts", "successes", "javascript", "screenshots", "speed_rank")


@query(
    "x12_simple_price",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       coalesce(TRY_CAST(replace(coalesce(t, '0'), '$', '') AS DOUBLE), 0.0) AS price
FROM (SELECT l_orderkey, l_linenumber, '$' || CAST(round(l_extendedprice / l_quantity) AS BIGINT) AS t FROM lineitem)""",
)
def x12_price(spark, sf_dir):
    """Strip '$' and read a double (default 0) on whole-dollar price texts."""
    li = tables.read(spark, sf_dir, "lineitem")
    t = F.concat(F.lit("$"), F.round(F.col("l_extendedprice") / F.col("l_quantity")).cast("long").cast("string"))
    return li.select("l_orderkey", "l_linenumber", T.simple_price(t).alias("price"))


@query(
    "j10_cached_requests",
    Q.with_results(
        f""", cache AS (
  SELECT url, timestamp + INTERVAL {K.CACHE_TTL_S} SECOND AS expires_at FROM (
    SELECT url, timestamp, row_number() OVER (PARTITION BY url ORDER BY timestamp DESC, id DESC) AS rn
    FROM scrape_results WHERE status = 'success') WHERE rn = 1)
SELECT attempt_id, url FROM attempts WHERE url IN (SELECT url FROM cache WHERE expires_at > {Q.AS_OF_SQL})"""
    ),
)
def j10_cached(spark, sf_dir):
    """Requests whose URL has a cache entry still valid at as-of (left semi join on the K13 entries)."""
    entries = K.cache_entries(tables.scrape_results(spark, sf_dir))
    return K.unexpired(_attempts(spark, sf_dir).select("attempt_id", "url"), entries, tables.as_of())


@query(
    "x20_extraction_quality",
    f"""SELECT page_id, q AS quality, q > 0.5 AS passed FROM (
  SELECT page_id,
         CASE WHEN coalesce(length(t), 0) > 0 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END
         + CASE WHEN np > 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
         + CASE WHEN nl > 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + 0.1::DOUBLE AS q
  FROM (SELECT page_id, {Q.title('html')} AS t,
               len(list_filter(list_transform(regexp_extract_all(html, {Q.lit(H.PARAGRAPH_RE)}, 1), lambda p: {Q.strip('p')}),
                   lambda p: p <> '')) AS np,
               len({Q.links('html', 'url')}) AS nl FROM pages))""",
)
def x20_quality(spark, sf_dir):
    """Extraction quality per page (title .4 + paragraphs .3 + links .2 + .1) and pass when over 0.5."""
    p = tables.pages(spark, sf_dir)
    html = F.col("html")
    q = S.extraction_quality(H.title(html), F.size(H.paragraphs("html")), F.size(H.links(html, F.col("url"))))
    return p.select("page_id", q.alias("quality"), (q > 0.5).alias("passed"))


@query(
    "j2_proxy_stats",
    Q.with_attempts(
        """SELECT p.proxy_key, coalesce(s.requests, 0) AS requests, coalesce(s.failures, 0) AS failures
FROM (SELECT 'proxy' || CAST(c_custkey AS VARCHAR) || '.example.net:8080:http' AS proxy_key FROM customer) p
LEFT JOIN (SELECT proxy_id || '.example.net:8080:http' AS proxy_key, count(*) AS requests,
                  count(*) FILTER (WHERE status <> 'success') AS failures
           FROM attempts GROUP BY proxy_id) s ON s.proxy_key = p.proxy_key"""
    ),
)
def j2_stats(spark, sf_dir):
    """J2 + X29: every proxy of the pool (stand-in: one per customer) joined to
    its attempt stats by the ``host:port:type`` id; a proxy without stats gets 0."""
    cust = tables.read(spark, sf_dir, "customer")
    proxies = cust.select(
        S.proxy_id(
            F.concat(F.lit("proxy"), F.col("c_custkey").cast("string"), F.lit(".example.net")), F.lit(8080), F.lit("http")
        ).alias("proxy_key")
    )
    a = _attempts(spark, sf_dir)
    stats = a.groupBy(
        S.proxy_id(F.concat(F.col("proxy_id"), F.lit(".example.net")), F.lit(8080), F.lit("http")).alias("proxy_key")
    ).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") != "success").alias("failures"))
    j = proxies.join(stats, "proxy_key", "left")
    return j.select("proxy_key", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("failures", F.lit(0)).alias("failures"))


@query(
    "x7_decoded_links",
    f"""SELECT page_id, count(*) AS links, count(*) FILTER (WHERE url_decode(link) <> link) AS changed,
       sum(length(url_decode(link))) AS decoded_chars
FROM (SELECT page_id, unnest({Q.links('html', 'url')}) AS link FROM pages) GROUP BY page_id""",
)
def x7_links(spark, sf_dir):
    """Every resolved link decoded as ``unquote`` does; per page the link count,
    how many change, and the decoded length."""
    from pagelake.functions import urls as U

    p = tables.pages(spark, sf_dir)
    e = p.select("page_id", F.explode(H.links(F.col("html"), F.col("url"))).alias("link"))
    d = U.url_decode(F.col("link"))
    return e.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("links"),
        F.count_if(d != F.col("link")).alias("changed"),
        F.sum(F.length(d)).alias("decoded_chars"),
    )


_NEEDS = "attempt_id % 2 = 1 AS needs_javascript, attempt_id % 3 = 1 AS needs_cookies, attempt_id % 7 = 3 AS needs_screenshots, attempt_id % 5 = 2 AS needs_forms"


def _able_sql() -> str:
    rows = ", ".join(f"({Q.lit(m)}, {js}, {ck}, {sc}, {fm})" for m, js, ck, sc, fm, _ in R.CAPABILITIES)
    return Q.with_attempts(
        f"""SELECT a.attempt_id, c.method FROM (SELECT attempt_id, {_NEEDS} FROM attempts) a
JOIN (VALUES {rows}) c(method, javascript, cookies, screenshots, forms)
  ON (c.javascript OR NOT a.needs_javascript) AND (c.cookies OR NOT a.needs_cookies)
 AND (c.screenshots OR NOT a.needs_screenshots) AND (c.forms OR NOT a.needs_forms)"""
    )


@query("j13_able_methods", _able_sql())
def j13_able(spark, sf_dir):
    """The methods that can serve each request (stand-in needs by attempt id)."""
    a = _attempts(spark, sf_dir).selectExpr("attempt_id", *_NEEDS.split(", "))
    return R.able_methods(a, spark).select("attempt_id", "method")
