"""Registered queries over the stored-result table (S1, P, F, L, X3, K3, K4, W6, W10)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagelake.operators import store as ST
from pagelake.plans import sqlfrag as Q
from pagelake.plans.registry import query
from pagelake.sources import tables

SUMMARY = "id, url, domain, method_used, status, timestamp, title"


def _results(spark, sf_dir):
    return tables.scrape_results(spark, sf_dir)


def _summary(df):
    return df.select(*[c.strip() for c in SUMMARY.split(",")])


@query(
    "s1_results_scan",
    Q.with_results(
        """SELECT id, url, domain, method_used, status, CAST(status_code AS BIGINT) AS status_code, response_time,
       timestamp, title, CAST(content_length AS BIGINT) AS content_length, CAST(links_count AS BIGINT) AS links_count,
       CAST(images_count AS BIGINT) AS images_count, data_json, array_to_string(links, '|') AS links,
       error_message, created_at, request_id, proxy_id
FROM scrape_results"""
    ),
)
def s1_scan(spark, sf_dir):
    """S1 + K2: the full stored-result table (one row per attempt)."""
    r = _results(spark, sf_dir)
    return r.withColumn("links", F.array_join("links", "|")).drop("images")


@query(
    "p1_list_all",
    Q.with_results(f"SELECT {SUMMARY} FROM scrape_results ORDER BY timestamp DESC, id DESC LIMIT 50"),
)
def p1_list(spark, sf_dir):
    """P1 + L1: seven summary columns of the 50 newest rows."""
    return ST.list_all(_results(spark, sf_dir), 50)


@query(
    "f1_by_url",
    Q.with_results(f"SELECT {SUMMARY} FROM scrape_results WHERE url = 'blog.tionsh' OR url ILIKE '%blog.tionsh%'"),
)
def f1_url(spark, sf_dir):
    """rows whose URL equals or contains 'blog.tionsh' (newest first)."""
    return _summary(ST.by_url(_results(spark, sf_dir), "blog.tionsh"))


@query(
    "f2_by_domain",
    Q.with_results(
        f"SELECT {SUMMARY} FROM scrape_results WHERE domain ILIKE '%example.net%' ORDER BY timestamp DESC, id DESC LIMIT 100"
    ),
)
def f2_domain(spark, sf_dir):
    """F2 + L1: newest 100 rows of domains containing 'example.net'."""
    return _summary(ST.by_domain(_results(spark, sf_dir), "example.net", 100))


@query(
    "f3_recent",
    Q.with_results(
        f"SELECT {SUMMARY} FROM scrape_results WHERE timestamp >= {Q.AS_OF_SQL} - INTERVAL 24 HOUR"
    ),
)
def f3_recent(spark, sf_dir):
    """rows of the last 24 hours before the as-of time (2024-01-31)."""
    return _summary(ST.recent(_results(spark, sf_dir), tables.as_of(), 24))


@query(
    "f4_l2_list_page",
    Q.with_results(
        f"""SELECT {SUMMARY} FROM scrape_results WHERE status = 'failed' AND domain ILIKE '%example%'
ORDER BY timestamp DESC, id DESC LIMIT 20 OFFSET 40"""
    ),
)
def f4_page(spark, sf_dir):
    """F4 + L2: third page of 20 failed rows on domains containing 'example'."""
    return _summary(ST.list_page(_results(spark, sf_dir), limit=20, offset=40, status="failed", domain="example"))


@query(
    "l2_keyset_page",
    Q.with_results(
        f"""SELECT {SUMMARY} FROM scrape_results
WHERE timestamp < TIMESTAMP '2024-01-15 00:00:00' ORDER BY timestamp DESC, id DESC LIMIT 25"""
    ),
)
def l2_keyset(spark, sf_dir):
    """L2 deep paging: 25 rows older than the (2024-01-15, any id) cursor."""
    return _summary(ST.keyset_page(_results(spark, sf_dir), "2024-01-15 00:00:00", -1, 25))


def _purchase_ids(spark, sf_dir):
    ev = tables.events(spark, sf_dir)
    return ev.where((F.col("event_type") == "purchase") & (F.col("value") > 40)).select(F.col("event_id").alias("id"))


@query(
    "f5_by_ids",
    Q.with_results(
        f"""SELECT {SUMMARY} FROM scrape_results
WHERE id IN (SELECT event_id FROM events WHERE event_type = 'purchase' AND value > 40)"""
    ),
)
def f5_ids(spark, sf_dir):
    """F5 (bulk): rows whose id is in an id set derived from events (semi join)."""
    return _summary(ST.by_ids(_results(spark, sf_dir), _purchase_ids(spark, sf_dir)))


@query(
    "k4_delete_ids",
    Q.with_results(
        """SELECT status, count(*) AS remaining FROM scrape_results
WHERE id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase' AND value > 40) GROUP BY status"""
    ),
)
def k4_delete(spark, sf_dir):
    """K4 (bulk): rows left after deleting an id set (anti join), by status."""
    left = ST.delete_ids(_results(spark, sf_dir), _purchase_ids(spark, sf_dir))
    return left.groupBy("status").agg(F.count(F.lit(1)).alias("remaining"))


@query(
    "f6_failures",
    Q.with_results(
        "SELECT url, error_message AS error, CAST(status_code AS BIGINT) AS status_code FROM scrape_results WHERE status <> 'success'"
    ),
)
def f6_failures(spark, sf_dir):
    """the failure branch (url, error, status_code)."""
    _, bad = ST.split_outcomes(_results(spark, sf_dir))
    return bad


@query(
    "f8_json_field",
    Q.with_results(
        """SELECT id, title FROM scrape_results
WHERE json_extract_string(data_json, '$.title') = (SELECT min(title) FROM scrape_results)
ORDER BY timestamp DESC, id DESC LIMIT 100"""
    ),
)
def f8_json(spark, sf_dir):
    """F8: rows whose JSON data has title = the smallest stored title; newest 100."""
    r = _results(spark, sf_dir)
    target = r.agg(F.min("title").alias("_t"))
    v = F.get_json_object(F.col("data_json"), "$.title")
    hit = r.crossJoin(F.broadcast(target)).where(v == F.col("_t"))
    return hit.orderBy(*ST.newest_first()).limit(100).select("id", "title")


@query(
    "x3_search",
    Q.with_results(
        """SELECT id, title, url, relevance_score FROM (
  SELECT *, (CASE WHEN contains(lower(coalesce(title, '')), 'the') THEN 10 ELSE 0 END
           + CASE WHEN contains(lower(coalesce(url, '')), 'the') THEN 5 ELSE 0 END
           + CASE WHEN contains(lower(coalesce(data_json, '')), 'the') THEN 1 ELSE 0 END) AS relevance_score
  FROM scrape_results WHERE title ILIKE '%the%' OR data_json ILIKE '%the%' OR url ILIKE '%the%'
  ORDER BY timestamp DESC, id DESC LIMIT 50)"""
    ),
)
def x3_search(spark, sf_dir):
    """X3 + L4: search 'the' in title / data / URL, newest 50, re-ranked by relevance."""
    return ST.search(_results(spark, sf_dir), "the", 50).select("id", "title", "url", "relevance_score")


@query(
    "x3_search_ranked",
    Q.with_results(
        """SELECT id, title, url, relevance_score FROM (
  SELECT *, (CASE WHEN contains(lower(coalesce(title, '')), 'ción') THEN 10 ELSE 0 END
           + CASE WHEN contains(lower(coalesce(url, '')), 'ción') THEN 5 ELSE 0 END
           + CASE WHEN contains(lower(coalesce(data_json, '')), 'ción') THEN 1 ELSE 0 END) AS relevance_score
  FROM scrape_results WHERE title ILIKE '%ción%' OR data_json ILIKE '%ción%' OR url ILIKE '%ción%')
ORDER BY relevance_score DESC, timestamp DESC, id DESC LIMIT 50"""
    ),
)
def x3_ranked(spark, sf_dir):
    """X3 with rank_before_limit: non-ASCII term 'ción' over decoded text (Q3 fixed)."""
    return ST.search(_results(spark, sf_dir), "ción", 50, rank_before_limit=True).select(
        "id", "title", "url", "relevance_score"
    )


@query(
    "x3c_highlight",
    Q.with_results("SELECT id, replace(title, 'the', '**the**') AS title_highlighted FROM scrape_results WHERE title IS NOT NULL"),
)
def x3c_highlight(spark, sf_dir):
    """Literal, case-sensitive highlight of 'the' in stored titles."""
    r = _results(spark, sf_dir).where(F.col("title").isNotNull())
    return ST.highlight_titles(r, "the").select("id", "title_highlighted")


@query(
    "k3_cleanup",
    Q.with_results(
        f"""SELECT count(*) FILTER (WHERE timestamp < {Q.AS_OF_SQL} - INTERVAL 7 DAY) AS deleted,
       count(*) FILTER (WHERE timestamp >= {Q.AS_OF_SQL} - INTERVAL 7 DAY) AS kept FROM scrape_results"""
    ),
)
def k3_cleanup(spark, sf_dir):
    """K3: rows deleted / kept when expiring rows older than 7 days before as-of."""
    r = _results(spark, sf_dir)
    kept, cutoff = ST.keep_after(r, tables.as_of(), 7)
    return r.agg(
        F.count_if(F.col("timestamp") < cutoff).alias("deleted"),
        F.count_if(F.col("timestamp") >= cutoff).alias("kept"),
    )


@query(
    "k3_expired_store",
    Q.with_results(f"""SELECT id, CAST(timestamp AS DATE) AS date FROM scrape_results WHERE timestamp >= {Q.AS_OF_SQL} - INTERVAL 7 DAY"""),
)
def k3_expired_store(spark, sf_dir):
    """K1 + K3: append all results to a day-partitioned store, expire it, and read back what is left."""
    from pagelake.session import checkpoint_dir
    from pagelake.sinks import writers as K

    path = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    K.append_results(_results(spark, sf_dir), path)
    K.expire(spark, path, tables.as_of(), 7)
    return tables.stored_results(spark, path).select("id", "date")


@query(
    "w6_latest_per_url",
    Q.with_results(
        """SELECT url, id, timestamp, status FROM scrape_results
QUALIFY row_number() OVER (PARTITION BY url ORDER BY timestamp DESC, id DESC) = 1"""
    ),
)
def w6_latest(spark, sf_dir):
    """Latest stored row per URL."""
    r = _results(spark, sf_dir).select("url", "id", "timestamp", "status")
    return ST.latest_per_key_agg(r, "url", "timestamp", "id")


@query(
    "w6_latest_per_url_agg",
    Q.with_results(
        """SELECT url, id, timestamp, status FROM scrape_results
QUALIFY row_number() OVER (PARTITION BY url ORDER BY timestamp DESC, id DESC) = 1"""
    ),
)
def w6_latest_agg(spark, sf_dir):
    """W6, skew-safe form (max_by with partial aggregation)."""
    r = _results(spark, sf_dir).select("url", "id", "timestamp", "status")
    return ST.latest_per_key_agg(r, "url", "timestamp", "id").select("url", "id", "timestamp", "status")


@query(
    "w10_numbered",
    Q.with_results("SELECT id, row_number() OVER (ORDER BY timestamp DESC, id DESC) AS number FROM scrape_results"),
)
def w10_numbered(spark, sf_dir):
    """1-based result number, newest first (no single-task window)."""
    r = _results(spark, sf_dir).select("id", "timestamp")
    return ST.numbered(r, ST.newest_first()).select("id", "number")
