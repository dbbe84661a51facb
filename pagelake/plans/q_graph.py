"""Registered crawl-graph queries (G1–G5) over the whole ``pages`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.functions import urls as U
from pagelake.operators import extract as X
from pagelake.operators import graph as G
from pagelake.plans import sqlfrag as Q
from pagelake.plans.registry import query
from pagelake.sources import tables

MAX_DEPTH = 3
# Rows per salted bucket in the G5 query; small so that the heavy domains of
# the test tables are split.
BUCKET_ROWS = 8


def _edges(spark, sf_dir):
    return G.url_edges(X.extract_record(tables.pages(spark, sf_dir), level="basic"))


EDGES_SQL = f"""edges AS (
  SELECT DISTINCT src, dst FROM (
    SELECT url AS src, regexp_replace(link, '#.*$', '') AS dst
    FROM (SELECT url, unnest({Q.links('html', 'url')}) AS link FROM pages))
  WHERE dst <> ''
)"""


def _url_key_sql(u: str) -> str:
    host = f"regexp_replace(lower({Q.netloc(u)}), '^www\\.', '')"
    path = (
        f"regexp_replace(regexp_extract({u}, {Q.lit(r'^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)')}, 1), '/+$', '')"
    )
    q = (
        f"array_to_string(list_filter(string_split(regexp_extract({u}, {Q.lit(r'\?([^#]*)')}, 1), '&'), "
        f"lambda p: p <> '' AND NOT starts_with(p, '{G.TRACKING_PREFIX}')), '&')"
    )
    return f"({host} || {path} || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END)"


def _pagerank_sql(damping: float, rounds: int) -> str:
    steps = [
        "nodes AS MATERIALIZED (SELECT src AS url FROM edges UNION SELECT dst FROM edges)",
        "nn AS MATERIALIZED (SELECT count(*) AS n_nodes FROM nodes)",
        "od AS MATERIALIZED (SELECT src AS url, count(*) AS out_deg FROM edges GROUP BY src)",
        "st AS MATERIALIZED (SELECT nodes.url, coalesce(od.out_deg, 0) AS out_deg, nn.n_nodes "
        "FROM nodes LEFT JOIN od ON nodes.url = od.url CROSS JOIN nn)",
        "r0 AS MATERIALIZED (SELECT url, out_deg, n_nodes, 1.0::DOUBLE / n_nodes AS rank FROM st)",
    ]
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        steps.append(
            f"""r{i} AS MATERIALIZED (
  SELECT s.url, s.out_deg, s.n_nodes,
         {1.0 - damping!r}::DOUBLE / s.n_nodes + {damping!r}::DOUBLE * (coalesce(c.contrib, 0.0) + d.dangling / s.n_nodes) AS rank
  FROM {p} s
  LEFT JOIN (SELECT e.dst AS url, sum(x.rank / x.out_deg) AS contrib
             FROM {p} x JOIN edges e ON e.src = x.url WHERE x.out_deg > 0 GROUP BY e.dst) c ON c.url = s.url
  CROSS JOIN (SELECT coalesce(sum(rank), 0.0) AS dangling FROM {p} WHERE out_deg = 0) d)"""
        )
    return "WITH " + EDGES_SQL + ",\n" + ",\n".join(steps) + f"\nSELECT url, round(rank * n_nodes, 6) AS score FROM r{rounds}"


@query(
    "g1_crawl_frontier",
    f"""WITH RECURSIVE {EDGES_SQL},
bfs(url, depth) AS (
  SELECT url, 0 FROM pages
  UNION
  SELECT e.dst, b.depth + 1 FROM bfs b JOIN edges e ON e.src = b.url WHERE b.depth < {MAX_DEPTH}
)
SELECT url, CAST(min(depth) AS BIGINT) AS depth FROM bfs GROUP BY url""",
)
def g1_frontier(spark, sf_dir):
    """G1: breadth-first depth of every URL reachable from the fetched pages (depth ≤ 3)."""
    seeds = tables.pages(spark, sf_dir).select("url")
    return G.crawl_frontier(_edges(spark, sf_dir), seeds, MAX_DEPTH)


@query(
    "g2_in_degree",
    f"WITH {EDGES_SQL}\nSELECT dst AS url, count(*) AS in_degree FROM edges GROUP BY dst",
)
def g2_in_degree(spark, sf_dir):
    """In-degree priority of every linked URL."""
    return G.in_degree(_edges(spark, sf_dir))


@query("g3_pagerank", _pagerank_sql(G.DAMPING, G.ROUNDS))
def g3_pagerank(spark, sf_dir):
    """PageRank (10 rounds, damping 0.85) as a score scaled by the node count."""
    pr = G.pagerank(_edges(spark, sf_dir))
    return pr.select("url", F.round(F.col("rank") * F.col("n_nodes"), 6).alias("score"))


@query(
    "g4_duplicate_urls",
    f"""SELECT page_id, url, url_key, first_id, copies, page_id <> first_id AS is_duplicate
FROM (SELECT page_id, url, url_key, min(page_id) OVER (PARTITION BY url_key) AS first_id,
             count(*) OVER (PARTITION BY url_key) AS copies
      FROM (SELECT page_id, url, {_url_key_sql('url')} AS url_key FROM pages))""",
)
def g4_duplicates(spark, sf_dir):
    """Exact duplicate-URL detection on a normalised URL key."""
    return G.duplicate_urls(tables.pages(spark, sf_dir))


@query(
    "g5_domain_buckets",
    f"""SELECT domain, salt, domain_rows, buckets, count(*) AS rows
FROM (SELECT domain, domain_rows, buckets, page_id % buckets AS salt
      FROM (SELECT domain, page_id, count(*) OVER (PARTITION BY domain) AS domain_rows,
                   CAST(greatest(1, ceil(count(*) OVER (PARTITION BY domain) / {BUCKET_ROWS})) AS BIGINT) AS buckets
            FROM (SELECT page_id, {Q.netloc('url')} AS domain FROM pages)))
GROUP BY domain, salt, domain_rows, buckets""",
)
def g5_buckets(spark, sf_dir):
    """Pages partitioned by domain with heavy domains salted into buckets."""
    p = tables.pages(spark, sf_dir).select("page_id", U.netloc(F.col("url")).alias("domain"))
    salted = G.salted_by_domain(p, BUCKET_ROWS)
    return salted.groupBy("domain", "salt", "domain_rows", "buckets").agg(F.count(F.lit(1)).alias("rows"))
