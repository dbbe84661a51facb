"""Registered source and export frames.

Each query is the DataFrame a sink writes (the write itself is a plain
``df.write``, tested on scratch folders); comparing the frame is comparing
what would land in the file.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.functions import urls as U
from pagelake.plans import sqlfrag as Q
from pagelake.plans.registry import query
from pagelake.sinks import writers as K
from pagelake.sources import files as S
from pagelake.sources import tables

# Parameters of the registered queries (fixed values).
INVALIDATE_GLOB = "https://blog.*"
SEARCH_CRITERIA = {"title": "The and attion to thanedble the, anea. Eriner thanea.", "meta_description": "none"}
MAX_PAGES = 10
TEMPLATE = "%s | %s | %d links"


def _results(spark, sf_dir):
    return tables.scrape_results(spark, sf_dir)


@query(
    "k5_u1_data_fields",
    Q.with_results(
        """SELECT id, key, json_extract_string(data_json, '$."' || key || '"') AS value
FROM (SELECT id, data_json, unnest(json_keys(data_json)) AS key FROM scrape_results)"""
    ),
)
def k5_fields(spark, sf_dir):
    """Every stored ``data_json`` flattened to (id, key, value) rows;
    nested values stay JSON text."""
    return K.json_fields(_results(spark, sf_dir), "data_json")


@query(
    "k8_workbook_links",
    Q.with_results(
        f"""SELECT id, url, link, CASE WHEN contains(link, {Q.netloc('url')}) THEN 'internal' ELSE 'external' END AS type
FROM (SELECT id, url, unnest(links) AS link FROM scrape_results)"""
    ),
)
def k8_links(spark, sf_dir):
    """K8: the Links sheet of the workbook (one row per stored link)."""
    return K.workbook(_results(spark, sf_dir))["links"]


@query(
    "k10_markdown_report",
    Q.with_results(
        """SELECT number, printf('## %d. %s' || chr(10) || chr(10) || '- URL: %s' || chr(10) || '- Status: %s'
                         || chr(10) || '- Time: %s' || chr(10),
                         number, coalesce(title, '(no title)'), url, status,
                         strftime(timestamp, '%Y-%m-%d %H:%M:%S')) AS markdown
FROM (SELECT *, row_number() OVER (ORDER BY timestamp DESC, id DESC) AS number FROM scrape_results)"""
    ),
)
def k10_markdown(spark, sf_dir):
    """One numbered markdown block per stored result, newest first."""
    return K.markdown_lines(_results(spark, sf_dir))


@query(
    "k11_template_lines",
    Q.with_results(f"SELECT printf('{TEMPLATE}', url, status, links_count) AS line FROM scrape_results"),
)
def k11_template(spark, sf_dir):
    """A user printf-style template filled per stored result."""
    return K.template_lines(_results(spark, sf_dir), TEMPLATE, ["url", "status", "links_count"])


@query(
    "k12_result_files",
    Q.with_results(
        """SELECT id, domain, domain || '_' || strftime(timestamp, '%Y%m%d_%H%M%S') AS file_name,
       CAST(timestamp AS DATE) AS day FROM scrape_results"""
    ),
)
def k12_files(spark, sf_dir):
    """Per-result JSON file name ``domain_YYYYmmdd_HHMMSS`` and its day partition."""
    return K.result_files(_results(spark, sf_dir)).select("id", "domain", "file_name", "day")


CACHE_SQL = f"""cache AS (
  SELECT url, id, timestamp, title, timestamp + INTERVAL {K.CACHE_TTL_S} SECOND AS expires_at
  FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY timestamp DESC, id DESC) AS rn
        FROM scrape_results WHERE status = 'success') WHERE rn = 1
)"""


@query("k13_cache_entries", Q.with_results(f", {CACHE_SQL}\nSELECT * FROM cache"))
def k13_cache(spark, sf_dir):
    """Latest successful result per URL with its expiry (TTL 3600 s)."""
    return K.cache_entries(_results(spark, sf_dir))


@query(
    "k13_l7_recent_keys",
    Q.with_results(f", {CACHE_SQL}\nSELECT url FROM cache ORDER BY timestamp DESC, url LIMIT {K.RECENT_KEYS}"),
)
def k13_recent(spark, sf_dir):
    """K13 + L7: the 100 most recently cached URLs (a top-k list by design)."""
    return K.recent_keys(K.cache_entries(_results(spark, sf_dir)))


@query(
    "k14_invalidate_glob",
    Q.with_results(
        f", {CACHE_SQL}\nSELECT * FROM cache WHERE NOT regexp_matches(url, {Q.lit(K.glob_to_regex(INVALIDATE_GLOB))})"
    ),
)
def k14_invalidate(spark, sf_dir):
    """Cache entries left after invalidating the keys matching ``https://blog.*``."""
    return K.invalidate(K.cache_entries(_results(spark, sf_dir)), INVALIDATE_GLOB)


@query(
    "k15_messages",
    Q.with_results(
        """SELECT id, type, url, status, timestamp, response_time, links_found, images_found
FROM (SELECT id, 'scrape_result' AS type, url, status, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
             response_time, CAST(links_count AS BIGINT) AS links_found, CAST(images_count AS BIGINT) AS images_found
      FROM scrape_results)"""
    ),
)
def k15_messages(spark, sf_dir):
    """One JSON message per result, read back field by field."""
    m = K.messages(_results(spark, sf_dir))
    schema = (
        "type string, url string, status string, timestamp string, "
        "metrics struct<response_time: double, links_found: bigint, images_found: bigint>"
    )
    parsed = m.select("id", F.from_json("message", schema).alias("m"))
    return parsed.select("id", "m.type", "m.url", "m.status", "m.timestamp", "m.metrics.*")


def _search_sql() -> str:
    conds = []
    for k, v in SEARCH_CRITERIA.items():
        conds.append(
            f"(NOT list_contains(json_keys(data_json), {Q.lit(k)}) "
            f"OR json_extract_string(data_json, '$.{k}') = {Q.lit(v)})"
        )
    return Q.with_results(f"SELECT id, url, status, title FROM scrape_results WHERE {' AND '.join(conds)}")


@query("s4_json_search", _search_sql())
def s4_search(spark, sf_dir):
    """Stored results whose data matches every criterion; a missing key passes."""
    r = _results(spark, sf_dir)
    return S.search_json(r, "data_json", SEARCH_CRITERIA).select("id", "url", "status", "title")


@query(
    "s9_seed_requests",
    f"""WITH seeds AS (SELECT DISTINCT regexp_replace(link, '#.*$', '') AS url
               FROM (SELECT unnest({Q.links('html', 'url')}) AS link FROM pages))
SELECT s.url, p.page_id, CASE WHEN p.page_id IS NULL THEN 'pending' ELSE 'fetched' END AS state
FROM seeds s LEFT JOIN pages p ON p.url = s.url""",
)
def s9_seeds(spark, sf_dir):
    """S9 + J1: every linked URL as a seed request, matched to a fetched page."""
    from pagelake.operators import extract as X

    p = tables.pages(spark, sf_dir)
    links = X.extract_record(p, level="basic").select(F.explode("links").alias("link"))
    seeds = links.select(U.drop_fragment(F.col("link")).alias("url")).distinct()
    return S.seed_requests(seeds, p)


@query(
    "s10_paged_urls",
    f"""SELECT page_id, n AS page, url || '?page=' || CAST(n AS VARCHAR) AS paged_url
FROM pages, (SELECT unnest(range(1, {MAX_PAGES} + 1)) AS n)""",
)
def s10_paged(spark, sf_dir):
    """``base?page=N`` for N = 1..10 for every page URL."""
    return S.paged_urls(tables.pages(spark, sf_dir), MAX_PAGES)
