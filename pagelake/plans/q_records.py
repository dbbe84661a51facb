"""Registered records and exports read back (P2, P6, J12 fields, H23, K6, K8, K9, W15, X9, F7)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagelake.functions import html as H
from pagelake.functions import scoring as S
from pagelake.operators import articles
from pagelake.operators import extract as X
from pagelake.operators import reliability as R
from pagelake.operators import stats as A
from pagelake.operators import store as ST
from pagelake.plans import q_reliability
from pagelake.plans import sqlfrag as Q
from pagelake.plans.registry import query
from pagelake.session import checkpoint_dir
from pagelake.sinks import writers as K
from pagelake.sources import tables

# Preferred countries of the server choice, error classes and messages by turn.
PREFERRED = ["GERMANY", "JAPAN", "BRAZIL"]
ERROR_TYPES = [None, "TimeoutError", "RateLimitError", "NetworkError"]
ERROR_MESSAGES = [None, "Connection TIMEOUT after 30 s", "Request Blocked by firewall", "403 Forbidden", "connection reset", "timeout: blocked"]
OTHER_CODES = [200, 204, 302, 429, 403, 500]


def _results(spark, sf_dir):
    return tables.scrape_results(spark, sf_dir)


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --------------------------------------------------------------------------
# Article pages derived from the documents
# --------------------------------------------------------------------------


def _escaped(c):
    for plain, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(ref))
    return c


def article_pages(spark, sf_dir):
    """Stand-in: every document as an article page, a paragraph a line."""
    d = tables.read(spark, sf_dir, "documents")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: H.strip(x) != "")
    paragraphs = F.transform(lines, lambda x: F.concat(F.lit("<p>"), _escaped(x), F.lit("</p>")))
    related = F.concat_ws(
        "", *[F.concat(F.lit('<li><a href="/doc/'), (F.col("doc_id") + i).cast("string"), F.lit('">Document '), (F.col("doc_id") + i).cast("string"), F.lit("</a></li>")) for i in (1, 2)]
    )
    html = F.concat(
        F.lit('<html><head><title>x</title></head><body><nav><a href="/">home</a></nav><h1 class="big article-title">Document '),
        F.col("doc_id").cast("string"),
        F.lit('</h1><p>By <span class="author-name">'),
        _escaped(F.coalesce("source", F.lit("unknown"))),
        F.lit('</span> <time datetime="2024">Day '),
        (F.col("doc_id") % 30 + 1).cast("string"),
        F.lit('</time></p><div class="article-content">'),
        F.array_join(paragraphs, ""),
        F.lit('</div><div class="article-tags"><a>'),
        _escaped(F.coalesce("lang", F.lit("none"))),
        F.lit("</a><a>group "),
        (F.col("doc_id") % 7).cast("string"),
        F.lit('</a></div><ul class="related-articles">'),
        related,
        F.lit("</ul><footer><p>about</p></footer></body></html>"),
    )
    return d.select(F.col("doc_id").alias("page_id"), F.lit("https://news.example/").alias("url"), html.alias("html"))


LINES_SQL = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {Q.strip('x')}), lambda x: x <> '')"


@query(
    "p6_article_record",
    f"""WITH a AS (SELECT doc_id, source, lang, array_to_string({LINES_SQL}, ' ') AS content FROM documents)
SELECT doc_id AS page_id, 'Document ' || doc_id AS headline, coalesce(source, 'unknown') AS author, 'Day ' || (doc_id % 30 + 1) AS date, content,
       coalesce(lang, 'none') || '|group ' || (doc_id % 7) AS tags, {Q.word_count('content')} AS word_count,
       'Document ' || (doc_id + 1) || '|Document ' || (doc_id + 2) AS related
FROM a""",
)
def p6_articles(spark, sf_dir):
    """Headline, author, date, joined content, tags, word count and related links of every article page."""
    r = articles.article_records(article_pages(spark, sf_dir))
    listed = {c: F.array_join(c, "|").alias(c) for c in ("tags", "related")}
    return r.select("page_id", "headline", "author", "date", "content", listed["tags"], "word_count", listed["related"])


# --------------------------------------------------------------------------
# Exports, written and read back
# --------------------------------------------------------------------------


def _sheet(spark, sf_dir, name, schema):
    path = _folder(spark, "workbook")
    K.write_workbook(_results(spark, sf_dir), path)
    return spark.read.schema(schema).options(**K.CSV_OPTIONS).csv(f"{path}/{name}")


@query(
    "k8_workbook_main",
    Q.with_results(
        """SELECT id, url, nullif(coalesce(title, ''), '') AS title, timestamp, response_time, method_used AS method
FROM scrape_results WHERE status = 'success'"""
    ),
)
def k8_main(spark, sf_dir):
    """K8: the Main sheet, written with the others and read back (an empty title reads as NULL)."""
    return _sheet(spark, sf_dir, "main", "id long, url string, title string, timestamp timestamp_ntz, response_time double, method string")


@query(
    "k8_workbook_summary",
    Q.with_results(
        """SELECT count(*) AS total_results, count(*) FILTER (WHERE status = 'success') AS successful, count(*) FILTER (WHERE status <> 'success') AS failed,
       CAST(sum(links_count) AS BIGINT) AS total_links, CAST(sum(images_count) AS BIGINT) AS total_images FROM scrape_results"""
    ),
)
def k8_summary(spark, sf_dir):
    """K8: the Summary sheet, written with the others and read back."""
    return _sheet(spark, sf_dir, "summary", "total_results long, successful long, failed long, total_links long, total_images long")


@query(
    "k9_xml_export",
    Q.with_results(
        """SELECT url, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, title, array_to_string(json_extract_string(data_json, '$.headings[*]'), '|') AS headings
FROM scrape_results WHERE status = 'success'"""
    ),
)
def k9_xml(spark, sf_dir):
    """K9: url, timestamp and the data elements of every success, written as XML and read back."""
    path = _folder(spark, "xml")
    K.export_xml(_results(spark, sf_dir), path)
    schema = "url string, timestamp string, data struct<title: string, headings: struct<item: array<string>>>"
    back = spark.read.format("xml").option("rowTag", K.XML_ROW_TAG).schema(schema).load(path)
    items = F.coalesce(F.col("data.headings.item"), F.array().cast("array<string>"))
    return back.select("url", "timestamp", F.col("data.title").alias("title"), F.array_join(items, "|").alias("headings"))


@query(
    "k6_json_export",
    Q.with_results("""SELECT id, url, status, json_extract_string(data_json, '$.title') AS title, len(json_keys(data_json)) AS n_fields FROM scrape_results"""),
)
def k6_json(spark, sf_dir):
    """K6: results as JSON lines with the data as an object, read back."""
    path = _folder(spark, "json")
    K.export_json(_results(spark, sf_dir), path)
    lines = spark.read.text(path)
    field = lambda name: F.get_json_object("value", f"$.{name}")
    return lines.select(
        field("id").cast("long").alias("id"), field("url").alias("url"), field("status").alias("status"), field("data.title").alias("title"),
        F.size(F.json_object_keys(field("data"))).alias("n_fields"),
    )


PARTS = ["id", "url", "domain", "method_used", "status", "status_code", "response_time", "timestamp", "title", "content_length", "links_count",
         "images_count", "links", "images", "error_message", "created_at", "request_id", "proxy_id"]


@query(
    "p2_record_json",
    Q.with_results(
        f"""SELECT id, url, title, error_message, {' + '.join(f'(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)' for c in PARTS)} AS n_fields,
       json_extract_string(data_json, '$.title') AS data_title FROM scrape_results"""
    ),
)
def p2_records(spark, sf_dir):
    """P2 + P8: every row as a JSON record without nulls, and its parsed data."""
    r = ST.to_record(_results(spark, sf_dir))
    field = lambda name: F.get_json_object("record_json", f"$.{name}").alias(name)
    return r.select(
        field("id").cast("long").alias("id"), field("url"), field("title"), field("error_message"),
        F.size(F.json_object_keys("record_json")).alias("n_fields"),
        F.try_variant_get("data", "$.title", "string").alias("data_title"),
    )


# --------------------------------------------------------------------------
# H23, J12, W15, X9, F7
# --------------------------------------------------------------------------


@query(
    "h23_json_bodies",
    """SELECT event_id AS body_id, true AS is_json, len(json_keys(props)) AS json_fields, length(props) AS data_size, NULL AS body_preview FROM events
UNION ALL SELECT -1 - doc_id, false, NULL, length(substr(text, 1, 200)), substr(text, 1, 200) FROM documents WHERE text IS NOT NULL""",
)
def h23_bodies(spark, sf_dir):
    """Fields, size and preview of bodies, JSON (event properties) and plain (documents)."""
    js = tables.events(spark, sf_dir).select(F.col("event_id").alias("body_id"), F.col("props").alias("html"))
    plain = tables.read(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select((-1 - F.col("doc_id")).alias("body_id"), F.col("text").alias("html"))
    return X.body_probe(js.unionByName(plain), "body_id")


@query(
    "j12_dynamic_flag",
    Q.with_results(
        f"""SELECT s.url, coalesce(max(CASE WHEN s.rn = 1 AND s.status = 'success' AND d.dynamic THEN 1 ELSE 0 END), 0) = 1 AS has_dynamic_content
FROM (SELECT url, status, method_used, row_number() OVER (PARTITION BY url, method_used ORDER BY timestamp DESC, id DESC)
             + CASE WHEN method_used = 'playwright' THEN 0 ELSE 9 END AS rn FROM scrape_results) s
JOIN (SELECT url, bool_or({Q.contains_any('lower(html)', H.DYNAMIC_KEYWORDS)}) AS dynamic FROM pages GROUP BY url) d ON d.url = s.url
GROUP BY s.url"""
    ),
)
def j12_dynamic(spark, sf_dir):
    """Per URL, whether the rendering method's latest result succeeded on a dynamic page."""
    r = _results(spark, sf_dir).where(F.col("method_used") == "playwright")
    last = r.groupBy("url").agg(F.max_by("status", F.struct("timestamp", "id")).alias("status"))
    p = tables.pages(spark, sf_dir)
    dynamic = p.groupBy("url").agg(F.bool_or(H.dynamic_content(F.col("html"))).alias("dynamic"))
    seen = tables.attempts(spark, sf_dir).select("url").distinct()
    flags = seen.join(dynamic, "url").join(last, "url", "left")
    return flags.select("url", F.coalesce((F.col("status") == "success") & F.col("dynamic"), F.lit(False)).alias("has_dynamic_content"))


@query(
    "w15_preferred_servers",
    "WITH "
    + q_reliability.SERVERS_SQL
    + f"""
SELECT name, country, nullif(list_position({PREFERRED!r}, country), 0) AS preferred_rank,
       row_number() OVER (ORDER BY coalesce(nullif(list_position({PREFERRED!r}, country), 0), {len(PREFERRED) + 1}), load, latency, name) AS overall_rank
FROM servers""",
)
def w15_preferred(spark, sf_dir):
    """Servers by preferred country, then load, latency and name over all."""
    sv = R.servers_from(tables.read(spark, sf_dir, "supplier"), tables.read(spark, sf_dir, "nation"))
    return R.best_servers(sv, PREFERRED).select("name", "country", "preferred_rank", "overall_rank")


def _turn(values, at):
    """``values[at mod len]`` as a column; None stays NULL."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def _turn_sql(values, at) -> str:
    listed = ", ".join("NULL" if v is None else Q.lit(v) if isinstance(v, str) else str(v) for v in values)
    return f"[{listed}][CAST({at} % {len(values)} AS BIGINT) + 1]"


@query(
    "x9_error_classes",
    f"""WITH e AS (SELECT event_id, {_turn_sql(ERROR_TYPES, 'event_id')} AS et, {_turn_sql(OTHER_CODES, 'event_id // 4')} AS sc,
  lower(coalesce({_turn_sql(ERROR_MESSAGES, 'event_id // 24')}, '')) AS msg FROM events)
SELECT event_id, CASE WHEN et = 'TimeoutError' THEN 'timeout' WHEN et = 'RateLimitError' THEN 'rate_limited' WHEN sc = 429 THEN 'rate_limited'
       WHEN sc = 403 THEN 'blocked' WHEN contains(msg, 'timeout') THEN 'timeout' WHEN contains(msg, 'blocked') OR contains(msg, 'forbidden') THEN 'blocked'
       ELSE 'failed' END AS error_status,
       CASE WHEN sc >= 200 AND sc < 300 THEN 'success' WHEN sc >= 400 THEN 'failure' ELSE 'other' END AS status_class FROM e""",
)
def x9_classes(spark, sf_dir):
    """X9 + F7: every error class, code and message (stand-in: by turn over the events), and the class of each code."""
    at = F.col("event_id")
    third = lambda n: F.floor(at / n)
    e = tables.events(spark, sf_dir).select(
        "event_id", _turn(ERROR_TYPES, at).alias("et"), _turn(OTHER_CODES, third(4)).alias("status_code"), _turn(ERROR_MESSAGES, third(24)).alias("msg")
    )
    return A.with_status_class(e).select("event_id", S.error_status("et", "status_code", "msg").alias("error_status"), "status_class")
