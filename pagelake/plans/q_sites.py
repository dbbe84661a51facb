"""Registered site, product and search queries (P4+U2, F10, F13, F14+J8, J12,
A25, A29, A30, L6, X3b)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.functions import text as T
from pagelake.operators import fulltext as FT
from pagelake.operators import reliability as R
from pagelake.operators import reports as RP
from pagelake.plans import sqlfrag as Q
from pagelake.plans.registry import query
from pagelake.session import checkpoint_dir
from pagelake.sinks import writers as K
from pagelake.sources import tables
from pagelake.sources.tables import METHODS

# The paths probed per site (F14) and the search words.
COMMON_PATHS = ["/", "/about", "/contact", "/blog", "/portfolio", "/projects", "/services", "/sitemap.xml", "/robots.txt"]
SEARCH_WORDS = ["the", "and"]
SEARCH_TOP = 50
DEAL_PRICE = 100.0
ERROR_RATE_ALERT = 0.05
FIRST_LINKS = 5


def _results(spark, sf_dir):
    return tables.scrape_results(spark, sf_dir)


# --------------------------------------------------------------------------
# Products (stand-in: a line item offers its part at the unit price)
# --------------------------------------------------------------------------


def _products(spark, sf_dir):
    li = tables.read(spark, sf_dir, "lineitem")
    part = tables.read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_retailprice"
    )
    j = li.join(part, "l_partkey")
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 2))
    return j.select(
        "l_orderkey",
        "l_linenumber",
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        money(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        money(F.col("p_retailprice")).alias("original_price"),
        F.lit(None).cast("string").alias("currency"),
        F.when(F.col("l_linestatus") == "O", F.lit("In stock")).otherwise(F.lit("Out of stock")).alias("availability"),
        F.array(
            F.concat(F.lit("/img/"), F.col("l_partkey").cast("string"), F.lit(".jpg")),
            F.concat(F.lit("/img/"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit(".jpg")),
        ).alias("images"),
        F.concat(F.lit("https://shop.example.com/p/"), F.col("l_partkey").cast("string")).alias("url"),
        F.col("l_tax").alias("response_time"),
    )


def _price_sql(x: str) -> str:
    return f"coalesce(TRY_CAST(replace(regexp_replace({x}, {Q.lit(T.PRICE_KEEP_RE)}, '', 'g'), ',', '') AS DOUBLE), 0.0)"


PRODUCTS_SQL = """products AS (
  SELECT l.l_orderkey, l.l_linenumber, p.p_name AS name, p.p_brand AS brand,
         '$' || format('{:,.2f}', l.l_extendedprice / l.l_quantity) AS price,
         '$' || format('{:,.2f}', p.p_retailprice) AS original_price,
         CASE WHEN l.l_linestatus = 'O' THEN 'In stock' ELSE 'Out of stock' END AS availability,
         '/img/' || CAST(l.l_partkey AS VARCHAR) || '.jpg' AS img1,
         '/img/' || CAST(l.l_partkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) || '.jpg' AS img2,
         'https://shop.example.com/p/' || CAST(l.l_partkey AS VARCHAR) AS url, l.l_tax AS response_time
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
)"""


@query(
    "p4_u2_product_record",
    f"""WITH {PRODUCTS_SQL},
priced AS (SELECT *, {_price_sql('price')} AS cp, {_price_sql('original_price')} AS op FROM products)
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       trim(name) AS basic_info_name, trim(brand) AS basic_info_brand,
       cp AS pricing_current_price, op AS pricing_original_price,
       CASE WHEN op > 0 THEN (op - cp) / op * 100 END AS pricing_discount, 'USD' AS pricing_currency,
       contains(lower(availability), 'in stock') AS availability_in_stock,
       img1 AS media_main_image, img2 AS media_gallery, url AS metadata_url, response_time AS metadata_response_time
FROM priced""",
)
def p4_product(spark, sf_dir):
    """P4 + U2 + X11 + X14 + X26: nested product record, flattened to ``a_b`` columns."""
    rec = RP.product_record(_products(spark, sf_dir), keep=["l_orderkey", "l_linenumber"])
    return RP.flatten(rec)


@query(
    "f10_deal_alerts",
    f"""WITH {PRODUCTS_SQL}
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, name, {_price_sql('price')} AS price FROM products
WHERE contains(lower(availability), 'in stock') AND {_price_sql('price')} < {DEAL_PRICE}""",
)
def f10_deals(spark, sf_dir):
    """F10 + X26: deal alert when the product is in stock and its price is under 100."""
    p = _products(spark, sf_dir).withColumn("price_value", T.parse_price(F.col("price")))
    alerts = p.where(T.in_stock(F.col("availability")) & (F.col("price_value") < DEAL_PRICE))
    return alerts.select("l_orderkey", "l_linenumber", "name", F.col("price_value").alias("price"))


# --------------------------------------------------------------------------
# Sites
# --------------------------------------------------------------------------

ROOT_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"


@query(
    "f14_j8_site_paths",
    Q.with_results(
        f""", latest AS (
  SELECT url, status_code FROM (SELECT url, status_code,
         row_number() OVER (PARTITION BY url ORDER BY timestamp DESC, id DESC) AS rn FROM scrape_results) WHERE rn = 1),
roots AS (SELECT DISTINCT regexp_extract(url, {Q.lit(ROOT_RE)}, 1) AS root FROM pages),
probes AS (SELECT root, path, root || path AS url FROM roots, (SELECT unnest([{', '.join(Q.lit(p) for p in COMMON_PATHS)}]) AS path))
SELECT p.root, p.path, p.url, CAST(l.status_code AS BIGINT) AS status_code, coalesce(l.status_code < 400, false) AS exists
FROM probes p LEFT JOIN latest l ON l.url = p.url"""
    ),
)
def f14_paths(spark, sf_dir):
    """F14 + J8: for every site root, the common paths and whether the store
    holds a response under 400 for them (latest attempt per URL)."""
    from pagelake.operators import store as ST

    r = _results(spark, sf_dir).select("url", "id", "timestamp", "status_code")
    latest = ST.latest_per_key_agg(r, "url", "timestamp", "id").select("url", "status_code")
    roots = tables.pages(spark, sf_dir).select(F.regexp_extract("url", ROOT_RE, 1).alias("root")).distinct()
    probes = roots.select("root", F.explode(F.array(*[F.lit(p) for p in COMMON_PATHS])).alias("path")).withColumn(
        "url", F.concat("root", "path")
    )
    j = probes.join(latest, "url", "left")
    return j.select(
        "root", "path", "url", "status_code", F.coalesce(F.col("status_code") < 400, F.lit(False)).alias("exists")
    )


def _site_report_sql() -> str:
    per = []
    for m in METHODS:
        per.append(f"max(CASE WHEN method_used = '{m}' AND status = 'success' THEN response_time END) AS {m}_time")
    titles = ", ".join(f"max(CASE WHEN method_used = '{m}' AND status = 'success' THEN title END)" for m in METHODS)
    return Q.with_results(
        f""", lm AS (
  SELECT * FROM (SELECT url, method_used, status, response_time, title, links_count, images_count,
         row_number() OVER (PARTITION BY url, method_used ORDER BY timestamp DESC, id DESC) AS rn FROM scrape_results)
  WHERE rn = 1)
SELECT url, coalesce({titles}) AS title,
       max(CASE WHEN status = 'success' THEN links_count END) AS links_count,
       max(CASE WHEN status = 'success' THEN images_count END) AS images_count,
       {', '.join(per)}
FROM lm GROUP BY url"""
    )


@query("j12_site_report", _site_report_sql())
def j12_report(spark, sf_dir):
    """Per URL, the latest result of each method combined into one record
    (a method whose latest attempt failed contributes NULL)."""
    r = _results(spark, sf_dir)
    rec = F.struct("status", "response_time", "title", "links_count", "images_count")
    lm = r.groupBy("url", "method_used").agg(F.max_by(rec, F.struct("timestamp", "id")).alias("r")).select(
        "url", "method_used", "r.*"
    )
    ok = F.col("status") == "success"
    per = [F.max(F.when((F.col("method_used") == m) & ok, F.col("response_time"))).alias(f"{m}_time") for m in METHODS]
    titles = [F.max(F.when((F.col("method_used") == m) & ok, F.col("title"))) for m in METHODS]
    return lm.groupBy("url").agg(
        F.coalesce(*titles).alias("title"),
        F.max(F.when(ok, F.col("links_count"))).alias("links_count"),
        F.max(F.when(ok, F.col("images_count"))).alias("images_count"),
        *per,
    )


@query(
    "a25_server_countries",
    "SELECT DISTINCT n.n_name AS country FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey",
)
def a25_countries(spark, sf_dir):
    """Distinct server countries (sorted in the report; order-free here)."""
    servers = R.servers_from(tables.read(spark, sf_dir, "supplier"), tables.read(spark, sf_dir, "nation"))
    return servers.select("country").distinct().orderBy("country")


# --------------------------------------------------------------------------
# Cache hit rate (A29): a request hits when a success for its URL is less
# than the TTL older than it.
# --------------------------------------------------------------------------


def cache_hits(results, ttl_s: int = K.CACHE_TTL_S, width_s: int | None = None):
    """Per request: ``hit`` when the latest earlier success of the same URL is
    less than ``ttl_s`` old.

    Rows are cut into segments of a URL by rank (``ordered.segments``), so a
    hot URL is cut into many.
    The latest earlier success is either earlier in the row's own segment (a
    window inside the segment) or the latest success of all the URL's
    earlier segments (a running max over the small per-segment table).
    """
    from pagelake.operators import ordered as O

    us = ttl_s * 1_000_000
    r = results.select("id", "url", "timestamp", "status").withColumn(
        "_t", F.unix_micros(F.col("timestamp").cast("timestamp"))
    )
    r = O.segments(r, "url", ["timestamp", "id"], width_s)
    s_t = F.when(F.col("status") == "success", F.col("_t"))
    seg = W.partitionBy("url", "_bucket").orderBy("timestamp", "id").rowsBetween(W.unboundedPreceding, -1)
    r = r.withColumn("_in", F.max(s_t).over(seg))
    per_seg = r.groupBy("url", "_bucket").agg(F.max(s_t).alias("_m"))
    carry = per_seg.select(
        "url", "_bucket",
        F.max("_m").over(W.partitionBy("url").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)).alias("_prev"),
    )
    j = O.join_segments(r, carry, "url")
    last = F.greatest(F.col("_in"), F.col("_prev"))
    return j.select("id", "url", (last.isNotNull() & (F.col("_t") - last < us)).alias("hit"))


@query(
    "a29_cache_hit_rate",
    Q.with_results(
        f""", h AS (
  SELECT epoch_us(timestamp) - max(CASE WHEN status = 'success' THEN epoch_us(timestamp) END)
         OVER (PARTITION BY url ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS age
  FROM scrape_results)
SELECT count(*) AS requests, count(*) FILTER (WHERE age < {K.CACHE_TTL_S * 1_000_000}) AS hits,
       count(*) FILTER (WHERE age IS NULL OR age >= {K.CACHE_TTL_S * 1_000_000}) AS misses,
       round(count(*) FILTER (WHERE age < {K.CACHE_TTL_S * 1_000_000}) / count(*), 6) AS hit_rate
FROM h"""
    ),
)
def a29_hit_rate(spark, sf_dir):
    """Cache hit rate hits / (hits + misses) replayed over the request log (TTL 3600 s)."""
    h = cache_hits(_results(spark, sf_dir))
    return h.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("hit").alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"),
        F.round(F.count_if("hit") / F.count(F.lit(1)), 6).alias("hit_rate"),
    )


# --------------------------------------------------------------------------
# Lists, alerts, search
# --------------------------------------------------------------------------


@query(
    "l6_a30_link_lists",
    Q.with_results(
        f"""SELECT id, array_to_string(links[1:{FIRST_LINKS}], '|') AS first_links, len(links) AS links_total,
       len(list_distinct(links)) AS links_distinct FROM scrape_results"""
    ),
)
def l6_lists(spark, sf_dir):
    """L6 + A30: first 5 links of each result, and its total and distinct link counts."""
    r = _results(spark, sf_dir)
    return r.select(
        "id",
        F.array_join(F.slice("links", 1, FIRST_LINKS), "|").alias("first_links"),
        F.size("links").alias("links_total"),
        F.size(F.array_distinct("links")).alias("links_distinct"),
    )


@query(
    "f13_error_rate_alert",
    Q.with_attempts(
        f"""SELECT method, count(*) AS requests,
       round(count(*) FILTER (WHERE NOT (status_code >= 200 AND status_code < 300)) / count(*), 6) AS error_rate,
       count(*) FILTER (WHERE NOT (status_code >= 200 AND status_code < 300)) / count(*) > {ERROR_RATE_ALERT} AS alert
FROM attempts GROUP BY method"""
    ),
)
def f13_alert(spark, sf_dir):
    """error rate per method and the alert flag when it exceeds 5 %."""
    a = tables.attempts(spark, sf_dir)
    ok = (F.col("status_code") >= 200) & (F.col("status_code") < 300)
    g = a.groupBy("method").agg(F.count(F.lit(1)).alias("requests"), F.count_if(~ok).alias("_err"))
    rate = F.col("_err") / F.col("requests")
    return g.select("method", "requests", F.round(rate, 6).alias("error_rate"), (rate > ERROR_RATE_ALERT).alias("alert"))


def _tf_sql(word: str) -> str:
    return f"len(list_filter(regexp_split_to_array(lower(text), {Q.lit(r'\W+')}), lambda t: t = {Q.lit(word)}))"


@query(
    "x3b_fulltext_rank",
    f"""WITH tf AS (SELECT doc_id, {', '.join(f'{_tf_sql(w)} AS tf_{w}' for w in SEARCH_WORDS)} FROM documents),
n AS (SELECT count(*) AS n_docs, {', '.join(f'count(*) FILTER (WHERE tf_{w} > 0) AS df_{w}' for w in SEARCH_WORDS)} FROM tf)
SELECT doc_id, round({' + '.join(f'tf_{w} * ln(n_docs / df_{w})' for w in SEARCH_WORDS)}, 6) AS score
FROM tf, n WHERE {' AND '.join(f'tf_{w} > 0' for w in SEARCH_WORDS)}
ORDER BY score DESC, doc_id LIMIT {SEARCH_TOP}""",
)
def x3b_rank(spark, sf_dir):
    """Documents holding every query word, ranked by Σ tf·idf (top 50).

    Whole texts are tokenised (lower case, split on non-word runs); term
    counts per document need no shuffle, document frequencies are one global
    aggregate (a single row, joined as a constant)."""
    docs = tables.read(spark, sf_dir, "documents")
    toks = F.split(F.lower(F.col("text")), r"\W+")
    def count_of(word):
        return F.size(F.filter(toks, lambda t: t == F.lit(word)))

    tf = docs.select("doc_id", *[count_of(w).alias(f"tf_{w}") for w in SEARCH_WORDS])
    n = tf.agg(F.count(F.lit(1)).alias("n_docs"), *[F.count_if(F.col(f"tf_{w}") > 0).alias(f"df_{w}") for w in SEARCH_WORDS])
    j = tf.crossJoin(F.broadcast(n))
    score = sum(F.col(f"tf_{w}") * F.log(F.col("n_docs") / F.col(f"df_{w}")) for w in SEARCH_WORDS)
    hits = j.where(F.expr(" AND ".join(f"tf_{w} > 0" for w in SEARCH_WORDS)))
    return hits.select("doc_id", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(SEARCH_TOP)


ALL_WORDS = "The from with THIS er"
ANY_WORDS = "laou tretre oiment chaux the"


def _search_sql(text: str, all_of: bool) -> str:
    words = sorted({w for w in text.lower().split()})
    listed = ", ".join(Q.lit(w) for w in words)
    need = f"HAVING count(*) = {len(words)}" if all_of else ""
    return f"""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), {Q.lit(r'\W+')})) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN ({listed}) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n_docs FROM documents)
SELECT doc_id, count(*) AS matched, round(sum(tf * ln(n_docs / df)), 6) AS score
FROM tf JOIN df USING (term) CROSS JOIN n GROUP BY doc_id {need} ORDER BY score DESC, doc_id LIMIT {SEARCH_TOP}"""


def _index(spark, sf_dir) -> str:
    """An index of all documents, written in two appends."""
    docs = tables.read(spark, sf_dir, "documents")
    path = f"{checkpoint_dir(spark)}/fulltext-{uuid.uuid4().hex}"
    for batch in (0, 1):
        FT.append(docs.where(F.pmod(F.col("doc_id"), F.lit(2)) == batch), path, batch)
    return path


@query("x3b_index_all", _search_sql(ALL_WORDS, True))
def x3b_index_all(spark, sf_dir):
    """Documents that hold all words of a query, from the stored inverted index."""
    return FT.search(spark, _index(spark, sf_dir), ALL_WORDS, "all", SEARCH_TOP)


@query("x3b_index_any", _search_sql(ANY_WORDS, False))
def x3b_index_any(spark, sf_dir):
    """Documents that hold any word of a query, from the stored inverted index."""
    return FT.search(spark, _index(spark, sf_dir), ANY_WORDS, "any", SEARCH_TOP)
