"""Registered queries over pages derived with the markup that the given ones lack
(H2, H4–H9, H11b, H25), and rules fed with values that reach every branch (F6, H15, U-a, X18, X19, X27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.functions import html as H
from pagelake.functions import scoring as S
from pagelake.operators import extract as X
from pagelake.operators import store as ST
from pagelake.plans import sqlfrag as Q
from pagelake.plans.registry import query
from pagelake.sources import tables

# Fixed values, given by turn: scripts and body attributes that name frameworks, headers, codes, fields.
FRAMEWORK_MARKS = ["<div data-react='1'></div>", "<p v-if='x'></p>", "<div ng-app='a'></div><script>$('p')</script>", "<p>none</p>"]
FRAMEWORK_NAMES = ["react", "vue", "angular|jquery", ""]
CONTENT_TYPES = ["Text/HTML; charset=UTF-8", "application/JSON", None]
CODES = [200, 204, 404]
FIELD_VALUES = ["text", "", None, "[]", '["a","b"]']
PRICES = ["12.5", "abc", "", None, "-3"]
LINKS = ["https://a.example/x", "nope", "ftp://host/f", None]


def _turn(values, at):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def _turn_sql(values, at) -> str:
    listed = ", ".join("NULL" if v is None else Q.lit(v) if isinstance(v, str) else str(v) for v in values)
    return f"[{listed}][CAST(({at}) % {len(values)} AS BIGINT) + 1]"


def _text(c):
    return c.cast("string")


def marked_pages(spark, sf_dir):
    """Stand-in: a page a document, with description, meta tags, forms, scripts, images and framework marks; every sixth is JSON."""
    n = F.col("doc_id")
    page = F.concat(
        F.lit('<html><head><title>T</title><meta name="description" content=" About '), _text(n), F.lit(' "><meta name="robots" content="r'), _text(n % 3),
        F.lit('"><META content="site" NAME="owner"><meta name="robots" content="last"><meta charset="utf-8">'),
        F.when(n % 2 == 0, F.concat(F.lit('<script src="/js/'), _text(n), F.lit("""/m.js"></script><script defer src='https://cdn.example/a.js'></script>"""))).otherwise(F.lit("<script>var x;</script>")),
        F.lit("</head><body>"), _turn(FRAMEWORK_MARKS, n),
        F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n % 3), lambda i: F.concat(F.lit('<FORM action="/f'), _text(i), F.lit('"><input name="q">\n</FORM>'))), ""),
        F.lit('<img src="/i/b.png" alt="b"><img alt="a" src="/i/a'), _text(n), F.lit(""".png"><img src='http://img.example/c.gif'><img src="rel.png"></body></html>"""),
    )
    body = F.when(n % 6 == 5, F.concat(F.lit('{"title": "Doc '), _text(n), F.lit('", "n": '), _text(n), F.lit("}"))).otherwise(page)
    return tables.read(spark, sf_dir, "documents").select(
        n.alias("page_id"), F.concat(F.lit("https://site"), _text(n % 4), F.lit(".example/p/"), _text(n)).alias("url"), body.alias("html"),
        F.when(n % 3 < 2, F.create_map(F.lit("content-type"), _turn(CONTENT_TYPES, n))).alias("headers"),
    )


@query(
    "h2_h9_markup",
    f"""SELECT doc_id AS page_id, doc_id % 6 = 5 AS is_json, CASE WHEN doc_id % 6 = 5 THEN 'Doc ' || doc_id END AS json_title,
  CASE WHEN doc_id % 6 <> 5 THEN 'About ' || doc_id END AS description,
  CASE WHEN doc_id % 6 = 5 THEN '' ELSE 'description= About ' || doc_id || ' ,owner=site,robots=last' END AS meta_tags,
  CASE WHEN doc_id % 6 = 5 THEN '' ELSE {_turn_sql(FRAMEWORK_NAMES, 'doc_id')} END AS frameworks,
  CASE WHEN doc_id % 6 = 5 THEN 0 ELSE doc_id % 3 + 1 END AS forms,
  CASE WHEN doc_id % 6 = 5 OR doc_id % 2 = 1 THEN '' ELSE '/js/' || doc_id || '/m.js|https://cdn.example/a.js' END AS scripts,
  CASE WHEN doc_id % 3 < 2 THEN lower({_turn_sql(CONTENT_TYPES, 'doc_id')}) ELSE '' END AS content_type
FROM documents""",
)
def h2_markup(spark, sf_dir):
    """H2, H4–H9: JSON body, description, meta tags, frameworks, forms, external scripts and content type of marked pages."""
    p = marked_pages(spark, sf_dir)
    html = F.col("html")
    tags = F.array_sort(F.transform(F.map_entries(H.meta_tags(html)), lambda e: F.concat(F.lower(e["key"]), F.lit("="), e["value"])))
    return p.select(
        "page_id",
        H.json_body(html).isNotNull().alias("is_json"),
        F.try_variant_get(H.json_body(html), "$.title", "string").alias("json_title"),
        H.meta_description(html).alias("description"),
        F.array_join(tags, ",").alias("meta_tags"),
        F.array_join(H.frameworks(html), "|").alias("frameworks"),
        H.forms_count(html).alias("forms"),
        F.array_join(H.external_scripts(html), "|").alias("scripts"),
        H.content_type("headers").alias("content_type"),
    )


@query(
    "h11b_images",
    """SELECT doc_id AS page_id, unnest(['http://img.example/c.gif', 'https://site' || (doc_id % 4) || '.example/i/a' || doc_id || '.png',
  'https://site' || (doc_id % 4) || '.example/i/b.png']) AS image FROM documents WHERE doc_id % 6 <> 5""",
)
def h11b_images(spark, sf_dir):
    """Resolved, distinct images of marked pages (relative ones are dropped in root mode)."""
    p = marked_pages(spark, sf_dir)
    return p.select("page_id", F.explode(H.images(F.col("html"), F.col("url"))).alias("image"))


@query(
    "h15_link_values",
    f"""SELECT page_id, pos - 1 AS ord, {Q.resolve_root('url', 'links[pos]')} AS link
FROM (SELECT page_id, url, links, unnest(range(1, len(links) + 1)) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, {Q.lit(H.LINK_RE)}, 1) AS links FROM pages) a) b""",
)
def h15_values(spark, sf_dir):
    """Every link of a page in page order, resolved, repeats kept."""
    p = tables.pages(spark, sf_dir)
    return p.select("page_id", F.posexplode(H.links(F.col("html"), F.col("url"), mode="all", distinct=False)).alias("ord", "link"))


@query("f6_successes", Q.with_results("SELECT url, title, timestamp FROM scrape_results WHERE status = 'success'"))
def f6_successes(spark, sf_dir):
    """the success branch (url, title, timestamp)."""
    ok, _ = ST.split_outcomes(tables.scrape_results(spark, sf_dir))
    return ok


@query(
    "ua_method_union",
    Q.with_attempts(
        """SELECT attempt_id, method, status_code, NULL AS response_time, NULL AS proxy_id FROM attempts WHERE method = 'scrapy'
UNION ALL SELECT attempt_id, method, NULL, response_time, NULL FROM attempts WHERE method = 'pydoll'
UNION ALL SELECT attempt_id, method, NULL, response_time, proxy_id FROM attempts WHERE method = 'playwright'"""
    ),
)
def ua_union(spark, sf_dir):
    """U-a: results of methods with different columns in one frame, missing ones NULL."""
    a = tables.attempts(spark, sf_dir)
    own = {"scrapy": ["status_code"], "pydoll": ["response_time"], "playwright": ["response_time", "proxy_id"]}
    parts = [a.where(F.col("method") == m).select("attempt_id", "method", *columns) for m, columns in own.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


_FIELDS = [_turn_sql(FIELD_VALUES, f"event_id // {5 ** i}") for i in range(3)]


@query(
    "x18_x19_scores",
    f"""WITH e AS (SELECT event_id, {_turn_sql(CODES, 'event_id')} AS sc, [{', '.join(_FIELDS)}][1:CAST(event_id % 4 AS BIGINT)] AS v FROM events)
SELECT event_id,
  round(least(1.0, CASE WHEN sc = 200 THEN 0.3 WHEN sc = 204 THEN 0.2 ELSE 0 END
    + CASE WHEN len(v) > 0 THEN 0.7 * len(list_filter(v, lambda x: x IS NOT NULL AND x <> '' AND x <> '[]')) / len(v) ELSE 0 END), 9) AS success_score,
  round(least(1.0, CASE WHEN sc = 200 THEN 0.3 ELSE 0 END
    + CASE WHEN len(v) > 0 THEN 0.7 * len(list_filter(v, lambda x: x IS NOT NULL)) / len(v) ELSE 0 END), 9) AS strict_score,
  round(CASE WHEN event_id % 4 = 0 AND event_id % 8 = 0 THEN 1.0 WHEN len(v) = 0 THEN 0.0 ELSE len(list_filter(v, lambda x: x IS NOT NULL)) / 3.0 END, 9) AS completeness
FROM e""",
)
def x18_scores(spark, sf_dir):
    """X18 + X19: both score variants and the completeness, over codes and values that reach every branch."""
    n = F.col("event_id")
    v = F.slice(F.array(*[_turn(FIELD_VALUES, F.floor(n / 5**i)) for i in range(3)]), F.lit(1), (n % 4).cast("int"))
    e = tables.events(spark, sf_dir).select("event_id", _turn(CODES, n).alias("sc"), v.alias("v"), F.when(n % 8 == 0, 0).otherwise(3).alias("selectors"))
    return e.select(
        "event_id",
        F.round(S.success_score("sc", "v"), 9).alias("success_score"),
        F.round(S.success_score("sc", "v", "strict200"), 9).alias("strict_score"),
        F.round(S.data_completeness("v", "selectors"), 9).alias("completeness"),
    )


@query(
    "x27_number_rules",
    f"""WITH e AS (SELECT event_id, event_type, {_turn_sql(PRICES, 'event_id')} AS price, {_turn_sql(LINKS, 'event_id // 5')} AS link FROM events)
SELECT event_id, CASE WHEN event_type = 'error' THEN 'Scrape failed: HTTP' WHEN price IS NULL OR price = '' THEN 'Missing required field: price' ELSE '' END AS errors,
  CASE WHEN event_type = 'error' THEN '' ELSE concat_ws('|',
    CASE WHEN price IS NOT NULL AND try_cast(price AS DOUBLE) IS NULL THEN 'Field ''price'' should be numeric but got: ' || price END,
    CASE WHEN link = 'nope' THEN 'Field ''link'' contains invalid URL: nope' END) END AS warnings
FROM e""",
)
def x27_numbers(spark, sf_dir):
    """Required, numeric and URL rules over fields that break each of them."""
    n = F.col("event_id")
    data = F.create_map(F.lit("price"), _turn(PRICES, n), F.lit("link"), _turn(LINKS, F.floor(n / 5)))
    e = tables.events(spark, sf_dir).select("event_id", F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), data.alias("data"))
    errors, warnings = S.validation_errors("status", F.lit("HTTP"), "data", ["price"], ["price"], ["link"])
    return e.select("event_id", F.array_join(errors, "|").alias("errors"), F.array_join(warnings, "|").alias("warnings"))
