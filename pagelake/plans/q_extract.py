"""Registered extraction queries (S2, H1–H26) over the whole ``pages`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.functions import html as H
from pagelake.functions import urls as U
from pagelake.operators import extract as X
from pagelake.plans import sqlfrag as Q
from pagelake.plans.registry import query
from pagelake.sources import tables


def _pages(spark, sf_dir):
    return tables.pages(spark, sf_dir)


def _joined(arr):
    return F.array_join(arr, "|")


@query(
    "flagship_domain_summary",
    f"""
SELECT {Q.netloc('url')} AS domain, count(*) AS pages,
       round(avg(len({Q.links('html', 'url')})), 6) AS mean_links,
       round(avg(length(html)), 6) AS mean_length
FROM pages GROUP BY 1 ORDER BY pages DESC, domain LIMIT 10""",
)
def flagship(spark, sf_dir):
    """Pages, mean distinct links and mean length per domain; top 10 by pages."""
    ex = X.extract_record(_pages(spark, sf_dir), level="basic")
    return (
        ex.groupBy("domain")
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.round(F.avg(F.size("links")), 6).alias("mean_links"),
            F.round(F.avg("content_length"), 6).alias("mean_length"),
        )
        .orderBy(F.col("pages").desc(), F.col("domain"))
        .limit(10)
    )


@query(
    "s2_pages_scan",
    f"SELECT page_id, url, {Q.netloc('url')} AS domain, length(html) AS content_length FROM pages",
)
def s2_pages(spark, sf_dir):
    """S2 + X2 + H20: page source scan with domain and length (html pruned after)."""
    p = _pages(spark, sf_dir)
    return p.select("page_id", "url", U.netloc("url").alias("domain"), H.content_length("html").alias("content_length"))


@query(
    "h1_title",
    f"SELECT page_id, {Q.title('html')} AS title, "
    f"coalesce({Q.strip(Q.first_group('html', H.TITLE_LINE_RE))}, 'No title') AS title_or_default FROM pages",
)
def h1_title(spark, sf_dir):
    """First <title>, stripped; the no-DOTALL form defaults to 'No title'."""
    p = _pages(spark, sf_dir)
    return p.select("page_id", H.title("html").alias("title"), H.title_or_default("html").alias("title_or_default"))


@query(
    "h2_meta_description",
    f"SELECT page_id, {Q.meta_description('html')} AS meta_description FROM pages",
)
def h2_meta(spark, sf_dir):
    """H2: meta description (name before content, no DOTALL)."""
    return _pages(spark, sf_dir).select("page_id", H.meta_description("html").alias("meta_description"))


@query(
    "h3_headings",
    f"""SELECT page_id, len(h) AS n_headings, array_to_string(h, '|') AS headings
FROM (SELECT page_id, {Q.headings('html')} AS h FROM pages)""",
)
def h3_headings(spark, sf_dir):
    """H3: h1, then h2, then h3 texts, tag-stripped, non-empty."""
    h = H.headings("html")
    return _pages(spark, sf_dir).select("page_id", F.size(h).alias("n_headings"), _joined(h).alias("headings"))


@query(
    "h3b_headings_level",
    f"""SELECT page_id, lv AS level, x.i AS ord, x.t AS text FROM (
  SELECT page_id, lv, unnest(list_transform(h, lambda t, i: {{'t': t, 'i': i - 1}})) AS x FROM (
    SELECT page_id, 1 AS lv, {Q._heading('html', 1)} AS h FROM pages UNION ALL
    SELECT page_id, 2, {Q._heading('html', 2)} FROM pages UNION ALL
    SELECT page_id, 3, {Q._heading('html', 3)} FROM pages))""",
)
def h3b_levels(spark, sf_dir):
    """Headings with level, one row per (page, level, position)."""
    p = _pages(spark, sf_dir)
    parts = [
        p.select("page_id", F.lit(lv).alias("level"), F.posexplode(H.headings_at("html", lv)).alias("ord", "text"))
        for lv in (1, 2, 3)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "h4_h6_json_body",
    "SELECT page_id, json_valid(html) AS is_json, "
    "CASE WHEN json_valid(html) THEN 'json' ELSE '' END AS content_type FROM pages",
)
def h4_json(spark, sf_dir):
    """H4 + H6: body parsed as JSON; content type 'json' or the header's ('' here)."""
    ex = X.extract_record(_pages(spark, sf_dir), level="enhanced")
    return ex.select("page_id", F.col("json_data").isNotNull().alias("is_json"), "content_type")


@query(
    "h5_meta_tags",
    f"""SELECT page_id, e.k AS name, e.v AS content FROM (
  SELECT page_id, unnest(list_transform(m, lambda x, i: {{'k': regexp_extract(x, {Q.lit(H.META_NAME_RE)}, 1),
                                                     'v': regexp_extract(x, {Q.lit(H.META_CONTENT_RE)}, 1),
                                                     'i': i}})) AS e
  FROM (SELECT page_id, regexp_extract_all(html, {Q.lit(H.META_RE)}, 1) AS m FROM pages WHERE NOT json_valid(html))
)
WHERE e.k <> '' AND e.v <> ''
QUALIFY row_number() OVER (PARTITION BY page_id, e.k ORDER BY e.i DESC) = 1""",
)
def h5_meta(spark, sf_dir):
    """H5: meta name → content map, exploded to (page_id, name, content)."""
    ex = X.extract_record(_pages(spark, sf_dir), level="enhanced")
    return ex.select("page_id", F.explode("meta_tags").alias("name", "content"))


@query(
    "h7_h10_frameworks_dynamic",
    "SELECT page_id, array_to_string(list_filter(["
    + ", ".join(
        f"CASE WHEN {Q.contains_any('lower(html)', inds)} THEN {Q.lit(name)} END"
        for name, inds in H.FRAMEWORK_INDICATORS
    )
    + f"], lambda x: x IS NOT NULL), '|') AS frameworks, {Q.contains_any('lower(html)', H.DYNAMIC_KEYWORDS)} AS dynamic_content "
    "FROM pages",
)
def h7_frameworks(spark, sf_dir):
    """H7 + H10: framework names and the dynamic-content flag (substring tests)."""
    p = _pages(spark, sf_dir)
    return p.select("page_id", _joined(H.frameworks("html")).alias("frameworks"), H.dynamic_content("html").alias("dynamic_content"))


@query(
    "h8_h9_forms_scripts",
    f"SELECT page_id, len(regexp_extract_all(html, {Q.lit(H.FORM_RE)}, 0)) AS forms_count, "
    f"array_to_string(regexp_extract_all(html, {Q.lit(H.SCRIPT_SRC_RE)}, 1), '|') AS external_scripts FROM pages",
)
def h8_forms(spark, sf_dir):
    """H8 + H9: form count and external script sources."""
    p = _pages(spark, sf_dir)
    return p.select(
        "page_id", H.forms_count("html").alias("forms_count"), _joined(H.external_scripts("html")).alias("external_scripts")
    )


@query(
    "h11_links",
    f"""SELECT page_id, len(l) AS links_count, array_to_string(l, '|') AS links,
       len(i) AS images_count, array_to_string(i, '|') AS images
FROM (SELECT page_id, {Q.links('html', 'url')} AS l, {Q.images('html', 'url')} AS i FROM pages)""",
)
def h11_links(spark, sf_dir):
    """H11 + H11b + X4: links and images resolved with urljoin (X4), deduplicated, per page."""
    p = _pages(spark, sf_dir)
    l, i = H.links("html", "url"), H.images("html", "url")
    return p.select(
        "page_id",
        F.size(l).alias("links_count"),
        _joined(l).alias("links"),
        F.size(i).alias("images_count"),
        _joined(i).alias("images"),
    )


@query(
    "h11c_link_split",
    f"""SELECT page_id, len(raw) AS links_total,
  len(list_distinct(list_concat(
      list_filter(raw, lambda x: (starts_with(x, 'http://') OR starts_with(x, 'https://')) AND contains(x, dom)),
      list_transform(list_filter(raw, lambda x: NOT (starts_with(x, 'http://') OR starts_with(x, 'https://')) AND starts_with(x, '/')),
                     lambda x: {Q.resolve_root('url', 'x')})))) AS n_internal,
  len(list_distinct(list_filter(raw, lambda x: (starts_with(x, 'http://') OR starts_with(x, 'https://')) AND NOT contains(x, dom)))) AS n_external
FROM (SELECT page_id, url, {Q.netloc('url')} AS dom, regexp_extract_all(html, {Q.lit(H.LINK_RE)}, 1) AS raw FROM pages)""",
)
def h11c_split(spark, sf_dir):
    """Raw link total and internal / external distinct counts."""
    s = X.link_split(_pages(spark, sf_dir))
    return s.select("page_id", "links_total", F.size("internal_links").alias("n_internal"), F.size("external_links").alias("n_external"))


@query(
    "h16_page_text",
    f"""SELECT page_id, substr(t, 1, 500) || '...' AS text_preview, {Q.word_count('t')} AS word_count, length(t) AS text_length
FROM (SELECT page_id, {Q.visible_text('html')} AS t FROM pages)""",
)
def h16_text(spark, sf_dir):
    """Visible text preview (500 chars + '...'), word count, text length."""
    t = X.page_text(_pages(spark, sf_dir))
    return t.select("page_id", "text_preview", "word_count", F.length("text").alias("text_length"))


@query(
    "h17_paragraphs",
    f"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(
    regexp_replace(regexp_replace(html, {Q.lit(H.SCRIPT_BLOCK_RE)}, '', 'g'), {Q.lit(H.STYLE_BLOCK_RE)}, '', 'g'),
    {Q.lit(H.PARAGRAPH_RE)}, 1), lambda p: {Q.strip(f"regexp_replace(p, {Q.lit(H.TAG_RE)}, '', 'g')")}), ' ') AS content,
  len(list_filter(list_transform(regexp_extract_all(html, {Q.lit(H.PARAGRAPH_RE)}, 1), lambda p: {Q.strip('p')}), lambda p: p <> '')) AS n_paragraphs,
  strlen(html) AS content_size
FROM pages""",
)
def h17_paragraphs(spark, sf_dir):
    """H17 + H17b: joined paragraph text, non-empty paragraph count, byte size."""
    p = _pages(spark, sf_dir)
    return p.select(
        "page_id",
        H.paragraph_text("html").alias("content"),
        F.size(H.paragraphs("html")).alias("n_paragraphs"),
        H.download_size("html").alias("content_size"),
    )


@query(
    "h18_nav_items",
    f"""SELECT page_id, x.i AS ord, {Q.strip(f"regexp_extract(x.a, {Q.lit(H.NAV_LINK_RE)}, 2)")} AS text,
       regexp_extract(x.a, {Q.lit(H.NAV_LINK_RE)}, 1) AS href
FROM (
  SELECT page_id, unnest(list_transform(items, lambda a, i: {{'a': a, 'i': i - 1}})) AS x FROM (
    SELECT page_id, flatten(list_transform(regexp_extract_all(html, {Q.lit(H.NAV_RE)}, 1),
                                           lambda n: regexp_extract_all(n, {Q.lit(H.NAV_LINK_RE)}, 0))) AS items
    FROM pages))""",
)
def h18_nav(spark, sf_dir):
    """Navigation items (text, href) in page order."""
    return X.nav_rows(_pages(spark, sf_dir))


@query(
    "h19_contacts",
    f"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, {Q.lit(H.EMAIL_RE)}, 0))), '|') AS emails,
       array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all(text, {Q.lit(H.PHONE_RE)}, 0))), 1, 5), '|') AS phones
FROM documents""",
)
def h19_contacts(spark, sf_dir):
    """Distinct e-mails and the first five sorted phone numbers per document."""
    d = tables.read(spark, sf_dir, "documents")
    c = X.contacts(d, "text", "doc_id")
    return c.select("doc_id", _joined("emails").alias("emails"), _joined("phones").alias("phones"))


@query(
    "h20_h23_sizes",
    """SELECT page_id, length(html) AS content_length, strlen(html) AS download_size,
       length(substr(html, 1, 1000000)) AS raw_html_length,
       CASE WHEN NOT json_valid(html) THEN substr(html, 1, 200) END AS body_preview
FROM pages""",
)
def h20_sizes(spark, sf_dir):
    """Characters, bytes, capped length, 200-char preview of non-JSON bodies."""
    s = X.page_sizes(_pages(spark, sf_dir))
    return s.select("page_id", "content_length", "download_size", "raw_html_length", "body_preview")


@query(
    "h24_link_edges",
    f"""SELECT page_id, url AS source_url, link,
       CASE WHEN contains(link, {Q.netloc('url')}) THEN 'internal' ELSE 'external' END AS link_type
FROM (SELECT page_id, url, unnest({Q.links('html', 'url')}) AS link FROM pages)""",
)
def h24_edges(spark, sf_dir):
    """Link-graph edge list with internal/external type."""
    return X.link_edges(X.extract_record(_pages(spark, sf_dir), level="basic"))


@query(
    "h26_extract_record",
    f"""SELECT page_id, url, {Q.netloc('url')} AS domain, {Q.title('html')} AS title,
       {Q.meta_description('html')} AS meta_description, len({Q.headings('html')}) AS n_headings,
       json_valid(html) AS is_json, len(regexp_extract_all(html, {Q.lit(H.FORM_RE)}, 0)) AS forms_count,
       {Q.contains_any('lower(html)', H.DYNAMIC_KEYWORDS)} AS dynamic_content,
       len({Q.links('html', 'url')}) AS links_count, len({Q.images('html', 'url')}) AS images_count,
       length(html) AS content_length
FROM pages""",
)
def h26_record(spark, sf_dir):
    """The advanced extraction record, one row per page (scalar view)."""
    ex = X.extract_record(_pages(spark, sf_dir), level="advanced")
    return ex.select(
        "page_id",
        "url",
        "domain",
        "title",
        "meta_description",
        F.size("headings").alias("n_headings"),
        F.col("json_data").isNotNull().alias("is_json"),
        "forms_count",
        "dynamic_content",
        F.size("links").alias("links_count"),
        F.size("images").alias("images_count"),
        "content_length",
    )
