"""Corpus-wide HTML extraction (H1–H26) as projections over ``pages``.

Each operator is ``DataFrame -> DataFrame``: a single narrow ``select`` over
the page scan (no shuffle), with the HTML column dropped at the end so it is
never carried into a later join or aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions import html as H
from pagelake.functions import urls as U

LEVELS = ("basic", "enhanced", "advanced")


def extract_record(pages: DataFrame, level: str = "advanced", headers_col: str | None = None) -> DataFrame:
    """The basic / enhanced / advanced extraction record per page.

    basic: title, meta_description, headings.  enhanced adds json_data,
    content_type and meta_tags (a page whose body is JSON gets
    ``content_type='json'`` and no meta_tags).  advanced adds frameworks,
    forms_count and external_scripts.  Links, images, domain, dynamic flag
    and content length are always there (they are part of every result).
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    html, url = F.col("html"), F.col("url")
    cols = [
        F.col("page_id"),
        url,
        U.netloc(url).alias("domain"),
        H.title(html).alias("title"),
        H.meta_description(html).alias("meta_description"),
        H.headings(html).alias("headings"),
    ]
    if level in ("enhanced", "advanced"):
        body = H.json_body(html)
        is_json = body.isNotNull()
        headers = F.col(headers_col) if headers_col else None
        cols += [
            body.alias("json_data"),
            F.when(is_json, F.lit("json")).otherwise(H.content_type(headers)).alias("content_type"),
            F.when(~is_json, H.meta_tags(html)).alias("meta_tags"),
        ]
    if level == "advanced":
        cols += [
            H.frameworks(html).alias("frameworks"),
            H.forms_count(html).alias("forms_count"),
            H.external_scripts(html).alias("external_scripts"),
        ]
    cols += [
        H.dynamic_content(html).alias("dynamic_content"),
        H.links(html, url).alias("links"),
        H.images(html, url).alias("images"),
        H.content_length(html).alias("content_length"),
    ]
    return pages.select(*cols)


def page_text(pages: DataFrame, preview_chars: int = H.PREVIEW_CHARS) -> DataFrame:
    """Visible text, 500-char preview, word count, paragraph text."""
    text = H.visible_text(F.col("html"))
    return pages.select(
        "page_id",
        "url",
        text.alias("text"),
        H.preview(text, preview_chars).alias("text_preview"),
        # The visible text is already collapsed and trimmed: its words are
        # the pieces between single spaces (Python's len(text.split())).
        F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " "))).alias("word_count"),
        H.paragraph_text(F.col("html")).alias("content"),
    )


def link_split(pages: DataFrame, site_marker_col: str | None = None, mode: str = "root") -> DataFrame:
    """Internal / external links and the raw total before dedupe.

    An absolute http(s) link is internal when it contains the site marker
    (the page's own netloc unless ``site_marker_col`` is given), external
    otherwise; ``/x`` links (and, in ``relative`` mode, relative paths other
    than ``#``, mailto:, tel:, javascript:) are joined and internal.
    """
    html, url = F.col("html"), F.col("url")
    marker = F.col(site_marker_col) if site_marker_col else U.netloc(url)
    raw = H.raw_links(html)
    is_abs = lambda x: x.startswith("http://") | x.startswith("https://")
    if mode == "root":
        joinable = lambda x: ~is_abs(x) & x.startswith("/")
    elif mode == "relative":
        joinable = lambda x: ~is_abs(x) & ~(
            x.startswith("#") | x.startswith("mailto:") | x.startswith("tel:") | x.startswith("javascript:")
        )
    else:
        raise ValueError("mode must be root or relative")
    internal = F.concat(
        F.filter(raw, lambda x: is_abs(x) & x.contains(marker)),
        F.transform(F.filter(raw, joinable), lambda x: U.resolve(url, x)),
    )
    external = F.filter(raw, lambda x: is_abs(x) & ~x.contains(marker))
    return pages.select(
        "page_id",
        "url",
        F.size(raw).alias("links_total"),
        F.array_sort(F.array_distinct(internal)).alias("internal_links"),
        F.array_sort(F.array_distinct(external)).alias("external_links"),
    )


def link_edges(extracted: DataFrame) -> DataFrame:
    """Link-graph edges (page → link) with internal/external type."""
    e = extracted.select("page_id", "url", F.explode("links").alias("link"))
    src = U.netloc(F.col("url"))
    return e.select(
        "page_id",
        F.col("url").alias("source_url"),
        "link",
        F.when(F.col("link").contains(src), F.lit("internal")).otherwise(F.lit("external")).alias("link_type"),
    )


def image_rows(extracted: DataFrame) -> DataFrame:
    """One row per image of a page."""
    return extracted.select("page_id", F.col("url").alias("source_url"), F.posexplode("images").alias("ord", "image"))


def nav_rows(pages: DataFrame) -> DataFrame:
    """One row per navigation item (text, href) in page order."""
    return pages.select("page_id", F.posexplode(H.nav_items(F.col("html"))).alias("ord", "item")).select(
        "page_id", "ord", F.col("item.text").alias("text"), F.col("item.href").alias("href")
    )


def contacts(df: DataFrame, text_col: str, key_col: str) -> DataFrame:
    """E-mail addresses and up to five phone numbers per row."""
    t = F.col(text_col)
    return df.select(key_col, H.emails(t).alias("emails"), H.phones(t).alias("phones"))


def page_sizes(pages: DataFrame) -> DataFrame:
    """Characters, UTF-8 bytes, capped HTML length, preview, JSON keys."""
    html = F.col("html")
    return pages.select(
        "page_id",
        H.content_length(html).alias("content_length"),
        H.download_size(html).alias("download_size"),
        F.length(H.capped_html(html)).alias("raw_html_length"),
        H.body_preview(html).alias("body_preview"),
        H.json_body(html).isNotNull().alias("is_json"),
        H.json_field_count(html).alias("json_fields"),
    )


def body_probe(bodies: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Per body whether it is JSON, its top-level fields, the length of its value's text and the preview of a plain one."""
    html = F.col("html")
    is_json = H.json_body(html).isNotNull()
    preview = H.body_preview(html)
    return bodies.select(
        id_col,
        is_json.alias("is_json"),
        F.when(is_json, H.json_field_count(html)).alias("json_fields"),
        F.when(is_json, F.length(html)).otherwise(F.length(preview)).alias("data_size"),
        preview.alias("body_preview"),
    )
