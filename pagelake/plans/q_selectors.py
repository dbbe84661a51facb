"""Registered selector jobs (H12–H14, X18, X19).  No SQL oracle: DuckDB has no
HTML parser; tests check them against hand-made pages and a per-page fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.operators import selectors as SEL
from pagelake.plans.registry import query
from pagelake.sources import tables

# Selectors run over every page (CSS, scrapy-style pseudo-elements, XPath).
CSS_FIELDS = {
    "headline": "h1",
    "nav_links": "nav a",
    "paragraphs": "article p",
    "ad": "div.ad",
    "nav_hrefs": "nav a::attr(href)",
    "menu_items": "ul > li",
    "missing": "#does-not-exist",
}
XPATH_FIELDS = {
    "hrefs": "//a/@href",
    "footer": "//footer",
    "nav_items": "//nav//li",
    "title_text": "//title/text()",
}


@query("h12_selector_fields")
def h12_fields(spark, sf_dir):
    """CSS selector fields, long form (page_id, field, n_hits, ord, value)."""
    return SEL.select_fields(tables.pages(spark, sf_dir), CSS_FIELDS, mode="text")


@query("h13_xpath_fields")
def h13_xpath(spark, sf_dir):
    """XPath fields (raw HTML for element hits, as the scrapy path returns)."""
    return SEL.select_fields(tables.pages(spark, sf_dir), XPATH_FIELDS, mode="html")


@query("h14_x18_x19_selector_record")
def h14_record(spark, sf_dir):
    """H14 + X18 + X19: per-page selector record, body text length, success score, completeness."""
    r = SEL.selector_record(tables.pages(spark, sf_dir), CSS_FIELDS)
    return r.select(
        "page_id",
        F.length("body_text").alias("body_text_length"),
        F.round("success_score", 9).alias("success_score"),
        F.round("data_completeness", 9).alias("data_completeness"),
    )
