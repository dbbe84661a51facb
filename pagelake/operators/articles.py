"""News-article records, all fields from one pass of the selector job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions import html as H
from pagelake.operators import selectors as SEL

# Selectors of an article page (fixed values).
ARTICLE_SELECTORS = {
    "headline": "h1.article-title",
    "author": ".author-name",
    "publish_date": "time[datetime]",
    "content": "div.article-content p",
    "tags": ".article-tags a",
    "related_articles": ".related-articles a[href]",
}


def article_records(pages: DataFrame, selectors: dict[str, str] | None = None) -> DataFrame:
    """One record a page: headline, author, date, content, tags, word count, related.

    ``content`` joins the paragraphs by a space, and the word count is that of
    the joined text; single fields are the first hit or empty, lists are empty
    without a hit.  A page without any of it gives an empty record.
    """
    rec = SEL.selector_lists(pages, selectors or ARTICLE_SELECTORS)
    hits = lambda name: F.coalesce(F.col(name), F.array().cast("array<string>"))
    first = lambda name: F.coalesce(F.get(hits(name), F.lit(0)), F.lit(""))
    joined = rec.select(
        "page_id",
        first("headline").alias("headline"),
        first("author").alias("author"),
        first("publish_date").alias("date"),
        F.array_join(hits("content"), " ").alias("content"),
        hits("tags").alias("tags"),
        hits("related_articles").alias("related"),
    )
    return joined.withColumn("word_count", H.word_count(F.col("content")))
