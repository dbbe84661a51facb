"""Table sources (S1, S2, S11) and the ``scrape_results`` view.

``pages`` holds already-fetched pages; ``events`` stands in for the log of
fetch attempts (one attempt per event, mapped onto a page).  The stored-result
table ``scrape_results`` is derived from both: extraction runs once per page
(a narrow projection over the scan), and only the small extracted columns —
never the HTML — travel through the join with the attempts.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake import schemas
from pagelake.functions import html as H
from pagelake.functions import urls as U
from pagelake.session import configure

# Fixed values of the attempt stand-in (see FIXTURES.md §3).
METHODS = ["scrapy", "pydoll", "playwright"]
ERROR_CODES = [500, 429, 403, 404]  # by user_id mod 4 for `error` events
AS_OF = "2024-01-31 00:00:00"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Any driver table by name (parquet, schema from the file footer)."""
    configure(spark)
    return spark.read.parquet(table_path(sf_dir, name))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages(page_id, url, html)``."""
    return read(spark, sf_dir, "pages")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")


def attempts_from(events_df: DataFrame, pages_df: DataFrame) -> DataFrame:
    """One fetch attempt per event.

    The page of an attempt is ``event_id mod (number of pages)``; the page
    count is a one-row aggregate joined as a constant (a broadcast of one
    row, bounded by construction), and the page URL comes from an equi-join
    on ``page_id`` that Catalyst plans as a shuffle or broadcast join by size.
    """
    n_pages = pages_df.agg(F.count(F.lit(1)).alias("_n_pages"))
    page_urls = pages_df.select(F.col("page_id").alias("_page_id"), F.col("url"))
    method = F.element_at(F.array(*[F.lit(m) for m in METHODS]), (F.col("event_id") % 3 + 1).cast("int"))
    err_code = F.element_at(F.array(*[F.lit(c) for c in ERROR_CODES]), (F.col("user_id") % 4 + 1).cast("int"))
    is_error = F.col("event_type") == "error"
    base = events_df.crossJoin(F.broadcast(n_pages)).select(
        F.col("event_id").alias("attempt_id"),
        F.col("ts"),
        F.concat(F.lit("req"), (F.col("event_id") / 3).cast("long").cast("string")).alias("request_id"),
        (F.col("event_id") % F.col("_n_pages")).alias("page_id"),
        method.alias("method"),
        F.when(is_error, err_code).otherwise(F.lit(200)).alias("status_code"),
        F.when(is_error, F.lit("failed")).otherwise(F.lit("success")).alias("status"),
        (F.col("value") / 100).alias("response_time"),
        F.concat(F.lit("proxy"), F.col("user_id").cast("string")).alias("proxy_id"),
        F.col("user_id"),
        F.col("event_type"),
    )
    return base.join(page_urls, base["page_id"] == page_urls["_page_id"], "inner").drop("_page_id")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts_from(events(spark, sf_dir), pages(spark, sf_dir))


def extracted_basic(pages_df: DataFrame) -> DataFrame:
    """Per-page fields the stored result needs."""
    html, url = F.col("html"), F.col("url")
    return pages_df.select(
        F.col("page_id"),
        H.title(html).alias("title"),
        H.meta_description(html).alias("meta_description"),
        H.headings(html).alias("headings"),
        H.content_length(html).alias("content_length"),
        H.links(html, url).alias("links"),
        H.images(html, url).alias("images"),
    )


def scrape_results_from(attempts_df: DataFrame, pages_df: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """The stored-result table: one row per attempt (K2 schema).

    Failed attempts keep no extraction: title/content_length NULL, counts 0,
    ``error_message = 'HTTP <code>'``, as the failure record of one method.
    """
    ex = extracted if extracted is not None else extracted_basic(pages_df)
    j = attempts_df.join(ex, "page_id", "left")
    ok = F.col("status") == "success"
    data_json = F.to_json(F.struct(F.col("title"), F.col("meta_description"), F.col("headings")))
    return j.select(
        F.col("attempt_id").alias("id"),
        F.col("url"),
        U.netloc(F.col("url")).alias("domain"),
        F.col("method").alias("method_used"),
        F.col("status"),
        F.col("status_code"),
        F.col("response_time"),
        F.col("ts").alias("timestamp"),
        F.when(ok, F.col("title")).alias("title"),
        F.when(ok, F.col("content_length")).alias("content_length"),
        F.when(ok, F.size("links")).otherwise(F.lit(0)).alias("links_count"),
        F.when(ok, F.size("images")).otherwise(F.lit(0)).alias("images_count"),
        F.when(ok, data_json).otherwise(F.lit("{}")).alias("data_json"),
        F.when(ok, F.col("links")).otherwise(F.array().cast("array<string>")).alias("links"),
        F.when(ok, F.col("images")).otherwise(F.array().cast("array<string>")).alias("images"),
        F.when(~ok, F.concat(F.lit("HTTP "), F.col("status_code").cast("string"))).alias("error_message"),
        F.col("ts").alias("created_at"),
        F.col("request_id"),
        F.col("proxy_id"),
    )


def scrape_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full result table (derived view over pages + attempts)."""
    p = pages(spark, sf_dir)
    return scrape_results_from(attempts_from(events(spark, sf_dir), p), p)


def stored_results(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    """S1 on a written store: the day-partitioned table K1 appends to.

    ``since`` / ``until`` (dates or date strings) become filters on the
    ``date`` partition column, so only those day folders are listed and read
    (``PartitionFilters`` in the scan); the timestamp filter stays exact.
    """
    configure(spark)
    df = spark.read.parquet(path)
    if since is not None:
        df = df.where((F.col("date") >= F.to_date(F.lit(str(since)))) & (F.col("timestamp") >= F.lit(str(since)).cast("timestamp_ntz")))
    if until is not None:
        df = df.where((F.col("date") <= F.to_date(F.lit(str(until)))) & (F.col("timestamp") < F.lit(str(until)).cast("timestamp_ntz")))
    return df


def as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


__all__ = [
    "schemas",
    "read",
    "pages",
    "events",
    "attempts",
    "attempts_from",
    "extracted_basic",
    "scrape_results",
    "scrape_results_from",
    "stored_results",
    "as_of",
]
