"""File sources and request frames (S3–S5, S8–S10): saved JSON results, CSV
read-back, JSON search with missing-key-passes, seed requests, paged URLs.

Files are read by Spark's own readers, so a directory of millions of files is
split across tasks; nothing is read on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S3: saved JSON results (one object per file, possibly pretty-printed)."""
    reader = spark.read.option("multiLine", True)
    if schema:
        reader = reader.schema(schema)
    return reader.json(path)


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """S4 input: each file's whole text kept as one JSON document string, so
    keys that only some files carry are not lost to a merged schema."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.col("value").alias("doc")
    )


def search_json(df: DataFrame, json_col: str, criteria: dict[str, object]) -> DataFrame:
    """Keep rows whose JSON object has ``key == value`` for every
    criterion; a **missing** key passes, an explicit null is present and
    unequal."""
    keys = F.json_object_keys(F.col(json_col))
    cond = F.lit(True)
    for k, v in criteria.items():
        present = F.coalesce(F.array_contains(keys, F.lit(k)), F.lit(False))
        value = F.get_json_object(F.col(json_col), f"$.{k}")
        cond = cond & (~present | F.coalesce(value == F.lit(str(v)), F.lit(False)))
    return df.where(cond)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header back to a frame (explicit schema when given)."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


# Server-list defaults (fixed values).
DEFAULT_PORT = 1080
DEFAULT_LOAD, DEFAULT_LATENCY = 0.0, 0.0
FALLBACK_LOAD, FALLBACK_LATENCY = 0.5, 100.0


def read_server_list(spark: SparkSession, path: str) -> DataFrame:
    """Server list JSON (array or one object per line) with defaults for
    missing port, load and latency."""
    raw = spark.read.option("multiLine", True).schema(
        "name string, hostname string, port int, country string, load double, latency double"
    ).json(path)
    return raw.select(
        "name",
        "hostname",
        F.coalesce("port", F.lit(DEFAULT_PORT)).alias("port"),
        "country",
        F.coalesce("load", F.lit(DEFAULT_LOAD)).alias("load"),
        F.coalesce("latency", F.lit(DEFAULT_LATENCY)).alias("latency"),
    )


def fallback_servers(spark: SparkSession, names: list[tuple[str, str, str]]) -> DataFrame:
    """S8 fallback: a given (name, hostname, country) list with load 0.5 and latency 100."""
    df = spark.createDataFrame(names, "name string, hostname string, country string")
    return df.select(
        "name",
        "hostname",
        F.lit(DEFAULT_PORT).alias("port"),
        "country",
        F.lit(FALLBACK_LOAD).alias("load"),
        F.lit(FALLBACK_LATENCY).alias("latency"),
    )


def seed_requests(seeds: DataFrame, pages: DataFrame) -> DataFrame:
    """S9 + J1: seed URLs matched to fetched pages (left join on url): a seed
    with a page is ``fetched``, otherwise ``pending``."""
    p = pages.select("url", "page_id")
    j = seeds.select("url").join(p, "url", "left")
    return j.withColumn("state", F.when(F.col("page_id").isNull(), F.lit("pending")).otherwise(F.lit("fetched")))


def paged_urls(pages: DataFrame, max_pages: int = 10) -> DataFrame:
    """``base?page=N`` for N = 1..max_pages (plain concatenation)."""
    return pages.select(
        "page_id", F.explode(F.sequence(F.lit(1), F.lit(max_pages))).alias("page"), "url"
    ).select("page_id", "page", F.concat(F.col("url"), F.lit("?page="), F.col("page").cast("string")).alias("paged_url"))
