"""Sinks and exports (K1–K17, G6): every writer is a DataFrame write, partitioned
so that later reads prune by day, and every export frame is built with
columns, not by looping over rows on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake import schemas
from pagelake.functions import urls as U
from pagelake.operators.numbering import saved

# Export limits and names (fixed values).
MAX_EXPORT_KEYS = 500
XML_ROOT_TAG, XML_ROW_TAG = "scrape_results", "result"
CACHE_TTL_S = 3600
RECENT_KEYS = 100
MESSAGE_TYPE = "scrape_result"


def with_day(results: DataFrame) -> DataFrame:
    return results.withColumn("date", F.to_date("timestamp"))


def check_required(results: DataFrame, required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """F16 before K1: rows with every NOT NULL column set, and the rest
    (quarantine) with the list of violated rules."""
    req = required or schemas.SCRAPE_RESULTS_REQUIRED
    violations = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in req]))
    tagged = results.withColumn("_violations", violations)
    good = tagged.where(F.size("_violations") == 0).drop("_violations")
    bad = tagged.where(F.size("_violations") > 0).withColumnRenamed("_violations", "violations")
    return good, bad


def create_results_table(spark: SparkSession, name: str, location: str) -> None:
    """K2: the stored-result table, Parquet, partitioned by day."""
    spark.sql(
        f"""CREATE TABLE IF NOT EXISTS {name} (
  id BIGINT, url STRING, domain STRING, method_used STRING, status STRING, status_code INT,
  response_time DOUBLE, timestamp TIMESTAMP_NTZ, title STRING, content_length INT, links_count INT,
  images_count INT, data_json STRING, links ARRAY<STRING>, images ARRAY<STRING>, error_message STRING,
  created_at TIMESTAMP_NTZ, date DATE)
USING parquet PARTITIONED BY (date) LOCATION '{location}'"""
    )


def append_results(results: DataFrame, path: str) -> DataFrame:
    """K1: append valid rows to the day-partitioned store; returns the quarantine."""
    good, bad = check_required(results)
    with_day(good).write.mode("append").partitionBy("date").parquet(path)
    return bad


def expire(spark: SparkSession, path: str, as_of: Column, days: int = 30) -> int:
    """K3: delete rows older than ``as_of - days``; returns the deleted count.

    Folders of whole older days are deleted.  Of the boundary day the rows to
    keep are rewritten, or its folder is deleted if there are none.  Newer days
    are not read or written, and no session setting changes.
    """
    cutoff = as_of - F.make_dt_interval(days=F.lit(days))
    stored = spark.read.parquet(path)
    old = stored.where(F.col("date") <= F.to_date(cutoff))
    day = spark.range(1).select(F.to_date(cutoff).alias("d")).first().d
    counts = old.groupBy("date").agg(F.count_if(F.col("timestamp") < cutoff).alias("gone"), F.count(F.lit(1)).alias("n")).collect()
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in counts:  # one row a stored day
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"date={r.date}")
        if r.gone == r.n:
            fs.delete(folder, True)
        elif r.gone and r.date == day:
            kept = saved(old.where((F.col("date") == F.lit(day)) & (F.col("timestamp") >= cutoff)).drop("date"), "boundary-day")
            kept.write.mode("overwrite").parquet(folder.toString())
    spark.catalog.refreshByPath(path)
    return sum(r.gone for r in counts)


def flatten_json_columns(results: DataFrame, json_cols: list[str], max_keys: int = MAX_EXPORT_KEYS) -> DataFrame:
    """``x_json`` object → ``x_<key>`` string columns (nested values as
    JSON text); the key set comes from one distinct-keys job and is capped
    with an error (never silently truncated)."""
    out = results
    for c in json_cols:
        keys_df = results.select(F.explode(F.json_object_keys(F.col(c))).alias("k")).distinct()
        keys = [r.k for r in keys_df.limit(max_keys + 1).collect()]
        if len(keys) > max_keys:
            raise ValueError(f"{c}: more than {max_keys} distinct keys; export them in long form instead")
        prefix = c[: -len("_json")] if c.endswith("_json") else c
        for k in sorted(keys):
            out = out.withColumn(f"{prefix}_{k}", F.get_json_object(F.col(c), f"$.{k}"))
        out = out.drop(c)
    return out


def json_fields(df: DataFrame, json_col: str, id_col: str = "id") -> DataFrame:
    """U1 long form: one ``(id, key, value)`` row per top-level key of a JSON
    object column; nested values stay JSON text, bad JSON gives no rows."""
    kv = F.from_json(F.col(json_col), "map<string, string>")
    return df.select(id_col, F.explode(kv).alias("key", "value"))


# Times keep their microseconds; reading them back takes the same formats.
CSV_OPTIONS = {
    "header": "true",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; array/map columns as JSON text."""
    cols = [
        F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*cols).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def export_json(results: DataFrame, path: str) -> None:
    """K6: JSON lines with the parsed data in place of its text."""
    results.withColumn("data", F.try_parse_json(F.col("data_json"))).drop("data_json").write.mode("overwrite").json(path)


def successes_csv_frame(results: DataFrame) -> DataFrame:
    """K7: successful results, one column per data key, plus _url, _timestamp, _response_time."""
    ok = results.where(F.col("status") == "success")
    flat = flatten_json_columns(ok.select("data_json", "url", "timestamp", "response_time"), ["data_json"])
    return flat.withColumnRenamed("url", "_url").withColumnRenamed("timestamp", "_timestamp").withColumnRenamed(
        "response_time", "_response_time"
    )


def xml_data(data_json: Column) -> Column:
    """K9: a JSON object as a map that Spark's XML writer turns into one element a key.

    A list becomes ``<item>`` elements, any other value the element's text;
    nulls are left out.  Keys are made into element names: what a name cannot
    hold becomes ``_``.
    """
    fields = F.map_filter(F.from_json(data_json, "map<string, string>"), lambda k, v: v.isNotNull())
    name = lambda k, v: F.regexp_replace(F.regexp_replace(k, r"[^\p{L}\p{N}_.\-]", "_"), r"^([^\p{L}_]|$)", "_$1")

    def element(k, v):
        listed = v.startswith("[")
        return F.struct(
            F.when(~listed, v).alias("_VALUE"), F.when(listed, F.from_json(v, "array<string>")).alias("item")
        )

    return F.transform_keys(F.transform_values(fields, element), name)


def export_xml(results: DataFrame, path: str) -> None:
    """K9: ``<scrape_results><result>`` with url, timestamp and ``data/<key>``, successes only."""
    ok = results.where(F.col("status") == "success").select(
        "url", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), xml_data(F.col("data_json")).alias("data")
    )
    # No name begins with @, so no key is taken for an attribute.
    w = ok.write.mode("overwrite").format("xml").option("rootTag", XML_ROOT_TAG).option("rowTag", XML_ROW_TAG)
    w.option("attributePrefix", "@").save(path)


def markdown_lines(results: DataFrame) -> DataFrame:
    """K10 + W10: one markdown block per result, numbered newest first."""
    from pagelake.operators import store as ST

    n = ST.numbered(results, ST.newest_first())
    return n.select(
        "number",
        F.format_string(
            "## %d. %s\n\n- URL: %s\n- Status: %s\n- Time: %s\n",
            F.col("number"),
            F.coalesce(F.col("title"), F.lit("(no title)")),
            F.col("url"),
            F.col("status"),
            F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"),
        ).alias("markdown"),
    )


def template_lines(results: DataFrame, template: str, columns: list[str]) -> DataFrame:
    """A user ``printf``-style template filled per row."""
    return results.select(F.format_string(template, *[F.col(c) for c in columns]).alias("line"))


def result_files(results: DataFrame) -> DataFrame:
    """Per-result file name ``domain_YYYYmmdd_HHMMSS`` and its day."""
    return results.withColumn("file_name", U.file_stem(F.col("domain"), F.col("timestamp"))).withColumn(
        "day", F.to_date("timestamp")
    )


def write_result_files(results: DataFrame, path: str) -> None:
    """JSON files partitioned by domain and day."""
    result_files(results).write.mode("overwrite").partitionBy("domain", "day").json(path)


def cache_entries(results: DataFrame, ttl_s: int = CACHE_TTL_S) -> DataFrame:
    """Latest successful result per URL with its expiry time."""
    from pagelake.operators import store as ST

    ok = results.where(F.col("status") == "success")
    latest = ST.latest_per_key_agg(ok.select("url", "id", "timestamp", "title"), "url", "timestamp", "id")
    return latest.withColumn("expires_at", F.col("timestamp") + F.make_dt_interval(secs=F.lit(ttl_s)))


def recent_keys(entries: DataFrame, n: int = RECENT_KEYS) -> DataFrame:
    """K13 + L7: the ``n`` most recently cached keys."""
    return entries.orderBy(F.col("timestamp").desc(), F.col("url")).limit(n).select("url")


def unexpired(requests: DataFrame, entries: DataFrame, as_of: Column) -> DataFrame:
    """Requests whose URL has an unexpired cache entry (left semi join)."""
    live = entries.where(F.col("expires_at") > as_of).select("url")
    return requests.join(live, "url", "left_semi")


def glob_to_regex(pattern: str) -> str:
    """Redis-style glob (``*``, ``?``, ``[...]``) to an anchored regex."""
    out, i = ["^"], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            j = pattern.find("]", i)
            if j < 0:
                out.append(re.escape(ch))
            else:
                out.append("[" + pattern[i + 1 : j].replace("\\", "\\\\") + "]")
                i = j
        else:
            out.append(re.escape(ch))
        i += 1
    out.append("$")
    return "".join(out)


def invalidate(entries: DataFrame, pattern: str, key: str = "url") -> DataFrame:
    """Entries left after removing keys that match the glob."""
    return entries.where(~F.col(key).rlike(glob_to_regex(pattern)))


def messages(results: DataFrame) -> DataFrame:
    """One JSON message per result."""
    msg = F.struct(
        F.lit(MESSAGE_TYPE).alias("type"),
        F.col("url"),
        F.col("status"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.struct(
            F.col("response_time"), F.col("links_count").alias("links_found"), F.col("images_count").alias("images_found")
        ).alias("metrics"),
    )
    return results.select("id", F.to_json(msg).alias("message"))


def workbook(results: DataFrame) -> dict[str, DataFrame]:
    """K8: Main (successes), Links (internal/external), Images and Summary tables."""
    from pagelake.operators import stats as A

    main = results.where(F.col("status") == "success").select(
        "id", "url", F.coalesce("title", F.lit("")).alias("title"), "timestamp", "response_time", F.coalesce("method_used", F.lit("")).alias("method")
    )
    links = results.select("id", "url", F.explode("links").alias("link")).withColumn(
        "type", F.when(F.col("link").contains(U.netloc(F.col("url"))), "internal").otherwise("external")
    )
    images = results.select("id", "url", F.explode("images").alias("image"))
    return {"main": main, "links": links, "images": images, "summary": A.export_summary(results)}


WORKBOOK_COLUMNS = ["id", "url", "title", "timestamp", "response_time", "method_used", "status", "links", "images"]


def write_workbook(results: DataFrame, path: str) -> None:
    """K8: the four tables as CSV datasets, from one pass over the results."""
    once = saved(results.select(*WORKBOOK_COLUMNS), "workbook")
    for name, df in workbook(once).items():
        export_csv(df, f"{path}/{name}")


def dead_letter(results: DataFrame, path: str) -> None:
    """Failed records to their own dataset."""
    with_day(results.where(F.col("status") != "success")).write.mode("append").partitionBy("date").parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None) -> None:
    """Insert into a relational store (needs the JDBC driver on the classpath)."""
    df.write.mode("append").jdbc(url, table, properties=properties or {})
