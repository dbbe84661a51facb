"""Registered queries over the written, day-partitioned store.

Each writes the store once from the given tables and then reads the store only:
filters on the day prune folders, others reach the Parquet scan, and no page is
extracted again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagelake.operators import store as ST
from pagelake.plans import sqlfrag as Q
from pagelake.plans.registry import query
from pagelake.session import checkpoint_dir
from pagelake.sinks import writers as K
from pagelake.sources import tables

SINCE, UNTIL = "2024-01-10", "2024-01-17"


def stored(spark, sf_dir) -> str:
    """All results, appended to a new store; its path."""
    path = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    K.append_results(tables.scrape_results(spark, sf_dir), path)
    return path


IN_RANGE = f"timestamp >= TIMESTAMP '{SINCE}' AND timestamp < TIMESTAMP '{UNTIL}'"


@query("s1_stored_week", Q.with_results(f"SELECT id, url, status, title, links_count FROM scrape_results WHERE {IN_RANGE}"))
def s1_week(spark, sf_dir):
    """A week of stored results, by day folders."""
    r = tables.stored_results(spark, stored(spark, sf_dir), SINCE, UNTIL)
    return r.select("id", "url", "status", "title", "links_count")


@query(
    "a2_stored_methods",
    Q.with_results(
        f"""SELECT method_used, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS successful, round(avg(response_time), 9) AS mean_response_time
FROM scrape_results WHERE {IN_RANGE} GROUP BY method_used"""
    ),
)
def a2_methods(spark, sf_dir):
    """A2: results, successes and mean time per method over a week of the store."""
    r = tables.stored_results(spark, stored(spark, sf_dir), SINCE, UNTIL)
    return r.groupBy("method_used").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.round(F.avg("response_time"), 9).alias("mean_response_time"),
    )


@query(
    "f8_stored_field",
    Q.with_results(
        """SELECT id, title FROM scrape_results
WHERE json_extract_string(data_json, '$.title') = (SELECT max(title) FROM scrape_results) ORDER BY timestamp DESC, id DESC LIMIT 100"""
    ),
)
def f8_field(spark, sf_dir):
    """F8: stored rows whose JSON data has title = the largest stored title; newest 100."""
    r = tables.stored_results(spark, stored(spark, sf_dir))
    target = r.agg(F.max("title")).first()[0]
    return ST.json_field_equals(r, "title", target).select("id", "title")


@query(
    "k2_stored_table",
    Q.with_results("SELECT CAST(timestamp AS DATE) AS date, count(*) AS results, CAST(sum(links_count) AS BIGINT) AS links FROM scrape_results GROUP BY 1"),
)
def k2_table(spark, sf_dir):
    """K2 + A4: the declared table over the store, results and links per day."""
    name = f"scrape_results_{uuid.uuid4().hex}"
    path = stored(spark, sf_dir)
    K.create_results_table(spark, name, path)
    spark.catalog.recoverPartitions(name)
    return spark.table(name).groupBy("date").agg(F.count(F.lit(1)).alias("results"), F.sum("links_count").alias("links"))
