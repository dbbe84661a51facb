"""Domain reports (A10–A14, A20, A28, F9–F12, W9, W16, P4–P7) as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.functions import scoring as S

# Trending-topic words (A12) and the score per mention.
TOPIC_WORDS = ["example", "demo", "test", "social", "media", "content"]
TREND_PER_MENTION = 10
# Default metric alert threshold.
DEFAULT_THRESHOLD = 100.0


def health_summary(checks: DataFrame) -> DataFrame:
    """A13 (Q31): sites, healthy (score > 80), issue count, average of non-null
    non-zero times (0 if none), healthy percentage."""
    sc, rt = F.col("status_code"), F.col("response_time")
    scored = checks.select(
        S.health_score(sc, rt).alias("score"), F.size(S.issues(sc, rt)).alias("n_issues"), rt.alias("rt")
    )
    n = F.count(F.lit(1))
    healthy = F.count_if(F.col("score") > S.HEALTHY_ABOVE)
    return scored.agg(
        n.alias("total_sites"),
        healthy.alias("healthy_count"),
        F.sum("n_issues").cast("long").alias("issues_count"),
        F.coalesce(F.avg(F.when(F.col("rt").isNotNull() & (F.col("rt") != 0), F.col("rt"))), F.lit(0.0)).alias(
            "avg_response_time"
        ),
        F.when(n > 0, healthy / n * 100).otherwise(F.lit(0.0)).alias("health_percentage"),
    )


def research_stats(points: DataFrame, value: str = "value") -> DataFrame:
    """A10: n, mean, min, max, range of the values."""
    return points.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        (F.max(value) - F.min(value)).alias("range"),
    )


def research_breakdown(points: DataFrame, value: str = "value") -> DataFrame:
    """Count and average by category, count by source — one GROUPING SETS pass."""
    g = points.groupingSets([["category"], ["source"]], "category", "source").agg(
        F.count(F.lit(1)).alias("count"), F.avg(value).alias("average"), F.grouping("category").alias("_gc")
    )
    return g.select(
        F.when(F.col("_gc") == 0, F.lit("category")).otherwise(F.lit("source")).alias("breakdown"),
        F.when(F.col("_gc") == 0, F.col("category")).otherwise(F.col("source")).alias("key"),
        "count",
        F.when(F.col("_gc") == 0, F.col("average")).alias("average"),
    )


def trending_topics(posts: DataFrame, text_col: str, id_col: str, words: list[str] | None = None) -> DataFrame:
    """A12 + J6: posts mentioning each word (once per post), trend = 10 × mentions.

    No join: the fixed word list is a literal array, filtered per post by
    ``contains`` and exploded, so each post yields only the words it holds;
    counting is a distinct count per word (partial aggregation).
    """
    wl = F.array(*[F.lit(w) for w in (words or TOPIC_WORDS)])
    low = posts.select(F.col(id_col).alias("_id"), F.lower(F.col(text_col)).alias("_t"))
    hits = low.select("_id", F.explode(F.filter(wl, lambda w: F.col("_t").contains(F.lower(w)))).alias("topic"))
    return (
        hits.groupBy("topic")
        .agg(F.count_distinct("_id").alias("mentions"))
        .where(F.col("mentions") > 0)
        .withColumn("trend_score", F.col("mentions") * TREND_PER_MENTION)
    )


def metric_alerts(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """F11 + J9: metrics above their threshold (default 100)."""
    # Thresholds are a user table: Spark broadcasts it only when its measured
    # size is under the broadcast threshold.
    j = metrics.join(thresholds, "metric", "left")
    return j.withColumn("threshold", F.coalesce(F.col("threshold"), F.lit(DEFAULT_THRESHOLD))).where(
        F.col("value") > F.col("threshold")
    )


def service_health(services: DataFrame) -> DataFrame:
    """Healthy services / total, 'healthy' iff all, alert count."""
    return services.agg(
        F.count(F.lit(1)).alias("total_services"),
        F.count_if(F.col("status") == "healthy").alias("healthy_services"),
        F.when(F.bool_and(F.col("status") == "healthy"), F.lit("healthy")).otherwise(F.lit("degraded")).alias("overall"),
        F.count_if(F.col("status") != "healthy").alias("alerts"),
    )


def take_while_ok(pages: DataFrame, seq: str, order: str, failed: Column, has_next: Column) -> DataFrame:
    """Pages of each sequence in order until the first failure (exclusive)
    or the first page without a next page (inclusive)."""
    w = W.partitionBy(seq).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    stop_before = F.max(F.when(failed | ~has_next, 1).otherwise(0)).over(w)
    return pages.withColumn("_stop", F.coalesce(stop_before, F.lit(0))).where((F.col("_stop") == 0) & ~failed).drop("_stop")


def daily_rate_vs_week(attempts: DataFrame) -> DataFrame:
    """Daily success rate and its 7-day moving average (RANGE frame on day number)."""
    d = attempts.groupBy(F.to_date("ts").alias("day")).agg(
        F.avg(F.when(F.col("status") == "success", 1.0).otherwise(0.0)).alias("success_rate")
    )
    w = W.orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return d.withColumn("rate_7d", F.avg("success_rate").over(w))


def listings(df: DataFrame, key: str, arrays: dict[str, str], driver: str) -> DataFrame:
    """P5: zip parallel arrays into records, driven by ``driver``'s length, NULL-padded."""
    e = df.select(key, *arrays.values(), F.posexplode(F.col(driver)).alias("pos", "_drv"))
    return e.select(key, "pos", *[F.get(F.col(src), F.col("pos")).alias(name) for name, src in arrays.items()])


def product_record(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Nested product record (basic info, pricing, availability, media, metadata)."""
    from pagelake.functions import text as T

    return df.select(
        *(keep or []),
        F.struct(
            F.trim(F.coalesce(F.col("name"), F.lit(""))).alias("name"),
            F.trim(F.coalesce(F.col("brand"), F.lit(""))).alias("brand"),
        ).alias("basic_info"),
        F.struct(
            T.parse_price(F.col("price")).alias("current_price"),
            T.parse_price(F.col("original_price")).alias("original_price"),
            T.discount_pct(T.parse_price(F.col("price")), T.parse_price(F.col("original_price"))).alias("discount"),
            F.coalesce(F.col("currency"), F.lit("USD")).alias("currency"),
        ).alias("pricing"),
        F.struct(T.in_stock(F.col("availability")).alias("in_stock")).alias("availability"),
        F.struct(
            F.get(F.col("images"), 0).alias("main_image"),
            F.when(F.size("images") > 1, F.slice("images", 2, 1 << 20)).otherwise(F.array().cast("array<string>")).alias("gallery"),
        ).alias("media"),
        F.struct(F.col("url"), F.col("response_time")).alias("metadata"),
    )


def flatten(df: DataFrame, sep: str = "_", list_sep: str = ", ") -> DataFrame:
    """Nested structs to ``a_b_c`` columns, arrays joined with ``", "``.

    The walk is over the schema on the driver (plan time); every output column
    is a plain expression, so the job stays one projection.
    """
    from pyspark.sql import types as T

    cols = []

    def walk(expr, dtype, name):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(expr[f.name], f.dataType, f"{name}{sep}{f.name}" if name else f.name)
        elif isinstance(dtype, T.ArrayType):
            cols.append(F.array_join(F.transform(expr, lambda x: x.cast("string")), list_sep).alias(name))
        else:
            cols.append(expr.alias(name))

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.dataType, f.name)
    return df.select(*cols)
