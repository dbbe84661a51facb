"""Record shapes and rules of requests, proxies and profiles (P3, P7, F16, U-d, X32, X36)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the models.
PROXY_TYPES = ["http", "https", "socks4", "socks5", "vpn"]
PROXY_STATUSES = ["active", "inactive", "blocked", "failed", "rate_limited"]
PORT_RANGE = (1, 65535)
RECENT_POSTS = 10


def processed_records(results: DataFrame) -> DataFrame:
    """One record a result: a success with its title, a failure with its error."""
    ok = F.col("status") == "success"
    return results.select(
        "id",
        F.when(ok, "processed").otherwise("failed").alias("kind"),
        "url",
        F.when(ok, F.col("title")).alias("title"),
        F.when(ok, F.col("timestamp")).alias("timestamp"),
        F.when(~ok, F.col("error_message")).alias("error"),
    )


def social_profiles(people: DataFrame, posts: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Profile of each row of ``people`` with its first ten ``posts`` (key, post).

    Spark keeps ten posts a key and task before the shuffle, so a key with very
    many posts is no hot one.
    """
    first = posts.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_n") <= RECENT_POSTS)
    recent = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", "post"))).alias("_r"))
    counts = posts.groupBy(key).agg(F.count(F.lit(1)).alias("posts"))
    both = people.join(counts, key, "left").join(recent, key, "left")
    return both.select(
        *[c for c in people.columns if c != "verified_badge"],
        F.coalesce("posts", F.lit(0)).alias("posts"),
        F.col("verified_badge").isNotNull().alias("is_verified"),
        F.coalesce(F.transform("_r", lambda p: p["post"]), F.array().cast("array<string>")).alias("recent_posts"),
    )


def proxy_violations(port: str = "port", scores: tuple[str, ...] = ("health_score", "success_rate"), kind: str = "proxy_type", status: str = "status") -> Column:
    """F16: rules that a proxy row breaks (port range, scores in 0..1, known type and status).

    A null value breaks its rule.
    """
    lo, hi = PORT_RANGE
    bad = lambda rule: ~F.coalesce(rule, F.lit(False))
    rules = [F.when(bad(F.col(port).between(lo, hi)), F.lit(f"{port} must be between {lo} and {hi}"))]
    rules += [F.when(bad(F.col(s).between(0.0, 1.0)), F.lit(f"{s} must be between 0.0 and 1.0")) for s in scores]
    rules += [F.when(bad(F.col(c).isin(*known)), F.lit(f"{c} is not known")) for c, known in ((kind, PROXY_TYPES), (status, PROXY_STATUSES))]
    return F.array_compact(F.array(*rules))


def replace_vpn(proxies: DataFrame, new: DataFrame, provider: str = "pia") -> DataFrame:
    """U-d: every pool without its proxies of ``provider`` but with those of ``new``.

    ``new`` (proxy_id, provider) is joined to the distinct pools: new proxies
    are few, pools are names.
    """
    pools = proxies.select("pool_name").distinct()
    added = pools.crossJoin(F.broadcast(new.limit(1)))  # one proxy takes over
    kept = proxies.where(~F.col("provider").eqNullSafe(F.lit(provider)))
    return kept.unionByName(added, allowMissingColumns=True)


def exhausted_requests(gaps: DataFrame, max_retries: int) -> DataFrame:
    """Per request the attempts made, and whether the last allowed one failed too."""
    last = F.max_by("failed", "attempt_number")
    g = gaps.groupBy("request_id").agg(F.max("attempt_number").alias("attempts"), last.alias("_failed"))
    return g.select("request_id", "attempts", (F.col("_failed") & (F.col("attempts") > max_retries)).alias("exhausted"))


def redirected(url: str = "url", final_url: str = "final_url") -> Column:
    """The final URL is another one."""
    return ~F.col(final_url).eqNullSafe(F.col(url))
