"""Crawl-corpus graph analytics (G1–G5) as iterative DataFrame jobs.

The link graph is an edge frame ``(src, dst)`` of distinct URL pairs.  Each
iteration is a join of the current state with the edges on ``src`` followed by
an aggregation on ``dst`` (partial aggregation map-side, so a hot target URL is
pre-summed before the shuffle).  PageRank stores its edges once, bucketed by
(source, salt), so a round moves ranks to the edges and never the edges.  Iterative state is cut from its
lineage with a reliable ``checkpoint()`` into the session's checkpoint folder
every round, so the plan stays one iteration deep and a lost executor
recomputes one round, not all of them.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions import urls as U
from pagelake.operators import numbering
from pagelake.session import checkpoint_dir

# PageRank parameters (fixed values).
DAMPING = 0.85
ROUNDS = 10
# Edges of one source in a bucket, and the salts by which rows are spread before they meet a count.
EDGE_ROWS = 1_000_000
PRESALT = 16
# Tracking query parameters dropped when URLs are compared.
TRACKING_PREFIX = "utm_"


def url_edges(extracted: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)`` edges: page URL → resolved link without fragment."""
    return (
        extracted.select(F.col("url").alias("src"), F.explode("links").alias("dst"))
        .select("src", U.drop_fragment(F.col("dst")).alias("dst"))
        .where(F.col("dst") != "")
        .distinct()
    )


def materialise_edges(edges: DataFrame) -> DataFrame:
    """Checkpoint the edges once so the rounds never re-run the extraction.

    They are deliberately not pre-partitioned by ``src``: a pre-partitioned
    side cannot be split by AQE, and one page with a third of all links would
    then sit in one task every round.  Shuffled per round, a hot ``src`` is
    split by the skew-join rule instead."""
    return edges.checkpoint()


def salted_counts(df: DataFrame, key: str, spread: Column, target_rows: int) -> DataFrame:
    """``df`` with ``key_rows`` and ``salts = ceil(key_rows / target_rows)`` of each row's key.

    Rows are spread by a fixed salt of ``spread`` before they meet their key's
    count, which is repeated for each salt: a hot key joins in ``PRESALT``
    tasks.  A NULL key is a key.
    """
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("key_rows"))
    repeated = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PRESALT - 1).cast("long"))))
    rows = df.withColumn("_presalt", F.pmod(F.xxhash64(spread), F.lit(PRESALT)))
    joined = rows.join(repeated, (rows["_presalt"] == repeated["_salt"]) & rows[key].eqNullSafe(repeated["_key"]))
    salts = F.greatest(F.lit(1), F.ceil(F.col("key_rows") / F.lit(target_rows))).cast("long")
    return joined.withColumn("salts", salts).drop("_key", "_salt", "_presalt")


@contextmanager
def placed_edges(edges: DataFrame, target_rows: int = EDGE_ROWS):
    """The edges as a table bucketed and sorted by ``(src, salt)``, for the time of a job.

    A source with many links is split into ``salts`` buckets of about
    ``target_rows`` edges.  The files lie in the shared checkpoint folder; only
    the table's name is dropped at the end.
    """
    spark = edges.sparkSession
    salted = salted_counts(edges, "src", F.col("dst"), target_rows)
    salted = salted.select("src", F.pmod(F.xxhash64("dst"), F.col("salts")).alias("salt"), "dst", F.col("key_rows").alias("out_deg"), "salts")
    name = f"pagelake_edges_{uuid.uuid4().hex}"
    parts = numbering.shuffle_partitions(edges)
    laid = salted.repartition(parts, "src", "salt")
    laid.write.bucketBy(parts, "src", "salt").sortBy("src", "salt").option("path", f"{checkpoint_dir(spark)}/{name}").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def contributions(state: DataFrame, placed: DataFrame) -> DataFrame:
    """``(url, contrib)``: what each URL gets from the URLs that link to it.

    The rank of a source goes to each of its buckets; the edges stay where they are.
    """
    shares = state.where(F.col("out_deg") > 0).select(
        F.col("url").alias("src"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"),
        (F.col("rank") / F.col("out_deg")).alias("share"),
    )
    met = shares.join(placed.select("src", "salt", "dst"), ["src", "salt"])
    return met.groupBy(F.col("dst").alias("url")).agg(F.sum("share").alias("contrib"))


def in_degree(edges: DataFrame) -> DataFrame:
    """Number of distinct pages linking to each URL."""
    return edges.groupBy(F.col("dst").alias("url")).agg(F.count(F.lit(1)).alias("in_degree"))


def crawl_frontier(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """G1: breadth-first depth of every URL reachable from ``seeds(url)``.

    Level ``d`` is the set of targets of level ``d-1`` not seen before
    (``left_anti`` against everything seen).  The loop stops at ``max_depth``
    or when a level is empty; the emptiness test is a one-row action.
    """
    from functools import reduce

    edges = materialise_edges(edges)
    frontier = seeds.select("url").distinct().checkpoint()
    # Every level is checkpointed once; "seen" is the union of the levels, a
    # plan that grows by one scan per level (bounded by max_depth).
    levels = [frontier.withColumn("depth", F.lit(0))]
    for depth in range(1, max_depth + 1):
        seen = reduce(lambda a, b: a.unionByName(b), [lv.select("url") for lv in levels])
        nxt = (
            frontier.join(edges, frontier["url"] == edges["src"])
            .select(F.col("dst").alias("url"))
            .distinct()
            .join(seen, "url", "left_anti")
            .checkpoint()
        )
        if nxt.isEmpty():
            break
        levels.append(nxt.withColumn("depth", F.lit(depth)))
        frontier = nxt
    return reduce(lambda a, b: a.unionByName(b), levels)


def pagerank(edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, target_rows: int = EDGE_ROWS) -> DataFrame:
    """PageRank over the edge frame, fixed rounds, dangling mass spread evenly.

    Returns ``(url, rank, n_nodes)``; ranks sum to 1.  Node state is one row per
    URL, checkpointed every round; edges are shuffled once, before the rounds.
    """
    with placed_edges(edges, target_rows) as placed:
        sources = placed.groupBy(F.col("src").alias("url")).agg(F.max("out_deg").alias("out_deg"), F.max("salts").alias("salts"))
        nodes = sources.select("url").union(placed.select(F.col("dst").alias("url"))).distinct()
        n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
        state = (
            nodes.join(sources, "url", "left")
            .crossJoin(F.broadcast(n))
            .select("url", F.coalesce("out_deg", F.lit(0)).alias("out_deg"), F.coalesce("salts", F.lit(1)).alias("salts"), "n_nodes")
            .withColumn("rank", F.lit(1.0) / F.col("n_nodes"))
            .checkpoint()
        )
        for _ in range(rounds):
            dangling = state.where(F.col("out_deg") == 0).agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("dangling"))
            state = (
                state.join(contributions(state, placed), "url", "left")
                .crossJoin(F.broadcast(dangling))
                .select(
                    "url",
                    "out_deg",
                    "salts",
                    "n_nodes",
                    (
                        F.lit(1.0 - damping) / F.col("n_nodes")
                        + F.lit(damping) * (F.coalesce("contrib", F.lit(0.0)) + F.col("dangling") / F.col("n_nodes"))
                    ).alias("rank"),
                )
                .checkpoint()
            )
    return state.select("url", "rank", "n_nodes")


def url_key(url) -> Column:
    """Comparison key of a URL: host lower-cased without ``www.``, path
    without trailing slashes, query without tracking parameters, no scheme
    and no fragment."""
    u = U._col(url)
    host = F.regexp_replace(F.lower(U.netloc(u)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith(TRACKING_PREFIX))
    q = F.array_join(kept, "&")
    return F.concat(host, path, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def duplicate_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Every row with its URL key, the first id holding that key, and
    whether the row is a duplicate of it.

    Exact (no Bloom filter): one aggregation on the key (partial, so a key
    held by a third of the rows is pre-reduced per task) joined back on it.
    """
    keyed = df.select(id_col, url_col, url_key(F.col(url_col)).alias("url_key"))
    firsts = keyed.groupBy("url_key").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return keyed.join(firsts, "url_key").withColumn("is_duplicate", F.col(id_col) != F.col("first_id"))


def salted_by_domain(df: DataFrame, target_rows: int, domain_col: str = "domain", id_col: str = "page_id") -> DataFrame:
    """Partition rows by domain, splitting a heavy domain into
    ``ceil(rows / target_rows)`` salted buckets so no single task gets it all.

    The salt is the row id modulo the bucket count, so the assignment is
    deterministic.  Rows meet their domain's count by a salted join.
    """
    salted = salted_counts(df, domain_col, F.col(id_col), target_rows).withColumnsRenamed({"key_rows": "domain_rows", "salts": "buckets"})
    return salted.withColumn("salt", F.pmod(F.col(id_col), F.col("buckets"))).repartition(domain_col, "salt")
