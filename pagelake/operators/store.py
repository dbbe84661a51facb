"""Queries over the stored-result table.

All take the ``scrape_results`` DataFrame and return a DataFrame.  Sorted
limits plan as ``TakeOrderedAndProject`` (a per-partition top-k and a merge
of k rows each, never a full sort); filters on ``timestamp``/``domain``
reach the Parquet scan of a stored table as pushed filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.functions import text as T
from pagelake.operators import numbering

SUMMARY_COLUMNS = ["id", "url", "domain", "method_used", "status", "timestamp", "title"]
MAX_PAGE = 1000
# Relevance weights of a search hit: title, URL, stored data text.
SEARCH_WEIGHTS = (10, 5, 1)


def newest_first() -> list[Column]:
    """Total order of L1: newest first, id as tiebreak."""
    return [F.col("timestamp").desc(), F.col("id").desc()]


def list_all(results: DataFrame, limit: int = 50) -> DataFrame:
    """P1 + L1: seven summary columns of the newest ``limit`` rows."""
    return results.select(*SUMMARY_COLUMNS).orderBy(*newest_first()).limit(limit)


def _like_any(col: Column, term: str) -> Column:
    # SQLite LIKE: case-insensitive for ASCII; '%' and '_' in the term stay wildcards.
    return col.ilike(f"%{term}%")


def by_url(results: DataFrame, url: str) -> DataFrame:
    """URL equal to or containing ``url``, newest first (full rows)."""
    return results.where((F.col("url") == url) | _like_any(F.col("url"), url)).orderBy(*newest_first())


def by_domain(results: DataFrame, domain: str, limit: int = 100) -> DataFrame:
    """domain containing ``domain`` (Q5), newest ``limit``."""
    return results.where(_like_any(F.col("domain"), domain)).orderBy(*newest_first()).limit(limit)


def recent(results: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """rows at or after ``as_of - hours``, newest first."""
    cutoff = as_of - F.make_dt_interval(hours=F.lit(hours))
    return results.where(F.col("timestamp") >= cutoff).orderBy(*newest_first())


def list_page(results: DataFrame, limit: int = 100, offset: int = 0, status: str | None = None, domain: str | None = None) -> DataFrame:
    """F4 + L2: optional status / domain filters, one LIMIT/OFFSET page.

    ``limit`` must be 1..1000 and ``offset`` >= 0, as the service checks.
    For deep pages prefer ``keyset_page`` (no offset scan).
    """
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError("limit must be in 1..1000 and offset >= 0")
    df = results
    if status:
        df = df.where(F.col("status") == status)
    if domain:
        df = df.where(_like_any(F.col("domain"), domain))
    return df.orderBy(*newest_first()).offset(offset).limit(limit)


def keyset_page(results: DataFrame, after_ts, after_id: int, limit: int = 100) -> DataFrame:
    """L2, deep-paging form: rows strictly older than the (ts, id) cursor."""
    ts = F.lit(after_ts).cast("timestamp_ntz")
    older = (F.col("timestamp") < ts) | ((F.col("timestamp") == ts) & (F.col("id") < after_id))
    return results.where(older).orderBy(*newest_first()).limit(limit)


def by_ids(results: DataFrame, ids: DataFrame) -> DataFrame:
    """F5, bulk form: rows whose id is in ``ids(id)`` (left semi join)."""
    return results.join(ids.select("id").distinct(), "id", "left_semi")


def split_outcomes(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """successes as (url, title, timestamp), failures as (url, error, status_code)."""
    ok = results.where(F.col("status") == "success").select("url", "title", "timestamp")
    bad = results.where(F.col("status") != "success").select(
        "url", F.col("error_message").alias("error"), "status_code"
    )
    return ok, bad


def json_field_equals(results: DataFrame, field: str, value: str, limit: int = 100) -> DataFrame:
    """F8: ``data ->> field = value``, newest ``limit``."""
    v = F.get_json_object(F.col("data_json"), f"$.{field}")
    return results.where(v == value).orderBy(*newest_first()).limit(limit)


def search(results: DataFrame, term: str, limit: int = 50, rank_before_limit: bool = False) -> DataFrame:
    """X3 + L4: rows whose title, data text or URL contains ``term``.

    Relevance = 10 (title) + 5 (URL) + 1 (data text), case-insensitive.
    Default keeps the reference's order of work (Q1): the newest ``limit``
    matches are taken first, then re-ranked by relevance (stable: newest
    first among equal scores).  ``rank_before_limit=True`` ranks all matches.
    """
    t = term.lower()
    wt, wu, wd = SEARCH_WEIGHTS
    hit = _like_any(F.col("title"), term) | _like_any(F.col("data_json"), term) | _like_any(F.col("url"), term)
    score = (
        F.when(F.lower(F.coalesce(F.col("title"), F.lit(""))).contains(t), wt).otherwise(0)
        + F.when(F.lower(F.coalesce(F.col("url"), F.lit(""))).contains(t), wu).otherwise(0)
        + F.when(F.lower(F.coalesce(F.col("data_json"), F.lit(""))).contains(t), wd).otherwise(0)
    )
    matches = results.where(hit).withColumn("relevance_score", score)
    if rank_before_limit:
        return matches.orderBy(F.col("relevance_score").desc(), *newest_first()).limit(limit)
    top = matches.orderBy(*newest_first()).limit(limit)
    return top.orderBy(F.col("relevance_score").desc(), *newest_first())


def highlight_titles(results: DataFrame, term: str) -> DataFrame:
    """Title with the literal term wrapped in ``**``."""
    return results.withColumn("title_highlighted", T.highlight(F.col("title"), term))


def keep_after(results: DataFrame, as_of: Column, days: int = 30) -> tuple[DataFrame, Column]:
    """K3: rows to keep after deleting those older than ``as_of - days``.

    Returns (kept rows, the cutoff).  ``sinks.expire`` writes the kept rows
    back, replacing only the partitions that change.
    """
    cutoff = as_of - F.make_dt_interval(days=F.lit(days))
    return results.where(F.col("timestamp") >= cutoff), cutoff


def delete_ids(results: DataFrame, ids: DataFrame) -> DataFrame:
    """K4 (bulk): all rows except those whose id is listed (left anti join)."""
    return results.join(ids.select("id").distinct(), "id", "left_anti")


def latest_per_key_agg(df: DataFrame, key: str, ts: str, tiebreak: str) -> DataFrame:
    """W6, skew-safe: ``max_by`` of the whole row by (ts, tiebreak).

    A hash aggregate with a partial step before the shuffle, so a hot key
    sends one partial row per map task, not all of its rows.
    """
    others = [c for c in df.columns if c != key]
    packed = F.struct(*[F.col(c) for c in others])
    order_key = F.struct(F.col(ts), F.col(tiebreak))
    return df.groupBy(key).agg(F.max_by(packed, order_key).alias("_r")).select(key, "_r.*")


def numbered(
    df: DataFrame, order: list[Column], group: list[str] | None = None, name: str = "number", total: str | None = None
) -> DataFrame:
    """1-based number in a total order, optionally restarting per group.

    With ``total`` the number of rows (of the group) is added under that name.

    A ``row_number`` window would put a whole group (or, without a group,
    the whole table) in one task.  Here the rows are range-partitioned and
    sorted by ``(group, order)`` once and saved with their partition number
    and position (``numbering.positioned``).  Both the counts and the numbers
    derive from that one saved sort, so they cannot disagree.  A group is
    contiguous in the sort, so the per-(partition, group) count table has at
    most partitions + groups rows; without a group it is bounded by the
    partition count and broadcast, with one it is joined as Spark sizes it.
    """
    g = list(group or [])
    pos = numbering.positioned(df, [F.col(c).asc_nulls_first() for c in g] + list(order))
    counts = pos.groupBy("_pid", *g).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = (W.partitionBy(*g) if g else W).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("_pid").alias("_opid"), *[F.col(c).alias(f"_o_{c}") for c in g],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), "_first",
        F.sum("_n").over(W.partitionBy(*g)).alias("_total"),
    )
    same = F.col("_pid") == F.col("_opid")
    for c in g:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    joined = pos.join(offsets if g else F.broadcast(offsets), same)
    out = joined.withColumn(name, F.col("_off") + (F.col("_pos") - F.col("_first")) + 1)
    return out.select(*df.columns, name, *([F.col("_total").alias(total)] if total else []))


def to_record(results: DataFrame) -> DataFrame:
    """Parsed JSON columns and a null-free JSON form of each row."""
    parsed = results.withColumn("data", F.try_parse_json(F.col("data_json")))
    return parsed.withColumn("record_json", F.to_json(F.struct(*[F.col(c) for c in results.columns if c != "data_json"])))
