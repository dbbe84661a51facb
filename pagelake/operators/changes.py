"""Change detection between successive observations of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.operators.ordered import join_segments, segments


def changes(obs: DataFrame, key: str, order: list[str], fields: list[str], width_s: int | None = None) -> DataFrame:
    """For each observation after the first, the map field → 'old -> new'
    of the fields that changed; rows with no change are dropped.

    Split like the other ordered operators: rows are cut into segments
    of a key (``ordered.segments``), ``lag`` runs inside a segment, and
    the first row of a segment takes its predecessor from the last row of the
    key's previous non-empty segment (a per-segment ``max_by`` chained with a
    window over the small per-segment table).  No key lives in one task.
    """
    b = segments(obs, key, order, width_s)
    seg = W.partitionBy(key, "_bucket").orderBy(*order)
    rec = F.struct(*[F.col(f).alias(f) for f in fields])
    last = b.groupBy(key, "_bucket").agg(F.max_by(rec, F.struct(*order)).alias("_last"))
    carry = last.select(
        key, "_bucket", F.lag("_last").over(W.partitionBy(key).orderBy("_bucket")).alias("_carry")
    )
    j = join_segments(b.withColumn("_rn", F.row_number().over(seg)), carry, key)
    first_in_seg = F.col("_rn") == 1
    cur = {f: F.col(f).cast("string") for f in fields}
    prev = {
        f: F.when(first_in_seg, F.col("_carry")[f]).otherwise(F.lag(F.col(f)).over(seg)).cast("string")
        for f in fields
    }
    first = first_in_seg & F.col("_carry").isNull()
    entries = [
        F.when(prev[f] != cur[f], F.struct(F.lit(f).alias("k"), F.concat(prev[f], F.lit(" -> "), cur[f]).alias("v")))
        for f in fields
    ]
    out = j.withColumn("_first", first).withColumn("_e", F.filter(F.array(*entries), lambda e: e.isNotNull()))
    out = out.where(~F.col("_first") & (F.size("_e") > 0))
    return out.withColumn("changes", F.map_from_entries(F.transform("_e", lambda e: F.struct(e["k"], e["v"])))).drop(
        "_first", "_e", "_rn", "_carry", "_bucket"
    )
