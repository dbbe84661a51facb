"""Distributed numbering and reliable intermediate tables.

``saved`` cuts a lineage by writing a table into the shared checkpoint
folder; ``global_rank`` numbers the rows of a frame in a total order with one
range sort.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.session import checkpoint_dir

# monotonically_increasing_id() = partition id << 33 | position in the partition.
POSITION_BITS = 33


def shuffle_partitions(df: DataFrame) -> int:
    """Partition count that the session gives a shuffle."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Every executor can reread the files, so a lost executor costs no
    recomputation, and both branches of a later plan see the same rows even
    when ``df`` holds ids that depend on the partitioning.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def positioned(df: DataFrame, order: list[Column], name: str = "numbered") -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, saved with ``_pid`` and ``_pos``.

    The partition number and the position inside it are written *with* the
    rows, so everything derived from them later agrees.
    """
    at = F.monotonically_increasing_id()
    laid = df.repartitionByRange(shuffle_partitions(df), *order).sortWithinPartitions(*order).withColumn("_at", at)
    laid = saved(laid, name)
    return laid.withColumn("_pid", F.shiftright("_at", POSITION_BITS)).withColumn(
        "_pos", F.col("_at").bitwiseAND((1 << POSITION_BITS) - 1)
    ).drop("_at")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add ``name``: the 0-based rank of each row in the total order ``order``.

    One range sort, saved; the per-partition offsets have one row per
    partition, whatever the input size, and are broadcast.
    """
    laid = positioned(df, order, "ranked")
    counts = laid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return laid.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_off") + F.col("_pos")).drop("_pid", "_pos", "_off")
