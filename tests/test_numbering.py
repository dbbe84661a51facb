"""Numbering over many partitions, with rows much wider than their order."""

from pyspark.sql import functions as F

from pagelake.operators import numbering as N
from pagelake.operators import store as ST


def _wide(spark, n):
    base = spark.range(0, n, 1, 37).select(
        F.pmod(F.xxhash64("id"), F.lit(n * 4)).alias("k"), "id", F.repeat(F.md5(F.col("id").cast("string")), 8).alias("payload"),
        (F.col("id") % 9).alias("g"),
    )
    return base


def test_numbers_of_wide_rows(spark):
    n = 200_000
    out = ST.numbered(_wide(spark, n), [F.col("k").asc(), F.col("id").asc()])
    got = out.agg(F.count("*").alias("c"), F.countDistinct("number").alias("d"), F.min("number").alias("lo"), F.max("number").alias("hi")).first()
    assert (got.c, got.d, got.lo, got.hi) == (n, n, 1, n)
    # Neighbours in number are neighbours in order.
    a = out.select("number", "k", "id")
    b = a.select((F.col("number") - 1).alias("number"), F.struct("k", "id").alias("after"))
    assert a.join(b, "number").where(F.struct("k", "id") >= F.col("after")).isEmpty()


def test_numbers_restart_in_groups_and_null_group(spark):
    df = _wide(spark, 5000).withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    out = ST.numbered(df, [F.col("k").asc(), F.col("id").asc()], group=["g"])
    per = out.groupBy("g").agg(F.count("*").alias("c"), F.countDistinct("number").alias("d"), F.max("number").alias("hi")).collect()
    assert len(per) == 9 and all(r.c == r.d == r.hi for r in per)


def test_global_rank_with_ties_over_one_key(spark):
    df = _wide(spark, 3000).withColumn("k", F.lit(1))
    got = sorted(r["rank"] for r in N.global_rank(df, [F.col("k").asc(), F.col("id").asc()]).select("rank").collect())
    assert got == list(range(3000))
