"""Quantiles, pool ranks and sticky sessions without a task that holds a whole key."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.operators import ordered as O
from pagelake.operators import reliability as R
from pagelake.operators import stats as A

T0 = dt.datetime(2024, 1, 1)


def test_quantiles_equal_numpy(spark):
    rnd = random.Random(2)
    rows = [("hot", rnd.choice([1.5, 2.0, rnd.random()])) for _ in range(900)]
    rows += [(k, rnd.random()) for k in ("a", "b", None) for _ in range(rnd.randrange(1, 8))] + [("one", 7.0), ("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, "domain string, response_time double")
    got = {r.domain: tuple(r)[1:] for r in A.quantiles_by_rank(df, "domain", "response_time", A.QUARTILES).collect()}
    want = {}
    for key in {k for k, _ in rows}:
        values = [v for k, v in rows if k == key and v is not None]
        if values:
            want[key] = tuple(np.quantile(values, q) for q in A.QUARTILES.values())
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-12)
    first = A.time_quartiles(df.where("domain IS NOT NULL"), 4)
    assert sorted(r.domain for r in first.collect()) == ["a", "b", "hot", "none"]


def test_one_pool_is_ranked_over_many_tasks(spark):
    n = 100_000
    p = spark.range(n).select(
        F.concat(F.lit("p"), F.col("id")).alias("proxy_id"), F.lit("pool").alias("pool_name"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("health_score"), F.lit(1.0).alias("success_rate"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)) + 3).alias("total_requests"),
    )
    ranked = R.health_rank(p).withColumn("task", F.spark_partition_id()).cache()
    assert ranked.agg(F.countDistinct("rank"), F.min("rank"), F.max("rank")).first() == (n, 1, n)
    sizes = [r["count"] for r in ranked.groupBy("task").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < n // 2
    top = ranked.orderBy("rank").limit(200).collect()
    assert [r.score for r in top] == sorted((r.score for r in top), reverse=True)
    least = R.least_used(p)
    assert least.count() == p.where("total_requests = 3").count() > 0
    assert "Window" not in least._jdf.queryExecution().executedPlan().toString()


def py_sessions(rows, duration_s):
    out, state = {}, {}
    for key, t, i, proxy in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in state or (t - state[key][0]).total_seconds() >= duration_s:
            state[key] = (t, proxy)
        out[i] = state[key]
    return out


@pytest.mark.parametrize("duration", [1, 60, 1800, 10**7])
def test_session_starts_equal_the_fold(spark, duration):
    rnd, rows, t = random.Random(8), [], T0
    for i in range(900):
        t += dt.timedelta(seconds=rnd.choice([0, 0, 1, 20, 60, 300, 1800]))
        rows.append((rnd.choice([None, 1, 1, 1, 2]), t, i, f"p{rnd.randrange(5)}"))
    df = spark.createDataFrame(rows, "session_id long, ts timestamp_ntz, attempt_id long, proxy_id string")
    want = py_sessions(rows, duration)
    got = {r.attempt_id: r.created_at for r in O.session_starts(df, "session_id", "ts", "attempt_id", duration).collect()}
    assert got == {i: c for i, (c, _) in want.items()}
    intervals = R.session_intervals(df, duration)
    assert sorted(map(str, intervals.select("session_id", "created_at", "proxy_id").collect())) == sorted(
        str(r) for r in spark.createDataFrame(
            sorted({(rows[i][0], c, p) for i, (c, p) in want.items()}, key=str), "session_id long, created_at timestamp_ntz, proxy_id string"
        ).collect()
    )
    held = {r.attempt_id: r.sticky_proxy for r in R.sticky_proxies(df, duration).collect()}
    assert held == {i: p for i, (_, p) in want.items()}


def test_live_sessions_hold_from_opening_to_expiry(spark):
    rows = [(1, T0, 1, "a"), (2, T0 + dt.timedelta(seconds=100), 2, "b")]
    df = spark.createDataFrame(rows, "session_id long, ts timestamp_ntz, attempt_id long, proxy_id string")
    intervals = R.session_intervals(df, 60)
    for second, live in ((0, {1}), (59, {1}), (60, set()), (99, set()), (100, {2}), (159, {2}), (160, set())):
        as_of = F.lit(str(T0 + dt.timedelta(seconds=second))).cast("timestamp_ntz")
        assert {r.session_id for r in R.live_sessions(intervals, as_of).collect()} == live
