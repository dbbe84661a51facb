"""Ordered-state operators against a plain sequential Python fold."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pagelake.operators import ordered as O

T0 = dt.datetime(2024, 1, 1)


def _attempts(spark, rows):
    return spark.createDataFrame(rows, "key string, ts timestamp_ntz, attempt_id long, ok boolean, status string")


def _random_log(n_keys=4, n=1500, seed=7, hot="k0"):
    rnd = random.Random(seed)
    rows, t = [], T0
    for i in range(n):
        t = t + dt.timedelta(seconds=rnd.choice([1, 5, 20, 70, 400, 4000]))
        key = hot if rnd.random() < 0.5 else f"k{rnd.randrange(1, n_keys)}"
        ok = rnd.random() < rnd.choice([0.3, 0.8, 0.95])
        rows.append((key, t, i, ok, "success" if ok else "failed"))
    return rows


def py_health(rows):
    state, out = {}, {}
    for key, _, aid, ok, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        h, total, failed = state.get(key, (1.0, 0, 0))
        total += 1
        if not ok:
            failed += 1
        h = min(1.0, h + 0.01) if ok else max(0.0, h - 0.05)
        state[key] = (h, total, failed)
        out[aid] = (h, (total - failed) / total)
    return out


def test_health_walk_bit_equal_small_buckets(spark):
    rows = _random_log()
    df = _attempts(spark, rows)
    got = O.health_walk(df, key="key", width_s=600).collect()
    want = py_health(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.health_score, r.success_rate) == want[r.attempt_id], r


def test_health_q34_threshold(spark):
    rows = [("p", T0 + dt.timedelta(hours=i), i, False, "failed") for i in range(10)]
    got = O.health_walk(_attempts(spark, rows), key="key", width_s=3600).orderBy("attempt_id").collect()
    assert got[-1].health_score == 0.4999999999999996  # below 0.5 → rate limited
    from pagelake.functions import scoring as S

    st = spark.createDataFrame([(got[-1].health_score,)], "h double").select(S.proxy_status("h").alias("s")).collect()[0].s
    assert st == "rate_limited"


def test_health_golden_ok_then_fail(spark):
    rows = [("p", T0, 1, True, "success"), ("p", T0 + dt.timedelta(seconds=1), 2, False, "failed")]
    got = O.health_walk(_attempts(spark, rows), key="key").orderBy("attempt_id").collect()
    assert got[-1].health_score == 0.95 and got[-1].success_rate == 0.5


def py_breaker(rows):
    state, out = {}, {}
    for key, ts, aid, ok, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        t = (ts - dt.datetime(1970, 1, 1)).total_seconds()
        kind, k, tf = state.get(key, ("c", 0, None))
        allowed = kind == "c" or t - tf > 60
        if allowed:
            if ok:
                kind, k = "c", 0
            else:
                k += 1
                tf = t
                kind = "o" if k >= 5 else "c"
        state[key] = (kind, k, tf)
        out[aid] = (allowed, "closed" if kind == "c" else "open")
    return out


def test_breaker_replay_matches_fold(spark):
    rows = _random_log(seed=11)
    got = O.breaker_replay(_attempts(spark, rows), key="key", width_s=900).collect()
    want = py_breaker(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.allowed, r.state) == want[r.attempt_id], r


def test_breaker_golden(spark):
    rows = [("m", T0 + dt.timedelta(seconds=i), i, False, "failed") for i in range(5)]
    rows.append(("m", T0 + dt.timedelta(seconds=30), 5, True, "success"))  # refused: still open
    rows.append(("m", T0 + dt.timedelta(seconds=200), 6, True, "success"))  # probe passes, closes
    got = {r.attempt_id: r for r in O.breaker_replay(_attempts(spark, rows), key="key").collect()}
    assert got[4].state == "open"
    assert got[5].allowed is False and got[5].state == "open"
    assert got[6].allowed is True and got[6].state == "closed"


def test_zero_floored_and_streaks(spark):
    rows = _random_log(seed=3, n=800)
    df = _attempts(spark, rows).withColumn("event_type", F.lit("view")).withColumnRenamed("key", "proxy_id")
    got = {r.attempt_id: r.recent_failures for r in O.zero_floored_counters(df).collect()}
    c, want = {}, {}
    for key, _, aid, ok, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        c[key] = max(0, c.get(key, 0) + (-1 if ok else 1))
        want[aid] = c[key]
    assert got == want
    streaks = O.failure_streaks(df.withColumnRenamed("proxy_id", "method")).collect()
    runs, cur = [], {}
    for key, _, aid, ok, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        if ok:
            if cur.get(key, 0) >= 5:
                runs.append((key, cur[key]))
            cur[key] = 0
        else:
            cur[key] = cur.get(key, 0) + 1
    runs += [(k, v) for k, v in cur.items() if v >= 5]
    assert sorted((r.method, r.streak_length) for r in streaks) == sorted(runs)


def test_moving_average_matches_window(spark):
    rows = [("p", T0 + dt.timedelta(minutes=i), i, True, "success") for i in range(250)]
    df = _attempts(spark, rows).withColumn("rt", (F.col("attempt_id") % 7).cast("double"))
    got = {r.attempt_id: r.avg for r in O.moving_average_last_n(df, "key", "ts", "attempt_id", "rt", 100, "avg").collect()}
    vals = [(i, float(i % 7)) for i in range(250) if i % 7 != 0]
    for idx, (aid, _) in enumerate(vals):
        window = [v for _, v in vals[max(0, idx - 99) : idx + 1]]
        assert abs(got[aid] - sum(window) / len(window)) < 1e-9


def test_changes_across_segments_equal_single_window(spark):
    from pagelake.operators import changes as C

    rnd = random.Random(5)
    rows, t = [], T0
    for i in range(1500):
        t += dt.timedelta(seconds=rnd.choice([5, 60, 900, 4000]))
        rows.append(("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(5)}", t, i, rnd.choice(["a", "b"]), float(rnd.randrange(3))))
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, event_id long, kind string, value double")
    got = {r.event_id: dict(r.changes) for r in C.changes(df, "key", ["ts", "event_id"], ["kind", "value"], width_s=600).collect()}
    want, last = {}, {}
    for k, ts, i, kind, v in rows:
        if k in last:
            pk, pv = last[k]
            ch = {}
            if pk != kind:
                ch["kind"] = f"{pk} -> {kind}"
            if pv != v:
                ch["value"] = f"{pv} -> {v}"
            if ch:
                want[i] = ch
        last[k] = (kind, v)
    assert got == want


def _folds_match(spark, rows):
    df = _attempts(spark, rows)
    got = {r.attempt_id: (r.health_score, r.success_rate) for r in O.health_walk(df, key="key").collect()}
    assert got == py_health(rows)
    br = {r.attempt_id: (r.allowed, r.state) for r in O.breaker_replay(df, key="key").collect()}
    assert br == {k: v[:2] for k, v in py_breaker(rows).items()}


def test_segments_split_a_hot_key_by_rank(spark):
    rows = _random_log(n=1200, seed=13)
    segs = O.segments(_attempts(spark, rows), "key", ["ts", "attempt_id"])
    assert segs.where(F.col("key") == "k0").select("_bucket").distinct().count() > 1
    _folds_match(spark, rows)


def test_burst_of_one_second(spark):
    """All rows of a key at one time: only the tiebreak orders and splits them."""
    oks = [(i * 7919) % 11 > 4 for i in range(2000)]
    rows = [("k0", T0, i, ok, "success" if ok else "failed") for i, ok in enumerate(oks)]
    _folds_match(spark, rows)


def test_null_key_is_a_key(spark):
    df = spark.createDataFrame([(1, None, 1, 200), (2, "m", 2, 500), (3, None, 3, 404)], "attempt_id long, method string, ts long, status_code int")
    df = df.withColumn("ts", F.timestamp_seconds("ts"))
    got = {r.attempt_id: (r.requests_so_far, r.ok_so_far, r.failed_so_far) for r in O.running_totals(df).collect()}
    assert got == {1: (1, 1, 0), 2: (1, 0, 1), 3: (2, 1, 1)}


@pytest.mark.parametrize(
    "kind, keys",
    [
        ("bigint", [None, 2**53, 2**53 + 1, -4]),
        ("double", [None, 1.5, float("nan"), -0.0]),
        ("date", [None, dt.date(2024, 2, 29), dt.date(1969, 12, 31), dt.date(1, 1, 1)]),
        ("decimal(20,3)", [None, Decimal("1.500"), Decimal("-12345678901234567.891"), Decimal(0)]),
        ("binary", [None, b"\xff\x00", b"", b"a"]),
        ("string", [None, "", "None", "nan"]),
    ],
)
def test_keys_of_any_type_with_nulls(spark, kind, keys):
    rnd = random.Random(4)
    rows, t = [], T0
    for i in range(300):
        t += dt.timedelta(seconds=rnd.choice([1, 5, 70]))
        ok = rnd.random() < 0.4
        rows.append((rnd.randrange(4), t, i, ok, "success" if ok else "failed"))
    given = [(keys[k], *rest) for k, *rest in rows]
    df = spark.createDataFrame(given, f"key {kind}, ts timestamp_ntz, attempt_id long, ok boolean, status string")
    walk = O.health_walk(df, key="key")
    assert dict(walk.dtypes)["key"] == kind
    got = walk.collect()
    assert len(got) == len(rows)
    assert {r.attempt_id: (r.health_score, r.success_rate) for r in got} == py_health(rows)
    shown = lambda k: bytes(k) if kind == "binary" and k is not None else str(k + 0.0 if kind == "double" and k is not None else k)
    assert {r.attempt_id: shown(r.key) for r in got} == {i: shown(Decimal("0.000") if kind.startswith("decimal") and k == 0 else k) for k, _, i, _, _ in given}
    replay = O.breaker_replay(df, key="key")
    assert dict(replay.dtypes)["key"] == kind
    got = replay.collect()
    assert len(got) == len(rows)
    assert {r.attempt_id: (r.allowed, r.state) for r in got} == {k: v[:2] for k, v in py_breaker(rows).items()}


def test_breaker_dense_segment_is_linear(spark):
    """100,000 attempts within 20 s of event time."""
    base = spark.range(100_000).select(
        F.col("id").alias("attempt_id"), F.lit("k").alias("key"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 200).cast("timestamp_ntz").alias("ts"),
        (F.pmod(F.xxhash64("id"), F.lit(3)) > 0).alias("ok"),
    )
    out = O.breaker_replay(base, key="key")
    assert out.count() == 100_000
    assert out.where("NOT allowed").count() > 90_000
