"""Event-order streams: any file order gives the batch twin's rows; timers act without input."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pagelake.operators import ordered as O
from pagelake.streaming import inorder as IO
from pagelake.streaming import streams as ST

T0 = dt.datetime(2024, 1, 1)
LOG = "method string, ts timestamp_ntz, attempt_id long, ok boolean"


def write_files(spark, path, chunks):
    """One file a chunk; a file stream takes them in this order."""
    import os

    for i, rows in enumerate(chunks):
        part = f"{path}/part{i}"
        spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(part)
        for name in os.listdir(part):
            if name.endswith(".parquet"):
                os.utime(f"{part}/{name}", (1_700_000_000 + 10 * i,) * 2)
                os.rename(f"{part}/{name}", f"{path}/{i}.parquet")


def random_log(n=400, seed=5, keys=(None, "a", "b", "")):
    rnd, rows, t = random.Random(seed), [], T0
    for i in range(n):
        t += dt.timedelta(seconds=rnd.choice([0, 1, 5, 20, 70, 400, 3000]))
        rows.append((rnd.choice(keys), t, i, rnd.random() < rnd.choice([0.2, 0.9])))
    return rows


def stream(spark, path):
    return lambda: spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{path}/*.parquet")


def replayed(spark, path, fold, **options):
    table = spark.read.parquet(f"{path}/*.parquet")
    return IO.replay(spark, stream(spark, path), table, "method", fold, ST.scratch(spark, "inorder"), **options)


@pytest.fixture(scope="module", params=["in order", "reversed", "shuffled"])
def files(request, spark, tmp_path_factory):
    rows = random_log()
    if request.param == "shuffled":
        random.Random(1).shuffle(rows)
    chunks = [rows[i : i + 100] for i in range(0, 400, 100)]
    if request.param == "reversed":
        chunks.reverse()
    path = str(tmp_path_factory.mktemp("log"))
    write_files(spark, path, chunks)
    return path, rows, spark.createDataFrame(rows, LOG)


def test_health_and_sweeps_equal_the_batch_fold(spark, files):
    path, rows, batch = files
    told, late = replayed(spark, path, IO.HealthFold())
    got = {r.attempt_id: (r.method, r.health_score, r.success_rate) for r in told.where("kind = 'attempt'").collect()}
    want = {r.attempt_id: (r.method, r.health_score, r.success_rate) for r in O.health_walk(batch, key="method").collect()}
    assert got == want and late.count() == 0
    # The check every 300 s, played by hand.
    health, last = {}, {}
    for k, t, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        slot = -(-(t - T0) // dt.timedelta(seconds=300))
        last[(k, slot)] = want[i][1]
    sweeps = {
        (k, T0 + slot * dt.timedelta(seconds=300), IO.report_status(h), IO.sweep_status(h))
        for (k, slot), h in last.items()
        if IO.report_status(h) != IO.sweep_status(h)
    }
    at = F.timestamp_micros("at_us").cast("timestamp_ntz").alias("at")
    seen = [tuple(r) for r in told.where("kind = 'sweep'").select("method", at, "status_before", "status").collect()]
    assert sweeps and len(seen) == len(sweeps) and set(seen) == sweeps


def test_breaker_and_its_changes_equal_the_batch_fold(spark, files):
    path, rows, batch = files
    told, _ = replayed(spark, path, IO.BreakerFold())
    got = {r.attempt_id: (r.method, r.allowed, r.state, r.failure_count_at_least) for r in told.where("kind = 'attempt'").collect()}
    twin = O.breaker_replay(batch, key="method").collect()
    assert got == {r.attempt_id: (r.method, r.allowed, r.state, r.failure_count_at_least) for r in twin}
    want, state = [], {}
    oks = {r[2]: r[3] for r in rows}
    for r in sorted(twin, key=lambda r: (r.ts, r.attempt_id)):
        before = state.get(r.method, "closed")
        if r.allowed and (before != "closed" or r.state != "closed"):
            want.append((r.method, r.ts, "half_open" if before == "open" else before, r.state))
        if r.allowed and r.state == "open":
            assert not oks[r.attempt_id]
            want.append((r.method, r.ts + dt.timedelta(seconds=60), "open", "half_open"))
        state[r.method] = r.state
    at = F.timestamp_micros("at_us").cast("timestamp_ntz").alias("at")
    seen = [tuple(r) for r in told.where("kind = 'change'").select("method", at, "state_before", "state").collect()]
    key = lambda r: (str(r[0]), r[1], r[2])
    assert want and sorted(seen, key=key) == sorted(want, key=key)


def run(spark, path, fold, ckpt, out, clock, delay_s=600):
    df = IO.in_event_order(stream(spark, path)(), "method", fold, delay_s, IO.clock_stream(spark, clock))
    return IO.to_folders(df, out, ckpt)


def rows_of(spark, out):
    return spark.read.parquet(f"{out}/told").drop("_batch").collect()


def test_timers_act_in_a_silent_gap(spark, tmp_path):
    """The clock goes on, no attempt comes: the breaker goes half-open, the check re-classifies."""
    path, clock = str(tmp_path / "log"), str(tmp_path / "clock")
    failures = [("m", T0 + dt.timedelta(seconds=10 * i), i, False) for i in range(11)]
    write_files(spark, path, [failures])
    spark.createDataFrame([], IO.CLOCK_SCHEMA).write.parquet(clock)
    for fold, kind, before, then in ((IO.BreakerFold(), "change", 50, 110), (IO.HealthFold(), "sweep", 299, 301)):
        out, ckpt = str(tmp_path / f"out-{kind}"), str(tmp_path / f"ckpt-{kind}")
        ticks = f"{clock}-{kind}"
        spark.createDataFrame([], IO.CLOCK_SCHEMA).write.parquet(ticks)
        run(spark, path, fold, ckpt, out, ticks)
        # The breaker opens at the fifth failure, 40 s; later attempts are refused.
        IO.tick(spark, ticks, T0 + dt.timedelta(seconds=600 + before))
        run(spark, path, fold, ckpt, out, ticks)
        early = [r for r in rows_of(spark, out) if r.kind == kind and r.attempt_id is None]
        assert early == []
        IO.tick(spark, ticks, T0 + dt.timedelta(seconds=600 + then))
        run(spark, path, fold, ckpt, out, ticks)
        (only,) = [r for r in rows_of(spark, out) if r.kind == kind and r.attempt_id is None]
        if kind == "change":
            assert (only.state_before, only.state, only.at_us) == ("open", "half_open", 1_704_067_300_000_000)
        else:
            # 11 failures: health 0.45, rate-limited as reported, active to the check.
            assert (only.status_before, only.status, only.at_us) == ("rate_limited", "active", 1_704_067_500_000_000)


def test_late_rows_change_nothing_and_are_told_apart(spark, tmp_path):
    path, out, ckpt, clock = (str(tmp_path / n) for n in ("log", "out", "ckpt", "clock"))
    spark.createDataFrame([], IO.CLOCK_SCHEMA).write.parquet(clock)
    hour = dt.timedelta(hours=1)
    chunks = [
        [("m", T0, 1, True), ("m", T0 + 2 * hour, 2, False)],
        [("m", T0 + 3 * hour, 3, True), ("m", T0 + hour, 4, False)],
        [("m", T0 + dt.timedelta(minutes=1), 5, False), ("n", T0, 6, True), ("m", None, 7, True)],
    ]
    write_files(spark, path, chunks)
    run(spark, path, IO.HealthFold(), ckpt, out, clock)
    IO.tick(spark, clock, T0 + 10 * hour)
    run(spark, path, IO.HealthFold(), ckpt, out, clock)
    late = {(r.method, r.attempt_id) for r in spark.read.parquet(f"{out}/late").collect()}
    told = [r.attempt_id for r in sorted(rows_of(spark, out), key=lambda r: r.event_us) if r.kind == "attempt" and r.method == "m"]
    # Row 4 comes before its key is folded to 1:50, in the batch that does so; row 5 after it. Row 7 has no time.
    # Row 6 is the first of its key: it is late to nobody.
    assert late == {("m", 5), ("m", 7)} and told == [1, 4, 2, 3]
    assert [r.attempt_id for r in rows_of(spark, out) if r.method == "n" and r.kind == "attempt"] == [6]


def test_state_goes_with_the_cache_entry(spark, tmp_path):
    schema = "url string, ts timestamp_ntz, attempt_id long, status string"
    rows = [("u", T0, 1, "success"), ("u", T0 + dt.timedelta(seconds=99), 2, "failed"), ("u", T0 + dt.timedelta(seconds=100), 3, "failed"),
            ("v", T0, 4, "failed"), (None, T0, 5, "success"), (None, T0, 6, "success")]
    path = str(tmp_path / "log")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    source = lambda: spark.readStream.schema(schema).parquet(path)
    told, _ = IO.replay(spark, source, spark.read.parquet(path), "url", IO.CacheFold(100), str(tmp_path / "out"))
    assert {(r.attempt_id, r.hit) for r in told.collect()} == {(1, False), (2, True), (3, False), (4, False), (5, False), (6, True)}


def test_disorder_of_files(spark, tmp_path):
    day = dt.timedelta(days=1)
    rows = [[("m", T0 + i * day, i, True)] for i in range(4)]
    write_files(spark, str(tmp_path / "a"), rows)
    write_files(spark, str(tmp_path / "b"), rows[::-1])
    assert IO.disorder_s(spark.read.parquet(f"{tmp_path}/a/*.parquet")) == 0
    assert IO.disorder_s(spark.read.parquet(f"{tmp_path}/b/*.parquet")) == 3 * 86400


@pytest.mark.parametrize("width, slide", [(3600, 900), (600, 240), (60, 60)])
def test_sliding_rate_equals_brute_force(spark, tmp_path, width, slide):
    rows = random_log(keys=("a", "b"))
    write_files(spark, str(tmp_path / "log"), [rows])
    out = str(tmp_path / "out")
    rate = ST.sliding_rate(stream(spark, str(tmp_path / "log"))(), f"{width} seconds", f"{slide} seconds")
    ST.to_upsert_log(rate, out, str(tmp_path / "ckpt"))
    got = {(r.window_start, r.method): (r.attempts, r.successes, r.requests_per_second) for r in ST.read_upsert_log(spark, out, ["window_start", "window_end", "method"]).collect()}
    want = {}
    epoch = dt.datetime(1970, 1, 1)
    for k, t, _, ok in rows:
        at = int((t - epoch).total_seconds()) // slide * slide
        while at > (t - epoch).total_seconds() - width:
            w = want.setdefault((epoch + dt.timedelta(seconds=at), k), [0, 0])
            w[0] += 1
            w[1] += ok
            at -= slide
    assert got == {k: (n, good, round(n / width, 9)) for k, (n, good) in want.items()}


class Held:
    """State of one key in memory; counts the rows that a processor reads back."""

    def __init__(self):
        self.value, self.map, self.timers, self.largest = None, {}, set(), 0

    def getValueState(self, name, schema):
        state = Held()
        state.get, state.update, state.clear = (lambda: state.value), (lambda v: setattr(state, "value", v)), (lambda: setattr(state, "value", None))
        return state

    def getMapState(self, name, key, value):
        return self

    def updateValue(self, key, value):
        self.map[key] = value
        self.largest = max(self.largest, len(value[0]))

    def getValue(self, key):
        return self.map[key]

    def removeKey(self, key):
        del self.map[key]

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Mark:
    def __init__(self, us):
        self.us = us

    def getCurrentWatermarkInMs(self):
        return self.us // 1000


def test_a_hot_key_is_folded_by_blocks(monkeypatch):
    """A key's rows go through the state in small blocks and are told in small frames, in event order."""
    import pandas as pd

    for name, n in (("RUN", 500), ("BLOCK", 50), ("STEP", 4), ("TOLD", 100)):
        monkeypatch.setattr(IO, name, n)
    rnd = random.Random(7)
    rows = [(rnd.randrange(1, 40_000) * 1000, rnd.choice([None, i]), bool(rnd.random() < 0.4)) for i in range(5000)]
    fold = IO.BreakerFold()
    columns = ["method", "late", "event_us", *[c.split()[0] for c in fold.out.split(", ")]]
    p = IO.InOrder(fold, "_t long, attempt_id bigint, ok boolean", columns)
    state = Held()
    p.init(state)
    blocks, frames, key = [], [], ("m",)
    load = IO._sorted
    monkeypatch.setattr(IO, "_sorted", lambda parts: (blocks.append(sum(len(c[0]) for c in parts)), load(parts))[1])
    for at in range(0, 5000, 1000):
        pdfs = [pd.DataFrame([("m", None, t, False, i, ok) for t, i, ok in rows[x : x + 100]]) for x in range(at, at + 1000, 100)]
        frames += [*p.handleInputRows(key, iter(pdfs), Mark(0))]
    assert frames == [] and len(state.map) >= 90 and state.timers
    frames += [*p.handleExpiredTimer(key, Mark(20_000_000), None)]
    half = sum(len(f) for f in frames)
    frames += [*p.handleExpiredTimer(key, Mark(50_000_000), None)]
    assert state.map == {} and 0 < half < sum(len(f) for f in frames)
    # A step reads a few blocks and, of each run, the open one; never the key.
    assert max(blocks) <= 1200 and max(len(f) for f in frames) <= 102
    got = [r for f in frames for r in f.itertuples(index=False, name=None) if r[3] == "attempt"]
    want, carry = [], fold.start()
    for t, i, ok in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0)):
        while (due := fold.due(carry)) is not None and due < t:
            carry, _ = fold.at(carry, due)
        carry, told = fold.row(carry, t, (i, ok))
        want += [("m", False, t, *o) for o in told if o[0] == "attempt"]
    assert [tuple(None if x != x else x for x in r) for r in got] == want
