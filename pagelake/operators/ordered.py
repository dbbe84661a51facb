"""Order-dependent state per key, split so that no key lives in one task.

The reference folds attempts one by one per proxy / method.  A single key
(one method of three, a hot proxy) can hold a third of all rows, so every
fold here is cut into *segments* of a key:

1. rows are range-partitioned by ``(key, time, tiebreak)``, sorted and saved
   with their partition number, which is the segment: a hot key is split by
   rank, however many of its rows share one second, and a NULL key is a key;
2. rows are folded within a segment (window functions, or a sorted stream);
3. each segment is summarised in a few numbers;
4. the summaries of one key, one row per segment, are chained in segment order
   to give each segment its carried-in state, which is joined back.

A segment holds at most one partition of the range sort, so its size is set by
``spark.sql.shuffle.partitions``, as for any sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.operators import numbering

# Health walk (W2): start, step on success / failure, bounds — in hundredths.
HEALTH_START, HEALTH_UP, HEALTH_DOWN, HEALTH_LO, HEALTH_HI = 100, 1, -5, 0, 100
# Breaker (W4): failures to open, seconds before a half-open probe.
BREAKER_THRESHOLD, BREAKER_RECOVERY_S = 5, 60.0


def segments(df: DataFrame, key: str, order: list[str], width_s: int | None = None) -> DataFrame:
    """Add ``_bucket``: the segment of each row, increasing in ``order`` within a key.

    By default the partition of one saved range sort by (key, order); a caller
    that knows its rate can give a fixed width in seconds instead.
    """
    if width_s is not None:
        t_us = F.unix_micros(F.col(order[0]).cast("timestamp"))
        return df.withColumn("_bucket", F.floor(t_us / (width_s * 1_000_000)).cast("long"))
    laid = numbering.positioned(df, [F.col(key).asc_nulls_first(), *[F.col(c).asc() for c in order]], "segments")
    return laid.withColumnRenamed("_pid", "_bucket").drop("_pos")


def join_segments(rows: DataFrame, carry: DataFrame, key: str) -> DataFrame:
    """``rows`` with the per-segment columns of ``carry``; a NULL key matches itself."""
    c = carry.withColumnRenamed(key, "_skey").withColumnRenamed("_bucket", "_sbucket")
    same = rows[key].eqNullSafe(c["_skey"]) & (rows["_bucket"] == c["_sbucket"])
    return rows.join(c, same).drop("_skey", "_sbucket")


def prefix_sums(
    df: DataFrame, key: str, ts: str, tiebreak: str, values: dict[str, Column], width_s: int | None = None,
    with_min: tuple[str, ...] = (),
) -> DataFrame:
    """Running sums (inclusive) of ``values`` per key in (ts, tiebreak) order.

    For names in ``with_min`` the running minimum of that running sum is
    added as ``<name>_min`` (needed by the zero-floored counter).
    """
    b = segments(df, key, [ts, tiebreak], width_s)
    for name, expr in values.items():
        b = b.withColumn(f"_v_{name}", expr)
    seg = W.partitionBy(key, "_bucket").orderBy(F.col(ts), F.col(tiebreak)).rowsBetween(W.unboundedPreceding, 0)
    for name in values:
        b = b.withColumn(f"_l_{name}", F.sum(f"_v_{name}").over(seg))
        if name in with_min:
            b = b.withColumn(f"_lm_{name}", F.min(f"_l_{name}").over(seg))
    aggs = [F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values]
    aggs += [F.min(f"_l_{n}").alias(f"_bm_{n}") for n in with_min]
    tot = b.groupBy(key, "_bucket").agg(*aggs)
    chain = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    for n in values:
        tot = tot.withColumn(f"_c_{n}", F.coalesce(F.sum(f"_t_{n}").over(chain), F.lit(0)))
    for n in with_min:
        tot = tot.withColumn(f"_cm_{n}", F.min(F.col(f"_c_{n}") + F.col(f"_bm_{n}")).over(chain))
    keep = [key, "_bucket"] + [f"_c_{n}" for n in values] + [f"_cm_{n}" for n in with_min]
    j = join_segments(b, tot.select(*keep), key)
    for n in values:
        j = j.withColumn(n, F.col(f"_c_{n}") + F.col(f"_l_{n}"))
        if n in with_min:
            local_min_abs = F.col(f"_c_{n}") + F.col(f"_lm_{n}")
            j = j.withColumn(
                f"{n}_min",
                F.when(F.col(f"_cm_{n}").isNull(), local_min_abs).otherwise(F.least(F.col(f"_cm_{n}"), local_min_abs)),
            )
    drop = [c for c in j.columns if c.startswith("_")]
    return j.drop(*drop)


def running_totals(attempts: DataFrame, key: str = "method", ts: str = "ts", tiebreak: str = "attempt_id") -> DataFrame:
    """Requests, successes, failures up to and including each attempt."""
    ok = (F.col("status_code") >= 200) & (F.col("status_code") < 300)
    return prefix_sums(
        attempts,
        key,
        ts,
        tiebreak,
        {
            "requests_so_far": F.lit(1).cast("long"),
            "ok_so_far": ok.cast("long"),
            "failed_so_far": (~ok).cast("long"),
        },
    )


def zero_floored_counters(events: DataFrame, key: str = "proxy_id", ts: str = "ts", tiebreak: str = "attempt_id") -> DataFrame:
    """W3 on the attempt log: ``recent_failures`` (+1 on failure, −1 on success)
    and ``current_requests`` (+1 selected, −1 released), both floored at 0."""
    fail = F.col("status") != "success"
    rf = F.when(fail, 1).otherwise(-1).cast("long")
    cr = F.when(F.col("event_type").isin("view", "click"), 1).otherwise(-1).cast("long")
    s = prefix_sums(events, key, ts, tiebreak, {"s_rf": rf, "s_cr": cr}, with_min=("s_rf", "s_cr"))
    return s.select(
        *[c for c in events.columns],
        (F.col("s_rf") - F.least(F.lit(0), F.col("s_rf_min"))).alias("recent_failures"),
        (F.col("s_cr") - F.least(F.lit(0), F.col("s_cr_min"))).alias("current_requests"),
    )


def failure_streaks(attempts: DataFrame, key: str = "method", ts: str = "ts", tiebreak: str = "attempt_id", min_len: int = 5) -> DataFrame:
    """Runs of consecutive failures of length >= ``min_len`` per key.

    Gaps and islands without a per-key window: the island of a failure is
    the number of successes before it (a bucketed running count); failures
    sharing it are consecutive.  The final group-by is on (key, island), and
    a streak is split across buckets only through that running count.
    """
    ok = (F.col("status") == "success").cast("long")
    s = prefix_sums(attempts, key, ts, tiebreak, {"successes_before": ok})
    fails = s.where(F.col("status") != "success")
    g = fails.groupBy(key, "successes_before").agg(
        F.count(F.lit(1)).alias("streak_length"),
        F.min(F.struct(F.col(ts), F.col(tiebreak))).alias("_first"),
        F.max(F.struct(F.col(ts), F.col(tiebreak))).alias("_last"),
    )
    return g.where(F.col("streak_length") >= min_len).select(
        key,
        "streak_length",
        F.col(f"_first.{ts}").alias("start_ts"),
        F.col(f"_first.{tiebreak}").alias("start_id"),
        F.col(f"_last.{ts}").alias("end_ts"),
        F.col(f"_last.{tiebreak}").alias("end_id"),
    )


def moving_average_last_n(
    df: DataFrame, key: str, ts: str, tiebreak: str, value: str, n: int = 100, name: str = "avg_last_n"
) -> DataFrame:
    """Average of the last ``n`` truthy values per key at each such row.

    Row numbers and running sums come from the bucketed prefix scan; the sum
    of the last ``n`` is ``P[rn] - P[rn - n]``, looked up by an equi-join on
    (key, rn) — unique per key, so no join key is hot.
    """
    src = df.where(F.col(value).isNotNull() & (F.col(value) != 0))
    # Prefix sums in exact decimals: a difference of two long double prefix
    # sums would lose the low digits (cancellation); decimal differences are
    # exact, and the window sum is turned into a double once.
    dec = "decimal(38,12)"
    p = prefix_sums(src, key, ts, tiebreak, {"rn": F.lit(1).cast("long"), "psum": F.col(value).cast(dec)})
    prev = p.select(F.col(key).alias("_k"), (F.col("rn") + n).alias("_rn"), F.col("psum").alias("_prev"))
    j = p.join(prev, p[key].eqNullSafe(prev["_k"]) & (p["rn"] == prev["_rn"]), "left")
    window_sum = (F.col("psum") - F.coalesce(F.col("_prev"), F.lit(0).cast(dec))).cast("double")
    return j.withColumn(name, window_sum / F.least(F.col("rn"), F.lit(n))).drop("_k", "_rn", "_prev", "psum")


def _clamp_compose(deltas, lo, hi):
    """Compose x -> min(hi, max(lo, x + d)) over ``deltas`` into (D, L, H)."""
    D, L, H = 0, lo, hi  # identity restricted to [lo, hi]: clamp(x + 0, lo, hi)
    first = True
    for d in deltas:
        if first:
            D, L, H = d, lo, hi
            first = False
        else:
            # clamp(clamp(y, L, H) + d, lo, hi) = clamp(y + d, clamp(L + d), clamp(H + d))
            D = D + d
            L = min(hi, max(lo, L + d))
            H = min(hi, max(lo, H + d))
    return D, L, H, first


def _stream_groups(batches, group_cols, fn):
    """Feed ``fn`` one whole group at a time from sorted Arrow batches.

    Rows arrive sorted by ``group_cols`` within the partition; a group may
    span batches, so only the group being read is held in memory.  Group
    columns are text or whole numbers without NULLs; a NULL text is a value.  ``fn``
    takes a dict of numpy arrays (one group) and returns a dict of equal-
    length lists; the outputs of one input batch leave as one pandas frame.
    """
    import numpy as np
    import pandas as pd

    out: dict[str, list] = {}

    def flush(parts):
        seg = {c: (np.concatenate([p[c] for p in parts]) if len(parts) > 1 else parts[0][c]) for c in parts[0]}
        for c, v in fn(seg).items():
            out.setdefault(c, []).extend(list(v))

    def emit():
        frame = pd.DataFrame(out)
        out.clear()
        return frame

    pending, pending_key = None, None
    for pdf in batches:
        n = len(pdf)
        if n == 0:
            continue
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        change = np.zeros(n, dtype=bool)
        change[0] = True
        for c in group_cols:
            change[1:] |= cols[c][1:] != cols[c][:-1]
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], n)
        for st, en in zip(starts, ends):
            k = tuple(cols[c][st] for c in group_cols)
            part = {c: v[st:en] for c, v in cols.items()}
            if pending is not None and k == pending_key:
                pending.append(part)
                continue
            if pending is not None:
                flush(pending)
            pending, pending_key = [part], k
        if out:
            yield emit()
    if pending is not None:
        flush(pending)
    if out:
        yield emit()


def _map_groups(df: DataFrame, group_cols: list[str], order_cols: list[str], fn, schema: str) -> DataFrame:
    """``fn`` per group: shuffle by the group, sort, stream (see ``_stream_groups``).

    One Python call per partition (not per group), Arrow batches in and out.
    """

    def run(batches):
        yield from _stream_groups(batches, group_cols, fn)

    return (
        df.repartition(*[F.col(c) for c in group_cols])
        .sortWithinPartitions(*group_cols, *order_cols)
        .mapInPandas(run, schema)
    )


def _keyed_log(attempts: DataFrame, key: str, ts: str, tiebreak: str, ok_col: str, width_s: int | None) -> DataFrame:
    """The narrow segmented log, written once, with its key as text.

    Python sees a NULL number as NaN, which equals nothing, and every number
    beside it as a double; text keeps every key apart and NULL a key.
    """
    kind = dict(attempts.dtypes)[key]
    # 0.0 makes -0.0 the 0.0 that Spark groups it with.
    k = F.hex(key) if kind == "binary" else (F.col(key) + 0.0 if kind in ("double", "float") else F.col(key)).cast("string")
    b = segments(attempts.select(k.alias(key), ts, tiebreak, ok_col), key, [ts, tiebreak], width_s)
    return b if width_s is None else numbering.saved(b, "attempt-log")


def _with_typed_key(df: DataFrame, key: str, key_type: str) -> DataFrame:
    """The key of ``_keyed_log`` in the type it came in."""
    return df.withColumn(key, F.unhex(key) if key_type == "binary" else F.col(key).cast(key_type))


def health_walk(
    attempts: DataFrame, key: str = "proxy_id", ts: str = "ts", tiebreak: str = "attempt_id", ok_col: str = "ok",
    width_s: int | None = None,
) -> DataFrame:
    """Proxy health after each attempt (+0.01 ok, −0.05 fail, in [0, 1])
    and the running success rate.

    Bit-equal to the sequential double fold (Q34: ten failures from 1.0 give
    0.4999999999999996, which is rate-limited).  Segment starts are first
    found exactly on integer hundredths (clamp maps compose associatively),
    then turned into exact doubles by folding only the steps between a
    segment start and its first strict clamp.
    """
    import pandas as pd

    b = _keyed_log(attempts, key, ts, tiebreak, ok_col, width_s)

    def summarise(g):
        oks = g[ok_col].astype(bool)
        deltas = [HEALTH_UP if o else HEALTH_DOWN for o in oks]
        D, L, H, _ = _clamp_compose(deltas, HEALTH_LO, HEALTH_HI)
        return {key: [g[key][0]], "_bucket": [int(g["_bucket"][0])], "D": [D], "L": [L], "H": [H],
                "n": [len(oks)], "fails": [int((~oks).sum())]}

    summ = _map_groups(
        b, [key, "_bucket"], [ts, tiebreak], summarise,
        f"{key} string, _bucket long, D long, L long, H long, n long, fails long",
    )

    def chain(g):
        x, n, f = HEALTH_START, 0, 0
        starts, ns, fs = [], [], []
        for D, L, H, cnt, fl in zip(g["D"], g["L"], g["H"], g["n"], g["fails"]):
            starts.append(x)
            ns.append(n)
            fs.append(f)
            x = min(H, max(L, x + int(D)))
            n += int(cnt)
            f += int(fl)
        return {key: g[key], "_bucket": g["_bucket"], "start": starts, "n0": ns, "f0": fs}

    carry = _map_groups(summ, [key], ["_bucket"], chain, f"{key} string, _bucket long, start long, n0 long, f0 long")
    joined = join_segments(b, carry, key)

    # Exact doubles: given the exact integer start of a bucket, the double
    # walk is start-independent from the first strict clamp on (the value is
    # then exactly 1.0 or 0.0).  Each bucket reports the steps before that
    # clamp and the double it ends with after it; a chain over the buckets of
    # one key folds only those prefixes to get every bucket's exact start.
    def tails(g):
        x = int(g["start"][0])
        ops, end, reset = [], float("nan"), False
        for o in g[ok_col]:
            y = x + (HEALTH_UP if o else HEALTH_DOWN)
            if y > HEALTH_HI or y < HEALTH_LO:
                reset = True
                x = HEALTH_HI if y > HEALTH_HI else HEALTH_LO
                end = 1.0 if x == HEALTH_HI else 0.0
                continue
            x = y
            if reset:
                end = min(1.0, end + 0.01) if o else max(0.0, end - 0.05)
            else:
                ops.append("u" if o else "d")
        return {key: [g[key][0]], "_bucket": [int(g["_bucket"][0])], "ops": ["".join(ops)], "end": [end],
                "reset": [reset]}

    tail = _map_groups(
        joined, [key, "_bucket"], [ts, tiebreak], tails,
        f"{key} string, _bucket long, ops string, end double, reset boolean",
    )

    def chain_double(g):
        x = 1.0
        starts = []
        for ops, end, reset in zip(g["ops"], g["end"], g["reset"]):
            starts.append(x)
            if reset:
                x = float(end)
            else:
                for c in ops:
                    x = min(1.0, x + 0.01) if c == "u" else max(0.0, x - 0.05)
        return {key: g[key], "_bucket": g["_bucket"], "x0": starts}

    dcarry = _map_groups(tail, [key], ["_bucket"], chain_double, f"{key} string, _bucket long, x0 double")
    joined = join_segments(joined, dcarry, key)

    def walk(g):
        x = float(g["x0"][0])
        total, failed = int(g["n0"][0]), int(g["f0"][0])
        hs, rs = [], []
        for o in g[ok_col]:
            total += 1
            if not o:
                failed += 1
            rs.append((total - failed) / total)
            x = min(1.0, x + 0.01) if o else max(0.0, x - 0.05)
            hs.append(x)
        return {key: g[key], ts: g[ts], tiebreak: g[tiebreak], "health_score": hs, "success_rate": rs}

    out_schema = f"{key} string, {ts} {dict(attempts.dtypes)[ts]}, {tiebreak} {dict(attempts.dtypes)[tiebreak]}, health_score double, success_rate double"
    walked = _map_groups(joined, [key, "_bucket"], [ts, tiebreak], walk, out_schema)
    return _with_typed_key(walked, key, dict(attempts.dtypes)[key])


def breaker_step(state, ok, t):
    """One attempt through the breaker (also used by the streaming twin).

    ``state`` is ``('c', failures)`` or ``('o', last_failure_epoch_s)``;
    returns ``(new_state, allowed)``.
    """
    if state[0] == "c":
        if ok:
            return ("c", 0), True
        k = state[1] + 1
        return (("o", t) if k >= BREAKER_THRESHOLD else ("c", k)), True
    if t - state[1] > BREAKER_RECOVERY_S:
        return (("c", 0) if ok else ("o", t)), True
    return state, False


def health_step(x: float, ok: bool) -> float:
    """One attempt of the health walk on the double value (streaming twin)."""
    return min(1.0, x + 0.01) if ok else max(0.0, x - 0.05)


def breaker_replay(
    attempts: DataFrame, key: str = "method", ts: str = "ts", tiebreak: str = "attempt_id", ok_col: str = "ok",
    width_s: int | None = None,
) -> DataFrame:
    """Circuit-breaker state per method replayed over the attempt log.

    States: closed with 0..4 failures, or open since the last failure time.
    A closed breaker lets every attempt through; an open one refuses until
    more than 60 s have passed since its last failure, then lets one probe
    through (half-open): a success closes it, a failure re-opens it (the
    count is still >= 5).  A refused attempt changes nothing (Q22–Q23).

    Each segment is summarised in one backward pass for every possible start
    state; the per-key chain over buckets picks the real start state;
    the final replay runs each segment once from it.
    """
    import numpy as np
    import pandas as pd

    b = _keyed_log(attempts, key, ts, tiebreak, ok_col, width_s)
    ts_type = dict(attempts.dtypes)[ts]

    def secs(arr):
        return (np.asarray(arr).astype("datetime64[us]").astype("int64") / 1e6).tolist()

    step = breaker_step

    def summarise(g):
        """End state of the segment from each closed start and each first probe.

        One pass from the last row back: ``ends[k]`` is the end state when the
        rows so far are entered closed with k failures, ``probe[j]`` when row j
        is the probe of an open breaker.
        """
        oks, times = g[ok_col].astype(bool).tolist(), secs(g[ts])
        m = len(oks)
        ends = [("c", float(k)) for k in range(BREAKER_THRESHOLD)]
        probe: list = [None] * m
        after = m  # first row more than the recovery time after row j
        for j in range(m - 1, -1, -1):
            while after - 1 > j and times[after - 1] - times[j] > BREAKER_RECOVERY_S:
                after -= 1
            if oks[j]:
                probe[j] = ends[0]
                ends = [ends[0]] * BREAKER_THRESHOLD
            else:
                probe[j] = probe[after] if after < m else ("o", times[j])
                ends = [*ends[1:], probe[j]]
        rows = [("c", float(k), -1.0, *ends[k]) for k in range(BREAKER_THRESHOLD)]
        # Probes lie in the first recovery window or are the first row past it;
        # of neighbours with one end state the last stands for all.
        cutoff = times[0] + BREAKER_RECOVERY_S
        last = next((j for j in range(m) if times[j] > cutoff), m - 1)
        for j in range(last + 1):
            if j == last or probe[j] != probe[j + 1]:
                rows.append(("o", float(j), times[j], *probe[j]))
        n = len(rows)
        names = ("start_kind", "start_arg", "probe_ts", "end_kind", "end_arg")
        out = {name: [r[i] for r in rows] for i, name in enumerate(names)}
        return {key: [g[key][0]] * n, "_bucket": [int(g["_bucket"][0])] * n, **out, "first_ts": [times[0]] * n}

    summ_schema = (
        f"{key} string, _bucket long, start_kind string, start_arg double, probe_ts double, "
        "end_kind string, end_arg double, first_ts double"
    )
    summ = _map_groups(b, [key, "_bucket"], [ts, tiebreak], summarise, summ_schema)

    def chain(g):
        pdf = pd.DataFrame(g)
        out = []
        state = ("c", 0)
        for bkt, seg in pdf.groupby("_bucket", sort=True):
            out.append((seg[key].iloc[0], bkt, state[0], float(state[1])))
            if state[0] == "c":
                r = seg[(seg.start_kind == "c") & (seg.start_arg == float(state[1]))].iloc[0]
            else:
                opens = seg[seg.start_kind == "o"].sort_values("start_arg")
                allowed = opens[opens.probe_ts - state[1] > BREAKER_RECOVERY_S]
                if len(allowed) == 0:
                    continue  # every attempt refused: state unchanged
                r = allowed.iloc[0]
            state = (r.end_kind, r.end_arg if r.end_kind == "o" else int(r.end_arg))
        return {key: [o[0] for o in out], "_bucket": [o[1] for o in out], "s_kind": [o[2] for o in out],
                "s_arg": [o[3] for o in out]}

    carry = _map_groups(summ, [key], ["_bucket"], chain, f"{key} string, _bucket long, s_kind string, s_arg double")
    joined = join_segments(b, carry, key)

    def replay(g):
        kind, arg = g["s_kind"][0], g["s_arg"][0]
        state = ("c", int(arg)) if kind == "c" else ("o", float(arg))
        oks, times = g[ok_col].astype(bool).tolist(), secs(g[ts])
        states, allowed, fcs, last_fail = [], [], [], []
        lf = state[1] if state[0] == "o" else None
        for ok, t in zip(oks, times):
            state, a = step(state, ok, t)
            allowed.append(a)
            if a and not ok:
                lf = t
            if state[0] == "c":
                states.append("closed")
                fcs.append(state[1])
            else:
                states.append("open")
                fcs.append(BREAKER_THRESHOLD)
            last_fail.append(lf)
        return {key: g[key], ts: g[ts], tiebreak: g[tiebreak], "allowed": allowed, "state": states,
                "failure_count_at_least": fcs, "last_failure_epoch": last_fail}

    out_schema = (
        f"{key} string, {ts} {ts_type}, {tiebreak} {dict(attempts.dtypes)[tiebreak]}, allowed boolean, "
        "state string, failure_count_at_least long, last_failure_epoch double"
    )
    replayed = _map_groups(joined, [key, "_bucket"], [ts, tiebreak], replay, out_schema)
    return _with_typed_key(replayed, key, dict(attempts.dtypes)[key])


def session_starts(log: DataFrame, key: str, ts: str, tiebreak: str, duration_s: float) -> DataFrame:
    """``(key, ts, tiebreak, created_at)``, the opening time of the session that holds each row.

    The first row of a key opens a session; it holds for less than
    ``duration_s``, and the next row after that opens the next.  A segment is
    summarised by where it leaves off for each row that can be the first to
    open a session in it; the chain over a key's segments picks the real one.
    """
    import numpy as np

    ts_type, id_type, key_type = (dict(log.dtypes)[c] for c in (ts, tiebreak, key))
    rows = log.withColumn("_none", F.lit(True))
    b = _keyed_log(rows, key, ts, tiebreak, "_none", None)
    width = int(duration_s * 1_000_000)

    def micros(arr):
        return np.asarray(arr).astype("datetime64[us]").astype("int64")

    def summarise(g):
        """Per possible first opening row: its time and that of the segment's last opening."""
        t = micros(g[ts])
        m = len(t)
        after = np.searchsorted(t, t + width)  # first row of the next session
        last = t.copy()
        for j in range(m - 1, -1, -1):
            if after[j] < m:
                last[j] = last[after[j]]
        # A session that is open on entry ends a duration after the first row at the latest.
        n = min(m, int(np.searchsorted(t, t[0] + width)) + 1)
        return {key: [g[key][0]] * n, "_bucket": [int(g["_bucket"][0])] * n, "opens": t[:n], "last": last[:n]}

    summ = _map_groups(b, [key, "_bucket"], [ts, tiebreak], summarise, f"{key} string, _bucket long, opens long, last long")

    def chain(g):
        out, state = [], None
        starts = np.flatnonzero(np.r_[True, g["_bucket"][1:] != g["_bucket"][:-1]])
        for a, z in zip(starts, [*starts[1:], len(g["_bucket"])]):
            out.append((int(g["_bucket"][a]), state))
            opens = g["opens"][a:z]
            j = 0 if state is None else int(np.searchsorted(opens, state + width))
            if j < len(opens):
                state = int(g["last"][a + j])
        return {key: [g[key][0]] * len(out), "_bucket": [o[0] for o in out], "open": [-1 if o[1] is None else o[1] for o in out], "is_open": [o[1] is not None for o in out]}

    carry = _map_groups(summ, [key], ["_bucket", "opens"], chain, f"{key} string, _bucket long, open long, is_open boolean")
    joined = join_segments(b, carry, key)

    def walk(g):
        state = int(g["open"][0]) if g["is_open"][0] else None
        out = []
        for t in micros(g[ts]).tolist():
            if state is None or t - state >= width:
                state = t
            out.append(state)
        return {key: g[key], ts: g[ts], tiebreak: g[tiebreak], "created": out}

    walked = _map_groups(joined, [key, "_bucket"], [ts, tiebreak], walk, f"{key} string, {ts} {ts_type}, {tiebreak} {id_type}, created long")
    made = walked.withColumn("created_at", F.timestamp_micros("created").cast(ts_type)).drop("created")
    return _with_typed_key(made, key, key_type)
