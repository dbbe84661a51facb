"""Stateful streams that fold in event order, whatever order rows arrive in.

Each key keeps its rows of the last ``delay`` in state (a reorder buffer).  When
the watermark passes them they are folded in (time, id) order, together with
what falls due without input: a breaker's recovery, a cache entry's expiry, the
periodic check of a proxy.  An event-time timer wakes a key that is silent.

A row that comes after its key has been folded past it is *late*.  It changes
nothing and goes to a side output.  For Spark not to drop it first, the
watermark column runs ``GRACE`` ahead of the event time and the watermark's
delay is longer by the same; only rows later than that are dropped, and counted
in the query progress (``numRowsDroppedByWatermark``).

State of a key: its carry (a few numbers), its buffered rows, one timer.  The
buffer holds ``delay`` of a key's rows, never its history; a worker holds a few
sorted blocks of it at once.

A stream that ends leaves the rows of its last ``delay`` in the buffers.  Clock
rows, a second file source of bare times, move the watermark on without data:
a service drops one from time to time, a finished replay drops one at its end.
"""

from __future__ import annotations

import datetime as dt
import pickle
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from pagelake.operators import ordered as O
from pagelake.streaming import streams as ST

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GRACE_DAYS = 3650
CLOCK_SCHEMA = "ts timestamp_ntz"
RUN = 65_536  # rows of a key that are sorted at once
BLOCK = 8192  # rows of a block of a key's buffer
STEP = 64  # blocks that are folded at once
TOLD = 10_000  # rows of a frame that a fold tells

# --------------------------------------------------------------------------
# Folds: what one key does with a row, and with time
# --------------------------------------------------------------------------


class Fold:
    """One key's state machine; times are microseconds.

    ``fields`` are the columns it reads, the first of them breaks ties in time;
    ``carry`` is the schema of its state; ``out`` that of the rows it tells.
    """

    fields: list[str]
    carry: str
    out: str

    def start(self) -> tuple:
        raise NotImplementedError

    def row(self, carry: tuple, t: int, row: tuple) -> tuple[tuple | None, list[tuple]]:
        """State after the row (None: nothing worth keeping) and the rows to tell."""
        raise NotImplementedError

    def due(self, carry: tuple) -> int | None:
        """When something happens without input, after rows of that very time."""
        return None

    def at(self, carry: tuple, t: int) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError


def report_status(health: float) -> str:
    """Status that a reported result gives a proxy."""
    return "blocked" if health < 0.3 else "rate_limited" if health < 0.5 else "active"


def sweep_status(health: float) -> str:
    """Status that the periodic check gives a proxy."""
    return "blocked" if health < 0.2 else "rate_limited" if health < 0.4 else "active"


class HealthFold(Fold):
    """T4: health walk after each attempt, and the periodic re-classification.

    Every ``every_s`` seconds each proxy is classified again from its health, by
    limits of its own.  A check that changes a status is told as a row of kind
    ``sweep``; one that does not, is none.  Without new attempts a second check
    finds what the first did, so only the first one after an attempt needs a timer.
    """

    fields = ["attempt_id", "ok"]
    carry = "health double, total long, failed long, status string, last long"
    out = "kind string, attempt_id long, at_us long, health_score double, success_rate double, status_before string, status string"

    def __init__(self, every_s: int = 300):
        self.every = every_s * 1_000_000

    def start(self):
        return 1.0, 0, 0, "active", 0

    def row(self, carry, t, row):
        x, total, failed, before, _ = carry
        x = O.health_step(x, row[1])
        total, failed = total + 1, failed + (not row[1])
        status = report_status(x)
        return (x, total, failed, status, t), [("attempt", row[0], t, x, (total - failed) / total, before, status)]

    def due(self, carry):
        return -(-carry[4] // self.every) * self.every if sweep_status(carry[0]) != carry[3] else None

    def at(self, carry, t):
        x, total, failed, before, last = carry
        status = sweep_status(x)
        return (x, total, failed, status, last), [("sweep", None, t, x, (total - failed) / total, before, status)]


class BreakerFold(Fold):
    """T5: circuit breaker after each attempt, and its changes of state.

    An open breaker goes half-open ``BREAKER_RECOVERY_S`` after its last failure
    whether or not an attempt comes; every change is told as a row of kind
    ``change``.
    """

    fields = ["attempt_id", "ok"]
    carry = "kind string, failures long, last double, state string"
    out = "kind string, attempt_id long, at_us long, allowed boolean, state_before string, state string, failure_count_at_least long"

    def start(self):
        return "c", 0, 0.0, "closed"

    def row(self, carry, t, row):
        kind, failures, last, before = carry
        step = ("c", failures) if kind == "c" else ("o", last)
        step, allowed = O.breaker_step(step, row[1], t / 1e6)
        state = "closed" if step[0] == "c" else before if not allowed else "open"
        failures, last = (step[1], last) if step[0] == "c" else (O.BREAKER_THRESHOLD, step[1])
        told = [("attempt", row[0], t, allowed, before, "closed" if step[0] == "c" else "open", failures)]
        if state != before:
            told.append(("change", row[0], t, allowed, before, state, failures))
        return (step[0], failures, last, state), told

    def due(self, carry):
        return round((carry[2] + O.BREAKER_RECOVERY_S) * 1e6) if carry[3] == "open" else None

    def at(self, carry, t):
        kind, failures, last, before = carry
        return (kind, failures, last, "half_open"), [("change", None, t, None, before, "half_open", failures)]


class ChangeFold(Fold):
    """Each observation beside the last one of its key."""

    fields = ["event_id", "event_type", "value"]
    carry = "seen boolean, event_type string, value double"
    out = "event_id long, seen boolean, prev_type string, event_type string, prev_value double, value double"

    def start(self):
        return False, None, None

    def row(self, carry, t, row):
        seen, kind, value = carry
        return (True, row[1], row[2]), [(row[0], seen, kind, row[1], value, row[2])]


class CacheFold(Fold):
    """An entry lives for ``ttl_s`` after the last success, then its state goes."""

    fields = ["attempt_id", "status"]
    carry = "last long"
    out = "attempt_id long, hit boolean"

    def __init__(self, ttl_s: int):
        self.ttl = ttl_s * 1_000_000

    def start(self):
        return (None,)

    def row(self, carry, t, row):
        last = carry[0]
        hit = last is not None and t - last < self.ttl
        last = t if row[1] == "success" else last
        return None if last is None else (last,), [(row[0], hit)]

    def due(self, carry):
        return None if carry[0] is None else carry[0] + self.ttl

    def at(self, carry, t):
        return None, []


# --------------------------------------------------------------------------
# The processor
# --------------------------------------------------------------------------


def _sorted(parts: list[list]) -> list:
    """Columns (time, fields) of ``parts``, one after the other, in (time, id) order."""
    import numpy as np

    cols = [np.concatenate([p[i] for p in parts]) for i in range(len(parts[0]))]
    t, ids = cols[:2]
    if ids.dtype == object:
        keys = [(at, i is None, i) for at, i in zip(t.tolist(), ids.tolist())]
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
    else:
        order = np.lexsort((ids, t))
    return [c[order] for c in cols]


class InOrder(StatefulProcessor):
    """Reorder buffer, carry and timer of each key around a ``Fold``.

    The buffer is an external sort: a key with few rows has them beside its
    place, one with many in sorted blocks of ``BLOCK`` rows, each a map entry.
    Folding goes by time, a few blocks at once, and tells its rows in frames of
    ``TOLD``; so a hot key is never held as a whole.
    """

    def __init__(self, fold: Fold, buffered: str, columns: list[str]):
        self.fold, self.buffered, self.columns = fold, buffered, columns
        # pandas turns whole numbers beside NULLs into doubles.
        self.whole = [c.split()[1] in ("bigint", "long", "int", "smallint", "tinyint") for c in buffered.split(", ")]

    def init(self, handle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "block long", "rows binary")
        self.carry = handle.getValueState("carry", self.fold.carry)
        # Up to where the key has been folded, the timer that is set (-1: none), the rows
        # beside it, and number, first time of each block.
        self.place = handle.getValueState("place", "folded long, timer long, held binary")

    def _placed(self) -> tuple:
        folded, timer, held = self.place.get() or (-1, -1, None)
        return (folded, timer, *(pickle.loads(bytes(held)) if held else (None, [])))

    def _arrays(self, pdf) -> list:
        """Time and fields of the data rows; a NULL makes a column one of objects, with None."""
        # By place (key, watermark column, time, clock, fields): names do not all come through.
        own = pdf[~pdf.iloc[:, 3].astype(bool)].iloc[:, [2, *range(4, pdf.shape[1])]]
        out = []
        for i, whole in enumerate(self.whole):
            values = own.iloc[:, i]
            has = values.notna().to_numpy()
            if has.all() and values.dtype.kind in "iufb":
                out.append(values.to_numpy().astype("int64") if whole else values.to_numpy())
            else:
                plain = values.astype(object).to_numpy(copy=True)
                plain[~has] = None
                if whole:
                    plain[has] = [int(v) for v in plain[has]]
                out.append(plain)
        return out

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np

        folded, timer, held, blocks = self._placed()
        parts = [] if held is None else [held]
        size, new = sum(len(p[0]) for p in parts), False
        for pdf in rows:
            cols = self._arrays(pdf)
            ready = np.array([t is not None and t > folded for t in cols[0]], bool) if cols[0].dtype == object else cols[0] > folded
            if not ready.all():
                late = [c[~ready].tolist() for c in cols[:2]]
                yield self._frame([(key[0], True, t, *self._late(i)) for t, i in zip(*late)])
            if ready.any():
                new = True
                parts.append([c[ready].astype("int64") if i == 0 else c[ready] for i, c in enumerate(cols)])
                size += int(ready.sum())
            if size > RUN:
                self._spill(parts, blocks)
                parts, size = [], 0
        if new:
            yield from self._fold(key, parts, blocks, timerValues, folded, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        folded, _, held, blocks = self._placed()
        yield from self._fold(key, [] if held is None else [held], blocks, timerValues, folded, -1)

    def close(self) -> None:
        pass

    def _late(self, row_id) -> list:
        """Out columns of a late row: its id, nothing else."""
        return [row_id if c == self.fold.fields[0] else None for c in self.columns[3:]]

    def _frame(self, rows: list[tuple]):
        import pandas as pd

        return pd.DataFrame(rows, columns=self.columns, dtype=object)

    def _spill(self, parts: list[list], blocks: list[tuple]) -> None:
        """Rows sorted into blocks of the state; ``blocks`` has number and first time of each."""
        cols = _sorted(parts)
        number = max((n for n, _ in blocks), default=-1) + 1
        for at in range(0, len(cols[0]), BLOCK):
            part = [c[at : at + BLOCK] for c in cols]
            self.blocks.updateValue((number,), (pickle.dumps(part, 5),))
            blocks.append((number, int(part[0][0])))
            number += 1

    def _ready(self, parts: list[list], blocks: list[tuple], upto: int):
        """Rows up to ``upto`` in order, a few blocks at once; what is left stays in both lists."""
        import numpy as np

        open_ = {len(blocks) and max(n for n, _ in blocks) + 1: _sorted(parts)} if parts else {}
        blocks.sort(key=lambda b: b[1])
        while True:
            cut = upto + 1
            if len(blocks) > STEP:
                # Every row before the cut is in a block that begins before it.
                cut = min(cut, max(blocks[STEP][1], blocks[0][1] + 1))
            while blocks and blocks[0][1] < cut:
                number, _ = blocks.pop(0)
                open_[number] = pickle.loads(bytes(self.blocks.getValue((number,))[0]))
                self.blocks.removeKey((number,))
            heads = []
            for number in sorted(open_):
                cols = open_[number]
                n = int(np.searchsorted(cols[0], cut))
                if n:
                    heads.append([c[:n] for c in cols])
                    if n < len(cols[0]):
                        open_[number] = [c[n:] for c in cols]
                    else:
                        del open_[number]
            if heads:
                yield _sorted(heads) if len(heads) > 1 else heads[0]
            if cut > upto:
                break
        parts[:] = [open_[number] for number in sorted(open_)]

    def _fold(self, key, parts, blocks, timerValues, folded, timer):
        fold = self.fold
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        carry = self.carry.get()
        told: list[tuple] = []

        def wait(until: int, carry):
            """What falls due before ``until``."""
            while carry is not None and (due := fold.due(carry)) is not None and due < until:
                carry, out = fold.at(carry, due)
                told.extend((key[0], False, due, *o) for o in out)
            return carry

        for cols in self._ready(parts, blocks, upto):
            for t, *row in zip(*[c.tolist() for c in cols]):
                carry = wait(t, carry)
                carry, out = fold.row(fold.start() if carry is None else carry, t, tuple(row))
                for o in out:
                    told.append((key[0], False, t, *o))
                if len(told) >= TOLD:
                    yield self._frame(told)
                    told.clear()
        if upto > 0:
            carry = wait(upto + 1, carry)
        if carry is None:
            self.carry.clear()
        else:
            self.carry.update(carry)
        if sum(len(p[0]) for p in parts) > BLOCK:
            self._spill(parts, blocks)
            parts = []
        held = _sorted(parts) if parts else None
        nexts = [at for _, at in blocks]
        if held is not None:
            nexts.append(int(held[0][0]))
        if carry is not None and (due := fold.due(carry)) is not None:
            nexts.append(due)
        # Milliseconds, rounded up: the watermark is past the time when the timer fires.
        want = -(-min(nexts) // 1000) if nexts else -1
        if timer != want:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if want >= 0:
                self.handle.registerTimer(want)
        kept = pickle.dumps((held, blocks), 5) if held is not None or blocks else None
        self.place.update((max(folded, upto), want, kept))
        if told:
            yield self._frame(told)


# --------------------------------------------------------------------------
# Building and running
# --------------------------------------------------------------------------


def clock_stream(spark: SparkSession, path: str) -> DataFrame:
    """The clock rows below ``path``, one micro-batch a file."""
    return spark.readStream.schema(CLOCK_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def tick(spark: SparkSession, path: str, at: dt.datetime) -> None:
    """Drop one clock row: no row older than ``at`` less the delay is to come."""
    spark.createDataFrame([(at,)], CLOCK_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def in_event_order(rows: DataFrame, key: str, fold: Fold, delay_s: int, clock: DataFrame | None = None) -> DataFrame:
    """``rows`` (a stream with ``ts``) folded by ``key`` in event order.

    Returns ``key, late, event_us`` and the columns of the fold.  A NULL key is a key;
    a row without a time is late.
    """
    spark = rows.sparkSession
    key_type = rows.schema[key].dataType
    types = {f: rows.schema[f].dataType for f in fold.fields}
    times = lambda c: F.unix_micros(c.cast("timestamp")).alias("_t")
    data = rows.select(F.col(key), F.col("ts"), times(F.col("ts")), F.lit(False).alias("_clock"), *fold.fields)
    if clock is not None:
        nothing = [F.lit(None).cast(types[f]).alias(f) for f in fold.fields]
        data = data.unionByName(clock.select(F.lit(None).cast(key_type).alias(key), "ts", times(F.col("ts")), F.lit(True).alias("_clock"), *nothing))
    ahead = (F.col("ts").cast("timestamp") + F.expr(f"INTERVAL {GRACE_DAYS} DAYS")).alias("event_time")
    timed = data.select(key, ahead, "_t", "_clock", *fold.fields).withWatermark("event_time", f"{delay_s + GRACE_DAYS * 86_400} seconds")
    schema = f"{key} {key_type.simpleString()}, late boolean, event_us long, {fold.out}"
    columns = [key, "late", "event_us", *[c.split()[0] for c in fold.out.split(", ")]]
    buffered = "_t long, " + ", ".join(f"{f} {t.simpleString()}" for f, t in types.items())
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return timed.groupBy(key).transformWithStateInPandas(
        statefulProcessor=InOrder(fold, buffered, columns), outputStructType=schema, outputMode="append", timeMode="EventTime"
    )


def to_folders(df: DataFrame, path: str, ckpt: str) -> StreamingQuery:
    """Told rows to ``path/told``, late ones to ``path/late``; a retried batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        batch.where("NOT late").drop("late").write.mode("overwrite").parquet(f"{path}/told/_batch={batch_id}")
        batch.where("late").drop("late").write.mode("overwrite").parquet(f"{path}/late/_batch={batch_id}")
        batch.unpersist()

    w = df.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).outputMode("append")
    return ST.run_available_now(w.trigger(availableNow=True).start())


def disorder_s(table: DataFrame, ts: str = "ts") -> int:
    """Seconds by which the files of a table, in the order a file stream takes them, go back in time.

    Files of one modification time may come in any order.
    """
    files = table.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("written")).agg(
        F.min(ts).alias("lo"), F.max(ts).alias("hi")
    )
    steps = files.groupBy("written").agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    before = F.max("hi").over(W.orderBy("written").rowsBetween(W.unboundedPreceding, -1))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    back = F.greatest(us(before) - us(F.col("lo")), F.when(F.col("n") > 1, us(F.col("hi")) - us(F.col("lo"))), F.lit(0))
    most = steps.select(back.alias("back")).agg(F.max("back")).first()[0] or 0
    return -(-int(most) // 1_000_000)


def replay(
    spark: SparkSession, source: Callable[[], DataFrame], table: DataFrame, key: str, fold: Fold, path: str, delay_s: int = 600
) -> tuple[DataFrame, DataFrame]:
    """A finished table as a stream, to its end: ``(told, late)`` rows.

    ``source`` gives the stream, ``table`` the same rows with ``ts`` at rest.  The
    delay is widened by the disorder of the table's files, so none of its rows is
    late; the last clock row lies behind all that can fall due.
    """
    delay_s += disorder_s(table)
    last = table.agg(F.max("ts")).first()[0]
    clock = f"{path}/clock"
    spark.createDataFrame([], CLOCK_SCHEMA).write.mode("append").parquet(clock)
    run = lambda: to_folders(in_event_order(source(), key, fold, delay_s, clock_stream(spark, clock)), path, f"{path}/ckpt")
    run()
    if last is not None:
        tick(spark, clock, last + dt.timedelta(days=2, seconds=delay_s))
        run()
    return spark.read.parquet(f"{path}/told").drop("_batch"), spark.read.parquet(f"{path}/late").drop("_batch")


def change_rows(told: DataFrame, key: str = "user_id") -> DataFrame:
    """The changes among the pairs that ``ChangeFold`` tells (a first sighting reports nothing)."""

    def arrow(a: Column, b: Column) -> Column:
        return F.when(a != b, F.concat(a, F.lit(" -> "), b))

    kinds = arrow(F.col("prev_type"), F.col("event_type")).alias("type_change")
    values = arrow(F.col("prev_value").cast("string"), F.col("value").cast("string")).alias("value_change")
    out = told.where("seen").select(key, "event_id", kinds, values)
    return out.where(F.col("type_change").isNotNull() | F.col("value_change").isNotNull())
