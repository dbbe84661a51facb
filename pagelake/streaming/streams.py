"""Structured Streaming twins of the batch operators.

Sources are file streams over the driver tables (``maxFilesPerTrigger`` bounds
a micro-batch, so a hot key's rows in one batch are bounded by the trigger
size, never by the key's history).  Sinks are:

* **file sinks** (append) for row streams — exactly-once through the sink log;
* an **upsert log** for aggregates and latest-state tables: ``foreachBatch``
  writes each micro-batch to its own ``_batch=<id>`` folder with overwrite, so
  a retried batch replaces itself; readers take the last version per key.

Streams that fold a key's rows in event order (T2, T4, T5, T6) are in ``inorder``;
those here take a key's micro-batches as they arrive, each sorted by ``(ts, id)``.
Event-time aggregates use a 10-minute watermark; rows later than that are
dropped by Spark and counted in the query progress
(``numRowsDroppedByWatermark``).

Every folder (sink, checkpoint) lives under the session's checkpoint folder,
which on a cluster is the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelake.operators import ordered as O
from pagelake.session import checkpoint_dir, configure
from pagelake.sinks import writers as K
from pagelake.sources import tables

WATERMARK = "10 minutes"


# --------------------------------------------------------------------------
# Sources, folders, running
# --------------------------------------------------------------------------


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stream run under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1) -> DataFrame:
    """A driver table read as a file stream (schema taken from the footer)."""
    configure(spark)
    path = tables.table_path(sf_dir, name)
    schema = spark.read.parquet(path).schema
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.getFileStatus(location).isDirectory():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    # A table stored as one file: stream its folder, filtered to that file name.
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .option("pathGlobFilter", os.path.basename(path))
        .parquet(os.path.dirname(path))
    )


def event_time(df: DataFrame, ts: str = "ts", out: str = "event_time") -> DataFrame:
    """Watermarks need a zoned TIMESTAMP; the tables hold TIMESTAMP_NTZ.  The
    session zone is UTC, so the cast keeps the same instant."""
    return df.withColumn(out, F.col(ts).cast("timestamp"))


def run_available_now(query: StreamingQuery) -> StreamingQuery:
    """Wait for an ``availableNow`` query and surface its failure."""
    query.awaitTermination()
    err = query.exception()
    if err is not None:
        raise RuntimeError(f"stream {query.name} failed: {err}")
    return query


def to_files(df: DataFrame, path: str, ckpt: str, fmt: str = "parquet", name: str | None = None) -> StreamingQuery:
    """Append sink into ``path`` (exactly-once through the file sink log)."""
    w = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", ckpt).outputMode("append")
    if name:
        w = w.queryName(name)
    return run_available_now(w.trigger(availableNow=True).start())


def to_upsert_log(df: DataFrame, path: str, ckpt: str, output_mode: str = "update") -> StreamingQuery:
    """Each micro-batch overwrites its own ``_batch=<id>`` folder (idempotent on retry)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")

    w = df.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).outputMode(output_mode)
    return run_available_now(w.trigger(availableNow=True).start())


def read_upsert_log(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last written version of every key (partial ``max_by`` per key)."""
    log = spark.read.parquet(path)
    others = [c for c in log.columns if c not in keys and c != "_batch"]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col("_batch")).alias("_r")).select(*keys, "_r.*")


def pipeline(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """User processors chained in order (each ``DataFrame -> DataFrame``)."""
    for step in steps:
        df = df.transform(step)
    return df


def split_valid(df: DataFrame, ok: F.Column) -> tuple[DataFrame, DataFrame]:
    """Rows passing ``ok`` and the dead-letter rest (NULL counts as failing)."""
    flag = F.coalesce(ok, F.lit(False))
    return df.where(flag), df.where(~flag)


def run_pipeline(df: DataFrame, steps, ok: Callable[[DataFrame], F.Column], path: str, dead_path: str, ckpt: str) -> StreamingQuery:
    """Chained steps, then good rows to ``path`` and failing rows to the
    dead-letter folder, both per batch and idempotent."""
    out = pipeline(df, steps)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        good, bad = split_valid(batch, ok(batch))
        good.write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{dead_path}/_batch={batch_id}")
        batch.unpersist()

    w = out.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).outputMode("append")
    return run_available_now(w.trigger(availableNow=True).start())


# --------------------------------------------------------------------------
# Stateless and windowed streams
# --------------------------------------------------------------------------


def attempt_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11 as a stream: events stream joined with the static pages."""
    a = tables.attempts_from(table_stream(spark, sf_dir, "events"), tables.pages(spark, sf_dir))
    return a.withColumn("ok", F.col("status") == "success")


def minute_metrics(attempts: DataFrame, width: str = "1 minute") -> DataFrame:
    """Per method and tumbling minute: attempts, successes, mean time."""
    return (
        event_time(attempts)
        .withWatermark("event_time", WATERMARK)
        .groupBy(F.window("event_time", width).alias("w"), "method")
        .agg(
            F.count(F.lit(1)).alias("attempts"),
            F.count_if("ok").alias("successes"),
            F.sum("response_time").alias("_rt"),
        )
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            "method",
            "attempts",
            "successes",
            F.round(F.col("_rt") / F.col("attempts"), 6).alias("mean_response_time"),
        )
    )


def sliding_rate(attempts: DataFrame, width: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """Attempts, successes and requests a second per method over sliding windows.

    Each attempt counts in every window that holds it, width / slide of them,
    before the partial aggregate; what is shuffled is a row per window and task.
    """
    seconds = F.unix_seconds(F.col("w.end")) - F.unix_seconds(F.col("w.start"))
    return (
        event_time(attempts)
        .withWatermark("event_time", WATERMARK)
        .groupBy(F.window("event_time", width, slide).alias("w"), "method")
        .agg(F.count(F.lit(1)).alias("attempts"), F.count_if("ok").alias("successes"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            "method",
            "attempts",
            "successes",
            F.round(F.col("attempts") / seconds, 9).alias("requests_per_second"),
        )
    )


def daily_activity(attempts: DataFrame) -> DataFrame:
    """Rows per day as a tumbling day window with a watermark (A4's answer)."""
    return (
        event_time(attempts)
        .withWatermark("event_time", WATERMARK)
        .groupBy(F.window("event_time", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.to_date(F.col("w.start")).alias("date"), "count")
    )


def deal_alerts(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Stateless alert filter: unit price at or under the part's target."""
    p = part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", "p_name")
    j = lineitem.join(p, "l_partkey")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return j.where(unit <= F.col("p_retailprice")).select(
        "l_orderkey", "l_linenumber", "l_partkey", unit.alias("unit_price"), "p_retailprice"
    )


def task_updates(orders: DataFrame) -> DataFrame:
    """Task status updates (stand-in: orders as tasks), latest per task
    within the micro-batch; the upsert log keeps the latest across batches."""
    t = orders.select(
        F.col("o_orderkey").alias("task_id"),
        F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "running")
        .otherwise("failed")
        .alias("status"),
    )
    return t


def write_task_log(updates: DataFrame, path: str, ckpt: str) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        latest = batch.groupBy("task_id").agg(F.max_by(F.struct("ts", "status"), F.col("ts")).alias("_r"))
        latest.select("task_id", "_r.*").write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")

    w = updates.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).outputMode("append")
    return run_available_now(w.trigger(availableNow=True).start())


# --------------------------------------------------------------------------
# Stateful streams in order of arrival (one state row per key); ``inorder`` has event order
# --------------------------------------------------------------------------


def _sorted_group(pdfs, order: list[str]):
    import pandas as pd

    frames = [p for p in pdfs if len(p)]
    if not frames:
        return None
    return pd.concat(frames, ignore_index=True).sort_values(order, kind="mergesort").reset_index(drop=True)


def proxy_health(attempts: DataFrame, key: str = "proxy_id") -> DataFrame:
    """T4: health score and success rate after each attempt, per proxy, with
    the state ``(health, total, failed)`` carried across micro-batches."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    import pandas as pd

    def fold(k, pdfs, state):
        g = _sorted_group(pdfs, ["ts", "attempt_id"])
        if g is None:
            return
        x, total, failed = state.get if state.exists else (1.0, 0, 0)
        hs, rs = [], []
        for ok in g["ok"].astype(bool):
            total += 1
            failed += 0 if ok else 1
            x = O.health_step(x, ok)
            hs.append(x)
            rs.append((total - failed) / total)
        state.update((x, total, failed))
        yield pd.DataFrame({key: g[key], "attempt_id": g["attempt_id"], "health_score": hs, "success_rate": rs})

    return attempts.select(key, "ts", "attempt_id", "ok").groupBy(key).applyInPandasWithState(
        fold,
        f"{key} string, attempt_id long, health_score double, success_rate double",
        "health double, total long, failed long",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def breaker_states(attempts: DataFrame, key: str = "method") -> DataFrame:
    """T5: circuit-breaker state per method with the state ``(kind, arg)``
    carried across micro-batches (same step function as the W4 replay)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    import numpy as np
    import pandas as pd

    def fold(k, pdfs, state):
        g = _sorted_group(pdfs, ["ts", "attempt_id"])
        if g is None:
            return
        kind, arg = state.get if state.exists else ("c", 0.0)
        st = ("c", int(arg)) if kind == "c" else ("o", float(arg))
        times = (g["ts"].to_numpy().astype("datetime64[us]").astype("int64") / 1e6).tolist()
        allowed, states, fcs = [], [], []
        for ok, t in zip(g["ok"].astype(bool).tolist(), times):
            st, a = O.breaker_step(st, ok, t)
            allowed.append(a)
            states.append("closed" if st[0] == "c" else "open")
            fcs.append(st[1] if st[0] == "c" else O.BREAKER_THRESHOLD)
        state.update((st[0], float(st[1])))
        yield pd.DataFrame(
            {key: g[key], "attempt_id": g["attempt_id"], "allowed": allowed, "state": states,
             "failure_count_at_least": np.asarray(fcs, dtype="int64")}
        )

    return attempts.select(key, "ts", "attempt_id", "ok").groupBy(key).applyInPandasWithState(
        fold,
        f"{key} string, attempt_id long, allowed boolean, state string, failure_count_at_least long",
        "kind string, arg double",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def change_alerts(obs: DataFrame, key: str = "user_id") -> DataFrame:
    """Per key, the change of ``event_type`` and ``value`` against the last
    observation held in state (the first sighting reports nothing)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    import pandas as pd

    key_type = dict(obs.dtypes)[key]

    def fold(k, pdfs, state):
        g = _sorted_group(pdfs, ["ts", "event_id"])
        if g is None:
            return
        prev_t, prev_v = state.get if state.exists else (None, None)
        pts, pvs = [], []
        for t, v in zip(g["event_type"], g["value"]):
            pts.append(prev_t)
            pvs.append(prev_v)
            prev_t, prev_v = t, float(v)
        state.update((prev_t, prev_v))
        yield pd.DataFrame(
            {key: g[key], "event_id": g["event_id"], "prev_type": pts, "event_type": g["event_type"],
             "prev_value": pvs, "value": g["value"].astype(float)}
        )

    pairs = obs.select(key, "ts", "event_id", "event_type", "value").groupBy(key).applyInPandasWithState(
        fold,
        f"{key} {key_type}, event_id long, prev_type string, event_type string, prev_value double, value double",
        "last_type string, last_value double",
        "append",
        GroupStateTimeout.NoTimeout,
    )
    pt, ct = F.col("prev_type"), F.col("event_type")
    pv, cv = F.col("prev_value").cast("string"), F.col("value").cast("string")
    out = pairs.where(pt.isNotNull()).select(
        key,
        "event_id",
        F.when(pt != ct, F.concat(pt, F.lit(" -> "), ct)).alias("type_change"),
        F.when(pv != cv, F.concat(pv, F.lit(" -> "), cv)).alias("value_change"),
    )
    return out.where(F.col("type_change").isNotNull() | F.col("value_change").isNotNull())


def cache_ttl(attempts: DataFrame, ttl_s: int = K.CACHE_TTL_S) -> DataFrame:
    """TTL cache as keyed state.  Per URL the state holds the time of the
    last success; a request is a hit when that success is less than
    ``ttl_s`` old.  An event-time timeout evicts the entry once the watermark
    passes its expiry, so state holds only live entries."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    import pandas as pd

    ttl_us = ttl_s * 1_000_000

    def fold(k, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        g = _sorted_group(pdfs, ["ts", "attempt_id"])
        if g is None:
            return
        last = state.get[0] if state.exists else None
        times = g["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
        hits = []
        for t, st in zip(times, g["status"].tolist()):
            hits.append(last is not None and t - last < ttl_us)
            if st == "success":
                last = t
        if last is None:
            state.remove()
        else:
            state.update((last,))
            expiry_ms = (last + ttl_us) // 1000
            state.setTimeoutTimestamp(max(expiry_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"attempt_id": g["attempt_id"], "url": g["url"], "hit": hits})

    ev = event_time(attempts.select("url", "ts", "attempt_id", "status")).withWatermark("event_time", WATERMARK)
    return ev.groupBy("url").applyInPandasWithState(
        fold, "attempt_id long, url string, hit boolean", "last_success_us long", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def messages_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result messages as a stream; the page extraction is computed
    once and checkpointed, then joined to each micro-batch of attempts."""
    pages = tables.pages(spark, sf_dir)
    extracted = tables.extracted_basic(pages).checkpoint()
    attempts = tables.attempts_from(table_stream(spark, sf_dir, "events"), pages)
    return K.messages(tables.scrape_results_from(attempts, pages, extracted))
