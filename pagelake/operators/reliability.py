"""Proxy, server and method reliability.

Dimensions come from the driver's tables: a proxy is a user of the event
log (``proxy<user_id>``), its country is the nation of the customer with the
same key and its pool the region; a VPN server is a supplier.  Health and
success rate are the last state of the W2 walk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.functions import scoring as S
from pagelake.operators import ordered as O
from pagelake.operators import store

# Proxy choice weights (W12) and the VPN rotation threshold.
HEALTH_WEIGHTS = (0.7, 0.3)
VPN_FAILURE_THRESHOLD = 3
# Method capability flags (J13): javascript, cookies, screenshots, forms, speed rank.
CAPABILITIES = [
    ("scrapy", False, True, False, False, 1),
    ("pydoll", True, True, False, True, 2),
    ("playwright", True, True, True, True, 3),
]
# Events that stand for the selection of a proxy.
SELECTING = ("view", "click")
# Retry policy (X32): retryable codes and the default delay in seconds.
RETRY_DELAY_S = 5


def proxies_from(attempts: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Proxy dimension: one row per proxy with country, pool, usage and health."""
    walk = O.health_walk(attempts.withColumn("ok", F.col("status") == "success"))
    last = walk.groupBy("proxy_id").agg(
        F.max_by(F.struct("health_score", "success_rate"), F.struct("ts", "attempt_id")).alias("_s")
    )
    usage = attempts.groupBy("proxy_id", "user_id").agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(F.col("status") != "success").alias("failed_requests"),
        F.max("ts").alias("last_used"),
    )
    geo = (
        customer.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("n_nationkey"))
        .join(nation, "n_nationkey")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("user_id", F.col("n_name").alias("country"), F.col("r_name").alias("pool_name"))
    )
    p = usage.join(last, "proxy_id").join(geo, "user_id", "left")
    return p.select(
        "proxy_id",
        F.concat(F.col("proxy_id"), F.lit(".example.net")).alias("host"),
        F.lit(8080).alias("port"),
        F.lit("http").alias("proxy_type"),
        "country",
        F.coalesce("pool_name", F.lit("default")).alias("pool_name"),
        "total_requests",
        "failed_requests",
        "last_used",
        F.col("_s.health_score").alias("health_score"),
        F.col("_s.success_rate").alias("success_rate"),
        S.proxy_status(F.col("_s.health_score"), "per_result").alias("status"),
    )


def health_rank(proxies: DataFrame) -> DataFrame:
    """Rank within pool by 0.7·health + 0.3·success rate (first wins ties).

    Numbered by one range sort over pool and score, so a pool of any size is
    spread over many tasks.
    """
    wh, wr = HEALTH_WEIGHTS
    scored = proxies.withColumn("score", F.col("health_score") * wh + F.col("success_rate") * wr)
    return store.numbered(scored, [F.col("score").desc(), F.col("proxy_id")], ["pool_name"], "rank")


def least_used(proxies: DataFrame, usage_col: str = "total_requests") -> DataFrame:
    """Proxies whose usage equals the pool minimum (all ties are candidates).

    The minimum is a partial aggregate; the join is on pool and usage, which
    spreads a large pool by its usage.
    """
    least = proxies.groupBy(F.col("pool_name").alias("_pool")).agg(F.min(usage_col).alias("_min"))
    same = F.col("pool_name").eqNullSafe(F.col("_pool")) & (F.col(usage_col) == F.col("_min"))
    return proxies.join(least, same, "left_semi")


def geographic_candidates(proxies: DataFrame) -> DataFrame:
    """W14 + A24: proxies of the least common country (NULL → 'unknown') per pool."""
    c = proxies.withColumn("_country", F.coalesce("country", F.lit("unknown")))
    counts = c.groupBy("pool_name", "_country").agg(F.count(F.lit(1)).alias("country_count"))
    w = W.partitionBy("pool_name")
    least = counts.withColumn("_m", F.min("country_count").over(w)).where(F.col("country_count") == F.col("_m"))
    return c.join(least.select("pool_name", "_country", "country_count"), ["pool_name", "_country"]).drop("_country")


def pool_status(proxies: DataFrame) -> DataFrame:
    """Per pool total, active, blocked, failed (rate-limited counted apart)."""
    return proxies.groupBy("pool_name").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "blocked").alias("blocked"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "rate_limited").alias("rate_limited"),
    )


SESSION_TIMEOUT_S = 1800


def session_intervals(log: DataFrame, duration_s: int = SESSION_TIMEOUT_S, session: str = "session_id") -> DataFrame:
    """``(session, proxy_id, created_at, expires_at)`` of every sticky session in the log.

    A session keeps the proxy of the request that opened it; the first request
    ``duration_s`` or more later opens it anew.
    """
    started = O.session_starts(log, session, "ts", "attempt_id", duration_s)
    opening = started.where(F.col("created_at") == F.col("ts")).groupBy(session, "created_at").agg(F.min("attempt_id").alias("attempt_id"))
    own = opening.join(log.select("attempt_id", "proxy_id"), "attempt_id")
    return own.select(session, "proxy_id", "created_at", (F.col("created_at") + F.make_dt_interval(secs=F.lit(duration_s))).alias("expires_at"))


def sticky_proxies(log: DataFrame, duration_s: int = SESSION_TIMEOUT_S, session: str = "session_id") -> DataFrame:
    """The log with ``sticky_proxy``, the proxy of the session interval in force at each request.

    The as-of lookup is an equality: the walk that cuts the intervals gives
    each request the opening time of its own.
    """
    held = O.session_starts(log, session, "ts", "attempt_id", duration_s).select("attempt_id", "created_at")
    intervals = session_intervals(log, duration_s, session).select(
        F.col(session).alias("_session"), F.col("created_at").alias("_created"), F.col("proxy_id").alias("sticky_proxy")
    )
    rows = log.join(held, "attempt_id")
    return rows.join(intervals, rows[session].eqNullSafe(F.col("_session")) & (F.col("created_at") == F.col("_created"))).drop("_session", "_created")


def live_sessions(intervals: DataFrame, as_of: Column) -> DataFrame:
    """The sessions that hold at ``as_of``, one row a session at most."""
    return intervals.where((F.col("created_at") <= as_of) & (as_of < F.col("expires_at")))


def sessions_by_pool(proxies: DataFrame, live: DataFrame) -> DataFrame:
    """Live sessions in all, and of each pool's proxies, one row a pool."""
    held = live.groupBy("proxy_id").agg(F.count(F.lit(1)).alias("_held"))
    pools = proxies.join(held, "proxy_id", "left").groupBy("pool_name").agg(F.coalesce(F.sum("_held"), F.lit(0)).alias("pool_sessions"))
    return pools.crossJoin(F.broadcast(live.agg(F.count(F.lit(1)).alias("active_sessions"))))


def proxy_counters(attempts: DataFrame) -> DataFrame:
    """Per proxy the selections, and the zero-floored counters after its last event."""
    last = F.struct("ts", "attempt_id")
    return O.zero_floored_counters(attempts).groupBy("proxy_id").agg(
        F.count_if(F.col("event_type").isin(*SELECTING)).alias("selected_requests"),
        F.max_by("current_requests", last).alias("current_requests"),
        F.max_by("recent_failures", last).alias("recent_failures"),
    )


def active_in_country(proxies: DataFrame, country: str) -> DataFrame:
    """active proxies of a country, ignoring case."""
    return proxies.where((F.col("status") == "active") & (F.lower("country") == country.lower()))


def vpn_rotation_flag(counters: DataFrame, threshold: int = VPN_FAILURE_THRESHOLD) -> DataFrame:
    """A26 (Q25 fixed): sum of every proxy's latest recent-failure counter vs threshold."""
    latest = counters.groupBy("proxy_id").agg(
        F.max_by("recent_failures", F.struct("ts", "attempt_id")).alias("recent_failures")
    )
    return latest.agg(F.sum("recent_failures").alias("recent_failures_total")).withColumn(
        "rotate_vpn", F.col("recent_failures_total") >= threshold
    )


def servers_from(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """S8 stand-in: VPN servers (name, host, port, country, load, latency).

    Load is ``acctbal mod 100`` (non-negative), latency ``suppkey mod 250`` ms;
    missing values fall back to load 0 / latency 0 as in the loader.
    """
    return supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"], "left").select(
        F.col("s_name").alias("name"),
        F.concat(F.lower(F.regexp_replace("s_name", "#", "-")), F.lit(".vpn.example.net")).alias("host"),
        F.lit(1080).alias("port"),
        F.col("n_name").alias("country"),
        F.coalesce(F.pmod(F.col("s_acctbal"), F.lit(100.0)), F.lit(0.0)).alias("load"),
        F.coalesce(F.pmod(F.col("s_suppkey"), F.lit(250)).cast("double"), F.lit(0.0)).alias("latency"),
    )


def best_servers(servers: DataFrame, preferred: list[str] | None = None) -> DataFrame:
    """Rank servers per country by (load, latency, name), plus a global
    rank with the preferred-country order as first key."""
    # Both ranks use the distributed numbering (no single-task window), with
    # the name as the final tiebreak so the order is total.
    ranked = store.numbered(servers, [F.col("load"), F.col("latency"), F.col("name")], group=["country"], name="country_rank")
    preferred = preferred or []
    pos = F.array_position(F.array(*map(F.lit, preferred)).cast("array<string>"), F.col("country"))
    first_key = F.when(pos > 0, pos).otherwise(F.lit(len(preferred) + 1))
    overall = store.numbered(
        ranked.withColumn("_k", first_key), [F.col("_k"), F.col("load"), F.col("latency"), F.col("name")], name="overall_rank"
    )
    return overall.withColumn("preferred_rank", F.when(F.col("_k") <= len(preferred), F.col("_k"))).drop("_k").withColumn("server_health", S.server_health(F.col("load")))


def next_server(servers: DataFrame, current: DataFrame) -> DataFrame:
    """W15 + J11: best server excluding the current one(s) (anti join)."""
    rest = servers.join(current.select("name"), "name", "left_anti")
    return rest.orderBy("load", "latency", "name").limit(1)


def capability_table(spark) -> DataFrame:
    """Method capability flags (a fixed dimension of three rows)."""
    return spark.createDataFrame(
        CAPABILITIES, "method string, javascript boolean, cookies boolean, screenshots boolean, forms boolean, speed_rank int"
    )


def able_methods(requests: DataFrame, spark) -> DataFrame:
    """The methods that can serve each request: all its needed flags are set.

    ``requests`` has a boolean ``needs_<flag>`` for some flags; a null need is none.
    """
    flags = [c for c in ("javascript", "cookies", "screenshots", "forms") if f"needs_{c}" in requests.columns]
    able = F.lit(True)
    for c in flags:
        able = able & (~F.coalesce(F.col(f"needs_{c}"), F.lit(False)) | F.col(c))
    rows = requests.crossJoin(F.broadcast(capability_table(spark)))
    return rows.where(able)


STRATEGIES = ("speed", "quality", "cost", "reliability")


def suggest_method(requests: DataFrame, strategy: str = "speed", best: DataFrame | None = None) -> DataFrame:
    """Method by strategy from the request's needs.

    A request needs JavaScript if a wait condition contains "networkidle" or
    "javascript", a login if its auth type is not "none"; it is complex with
    more than two conditions.

    * speed: playwright for JavaScript, login or a complex request; else pydoll
      for high and urgent priority, scrapy for the rest;
    * quality: playwright for JavaScript or login; else pydoll if it has
      selectors, scrapy if not;
    * cost: scrapy without JavaScript and login; else pydoll unless complex,
      then playwright;
    * reliability: the best method of ``best`` (one row at most, column
      ``best_method``, as A9 gives), else playwright.

    Columns a request table lacks count as null, which means none.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    if strategy == "reliability":
        if best is None:
            return requests.withColumn("suggested_method", F.lit("playwright"))
        one = best.agg(F.coalesce(F.max("best_method"), F.lit("playwright")).alias("suggested_method"))
        return requests.crossJoin(F.broadcast(one))  # one row
    have = set(requests.columns)
    col = lambda name, none: F.coalesce(F.col(name), none) if name in have else none
    conditions = col("wait_conditions", F.array().cast("array<string>"))
    js = F.exists(conditions, lambda c: F.coalesce(c.contains("networkidle") | c.contains("javascript"), F.lit(False)))
    login = col("auth_type", F.lit("none")) != "none"
    complex_ = F.size(conditions) > 2
    urgent = col("priority", F.lit("normal")).isin("high", "urgent")
    selectors = F.size(col("selectors", F.create_map().cast("map<string,string>"))) > 0
    if strategy == "speed":
        m = F.when(js | login | complex_, "playwright").when(urgent, "pydoll").otherwise("scrapy")
    elif strategy == "quality":
        m = F.when(js | login, "playwright").when(selectors, "pydoll").otherwise("scrapy")
    else:
        m = F.when(~js & ~login, "scrapy").when(~complex_, "pydoll").otherwise("playwright")
    return requests.withColumn("suggested_method", m)


def retry_gaps(attempts: DataFrame) -> DataFrame:
    """Per request, attempt number, expected wait (2^n for 429, else the
    retry delay) and the actual gap to the previous attempt."""
    w = W.partitionBy("request_id").orderBy("ts", "attempt_id")
    n = F.row_number().over(w)
    prev_ts = F.lag("ts").over(w)
    prev_code = F.lag("status_code").over(w)
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(prev_ts.cast("timestamp"))
    return attempts.select(
        "request_id",
        "attempt_id",
        n.alias("attempt_number"),
        F.when(prev_code == 429, F.pow(F.lit(2.0), n - 1))
        .when(prev_code.isin(*S.RETRY_CODES), F.lit(float(RETRY_DELAY_S)))
        .alias("expected_wait_s"),
        (gap / 1e6).alias("actual_gap_s"),
        prev_code.isin(*S.RETRY_CODES).alias("is_retry"),
    )


def first_success(attempts: DataFrame, group: str = "request_id") -> DataFrame:
    """First successful attempt per request in method priority order;
    requests with none get one row with method 'none' and the fixed message."""
    prio = F.when(F.col("method") == "scrapy", 1).when(F.col("method") == "pydoll", 2).otherwise(3)
    failed = (F.col("status") != "success").cast("int")
    # min_by over (failed, priority, ts, id): a partial aggregate per request,
    # so a request with very many attempts is pre-reduced map-side.
    best = attempts.groupBy(group).agg(
        F.min_by(F.struct("method", "attempt_id", failed.alias("_failed")), F.struct(failed, prio, "ts", "attempt_id")).alias("_b")
    ).select(group, "_b.method", "_b.attempt_id", (1 - F.col("_b._failed")).alias("_ok"))
    ok = F.col("_ok") == 1
    return best.select(
        group,
        F.when(ok, F.col("method")).otherwise(F.lit("none")).alias("method_used"),
        F.when(ok, F.lit("success")).otherwise(F.lit("failed")).alias("status"),
        F.when(ok, F.col("attempt_id")).alias("attempt_id"),
        F.when(~ok, F.lit("All scraping methods failed")).alias("error_message"),
    )


def batch_outcome(requests: DataFrame, results: DataFrame, available: list[str]) -> DataFrame:
    """One row per request; requests of unavailable methods get an error row."""
    avail = F.array(*[F.lit(m) for m in available])
    j = requests.join(results, "request_id", "left")
    is_av = F.array_contains(avail, F.col("method"))
    return j.select(
        "request_id",
        "method",
        F.when(is_av, F.col("status")).otherwise(F.lit("failed")).alias("status"),
        F.when(is_av, F.col("error_type")).otherwise(F.lit("MethodUnavailableError")).alias("error_type"),
    )


def sticky_sessions(sessions: DataFrame, proxies: DataFrame, as_of: Column) -> DataFrame:
    """Session → proxy while ``as_of - created_at < duration`` and the proxy is active."""
    live = sessions.where(
        F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
        < F.col("duration_s") * 1_000_000
    )
    return live.join(proxies.where(F.col("status") == "active").select("proxy_id"), "proxy_id", "left_semi")
