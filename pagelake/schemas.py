"""Explicit schemas (§1.3): storage DDL and the typed model tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TS, TSN = T.TimestampType(), T.TimestampNTZType()
ARR_S = T.ArrayType(S)
MAP_SS = T.MapType(S, S)


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


PAGES = T.StructType([_f("page_id", L), _f("url", S), _f("html", S)])

SCRAPE_RESULTS = T.StructType(
    [
        _f("id", L, False),
        _f("url", S, False),
        _f("domain", S, False),
        _f("method_used", S, False),
        _f("status", S, False),
        _f("status_code", I),
        _f("response_time", D),
        _f("timestamp", TSN, False),
        _f("title", S),
        _f("content_length", I),
        _f("links_count", I),
        _f("images_count", I),
        _f("data_json", S),
        _f("links", ARR_S),
        _f("images", ARR_S),
        _f("error_message", S),
        _f("created_at", TSN),
    ]
)
# Columns declared NOT NULL in the stored table (K2); F16 checks them before K1.
SCRAPE_RESULTS_REQUIRED = ["url", "domain", "method_used", "status", "timestamp"]

REQUESTS = T.StructType(
    [
        _f("request_id", S),
        _f("url", S),
        _f("method", S),
        _f("priority", S),
        _f("auth_type", S),
        _f("headers", MAP_SS),
        _f("cookies", MAP_SS),
        _f("selectors", MAP_SS),
        _f("wait_conditions", ARR_S),
        _f("timeout", I),
        _f("max_retries", I),
        _f("retry_delay", I),
        _f("extract_links", B),
        _f("extract_images", B),
        _f("extract_text", B),
    ]
)

PROXIES = T.StructType(
    [
        _f("host", S),
        _f("port", I),
        _f("proxy_type", S),
        _f("provider", S),
        _f("country", S),
        _f("region", S),
        _f("city", S),
        _f("status", S),
        _f("health_score", D),
        _f("success_rate", D),
        _f("total_requests", I),
        _f("failed_requests", I),
        _f("pool_name", S),
    ]
)

SERVERS = T.StructType(
    [_f("name", S), _f("host", S), _f("port", I), _f("country", S), _f("region", S), _f("city", S), _f("load", D), _f("latency", D)]
)

TASKS = T.StructType(
    [
        _f("task_id", S),
        _f("url", S),
        _f("status", S),
        _f("created_at", TSN),
        _f("started_at", TSN),
        _f("completed_at", TSN),
        _f("result_id", L),
        _f("error", S),
    ]
)

# Fixed value sets of the enums (allowed values, F16).
METHOD_VALUES = ["scrapy", "pydoll", "playwright"]
PRIORITY_RANK = [("low", 1), ("normal", 2), ("high", 3), ("urgent", 4)]
AUTH_VALUES = ["none", "basic", "bearer", "oauth", "form", "custom"]
RESULT_STATUS_VALUES = ["pending", "running", "success", "failed", "timeout", "blocked", "rate_limited"]
PROXY_STATUS_VALUES = ["active", "inactive", "blocked", "rate_limited", "failed"]
