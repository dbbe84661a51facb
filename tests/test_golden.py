"""Golden input → output pairs from the reference's sample results (FIXTURES.md §2)."""

import datetime as dt

from pyspark.sql import functions as F

from pagelake.functions import scoring as S
from pagelake.operators import reliability as R
from pagelake.operators import reports as RP
from pagelake.operators import stats as A
from pagelake.operators import store as ST

T0 = dt.datetime(2024, 1, 1)


def test_request_metrics_five_requests(spark):
    rows = [
        ("scrapy", 200, 0.5, "proxy-scrapy.example.com:8080", None),
        ("pydoll", 200, 0.3, "proxy-pydoll.example.com:8080", None),
        ("playwright", 200, 2.1, "proxy-playwright.example.com:8080", None),
        ("scrapy", 408, 5.0, "proxy-scrapy.example.com:8080", "timeout"),
        ("pydoll", 404, 0.2, "proxy-pydoll.example.com:8080", "not_found"),
    ]
    df = spark.createDataFrame(
        [(m, c, t, p, e, T0 + dt.timedelta(milliseconds=100 * i)) for i, (m, c, t, p, e) in enumerate(rows)],
        "method string, status_code int, response_time double, proxy_id string, error_type string, ts timestamp_ntz",
    )
    m = A.request_metrics(df).collect()[0]
    assert (m.total_requests, m.successful_requests, m.failed_requests) == (5, 3, 2)
    assert m.success_rate == 0.6 and abs(m.avg_response_time - 1.62) < 1e-12
    assert (m.min_response_time, m.max_response_time) == (0.2, 5.0)
    assert m.requests_per_second == 5.0
    f = {(r.dimension, r.value): r["count"] for r in A.frequency_maps(df).collect()}
    assert f[("status_code", "200")] == 3 and f[("status_code", "408")] == 1 and f[("status_code", "404")] == 1
    assert f[("method", "scrapy")] == 2 and f[("method", "playwright")] == 1
    assert f[("error_type", "timeout")] == 1 and f[("error_type", "not_found")] == 1


def test_method_metrics(spark):
    df = spark.createDataFrame(
        [("scrapy", 1.5, "success"), ("scrapy", 2.0, "success"), ("scrapy", 3.0, "failed")],
        "method string, response_time double, status string",
    )
    r = A.method_performance(df).collect()[0]
    assert r.requests == 3 and r.successful_requests == 2
    assert abs(r.success_rate - 2 / 3) < 1e-12 and abs(r.avg_response_time - 6.5 / 3) < 1e-12


def test_site_health_summary(spark):
    checks = spark.createDataFrame(
        [(200, 0.334097), (200, 2.078507), (200, 0.072519), (404, 0.075462)], "status_code int, response_time double"
    )
    scores = [r.s for r in checks.select(S.health_score("status_code", "response_time").alias("s")).collect()]
    assert scores == [100, 85, 100, 50]
    s = RP.health_summary(checks).collect()[0]
    assert (s.total_sites, s.healthy_count, s.issues_count) == (4, 3, 2)
    assert abs(s.avg_response_time - 0.64014625) < 1e-12 and s.health_percentage == 75.0


def test_engagement_and_prices(spark):
    posts = spark.createDataFrame([(42, 7, 3), (28, 5, 12), (15, 2, 8)], "likes int, shares int, comments int")
    assert [r.e for r in posts.select(S.engagement("likes", "shares", "comments").alias("e")).collect()] == [69, 67, 37]
    p = spark.createDataFrame([(88.23, 100.0), (93.01, 50.0)], "current_price double, target_price double")
    out = p.select(F.round(F.col("current_price") - F.col("target_price"), 2).alias("d"), (F.col("current_price") <= F.col("target_price")).alias("deal")).collect()
    assert [(r.d, r.deal) for r in out] == [(-11.77, True), (43.01, False)]


def test_proxy_choice_and_pool_status(spark):
    proxies = spark.createDataFrame(
        [("proxy1", "US", 0.9, 0.95, "pool", "active", 5), ("proxy2", "UK", 0.8, 0.85, "pool", "active", 5),
         ("proxy3", "US", 0.7, 0.75, "pool", "active", 5)],
        "proxy_id string, country string, health_score double, success_rate double, pool_name string, status string, total_requests long",
    )
    best = R.health_rank(proxies).where("rank = 1").collect()[0]
    assert best.proxy_id == "proxy1"
    st = R.pool_status(proxies).collect()[0]
    assert (st.total, st.active, st.blocked, st.failed) == (3, 3, 0, 0)
    geo = {r.proxy_id for r in R.geographic_candidates(proxies).collect()}
    assert geo == {"proxy2"}


def test_method_suggestions(spark):
    reqs = spark.createDataFrame(
        [(1, [], "none"), (2, ["networkidle"], "none"), (3, [], "form"), (4, ["a", "b", "networkidle"], "none")],
        "id int, wait_conditions array<string>, auth_type string",
    )
    speed = {r.id: r.suggested_method for r in R.suggest_method(reqs, "speed").collect()}
    quality = {r.id: r.suggested_method for r in R.suggest_method(reqs, "quality").collect()}
    cost = {r.id: r.suggested_method for r in R.suggest_method(reqs, "cost").collect()}
    assert speed[1] == "scrapy" and speed[2] == "playwright"
    assert quality[3] == "playwright"
    assert cost[1] == "scrapy" and cost[4] == "playwright"


def test_search_relevance_sixteen(spark):
    res = spark.createDataFrame(
        [(1, "https://httpbin.org/", "httpbin.org", "httpbin.org", '{"title":"httpbin.org"}', T0)],
        "id long, url string, domain string, title string, data_json string, timestamp timestamp_ntz",
    )
    r = ST.search(res, "httpbin").collect()[0]
    assert r.relevance_score == 16


def test_trending_topics(spark):
    posts = spark.createDataFrame(
        [(1, "This is a Social media example"), (2, "more social content"), (3, "nothing")], "id long, text string"
    )
    t = {r.topic: (r.mentions, r.trend_score) for r in RP.trending_topics(posts, "text", "id").collect()}
    assert t["social"] == (2, 20) and t["media"] == (1, 10) and t["content"] == (1, 10) and "demo" not in t
