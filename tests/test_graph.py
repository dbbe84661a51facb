"""Graph jobs against plain Python on a hand-made multi-level graph."""

import random
import re

from pyspark.sql import functions as F

from pagelake.operators import graph as G


def _graph(seed=3, n=60, m=240, hot="n0"):
    rnd = random.Random(seed)
    nodes = [f"n{i}" for i in range(n)]
    edges = {(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(m)}
    # A hot target that a third of the edges point at, and a chain for depth.
    edges |= {(s, hot) for s in nodes[: n // 3]}
    edges |= {(f"c{i}", f"c{i + 1}") for i in range(6)}
    edges.add(("n1", "c0"))
    return sorted(edges)


def _bfs(edges, seeds, max_depth):
    adj = {}
    for s, d in edges:
        adj.setdefault(s, []).append(d)
    depth = {s: 0 for s in seeds}
    level = list(seeds)
    for d in range(1, max_depth + 1):
        nxt = []
        for u in level:
            for v in adj.get(u, []):
                if v not in depth:
                    depth[v] = d
                    nxt.append(v)
        level = nxt
    return depth


def _pagerank(edges, damping, rounds):
    nodes = sorted({x for e in edges for x in e})
    n = len(nodes)
    out = {}
    for s, d in edges:
        out.setdefault(s, []).append(d)
    r = {v: 1.0 / n for v in nodes}
    for _ in range(rounds):
        dangling = sum(r[v] for v in nodes if v not in out)
        nr = {v: (1 - damping) / n + damping * dangling / n for v in nodes}
        for s, ds in out.items():
            for d in ds:
                nr[d] += damping * r[s] / len(ds)
        r = nr
    return r


def test_bfs_depths(spark):
    edges = _graph()
    df = spark.createDataFrame(edges, "src string, dst string")
    seeds = spark.createDataFrame([("n1",), ("n2",)], "url string")
    got = {r.url: r.depth for r in G.crawl_frontier(df, seeds, 5).collect()}
    assert got == _bfs(edges, ["n1", "n2"], 5)
    assert max(got.values()) == 5


def test_pagerank_matches_power_iteration(spark):
    edges = _graph()
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r.url: r.rank for r in G.pagerank(df, 0.85, 12).collect()}
    want = _pagerank(edges, 0.85, 12)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert abs(sum(got.values()) - 1.0) < 1e-9


def test_in_degree_and_duplicates(spark):
    edges = _graph()
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r.url: r.in_degree for r in G.in_degree(df).collect()}
    assert got["n0"] >= 20
    pages = spark.createDataFrame(
        [
            (1, "https://www.Shop.example.com/a/?utm_source=x&id=3#top"),
            (2, "http://shop.example.com/a?id=3"),
            (3, "http://shop.example.com/a?id=4"),
            (4, "https://shop.example.com/a/"),
        ],
        "page_id long, url string",
    )
    rows = {r.page_id: r for r in G.duplicate_urls(pages).collect()}
    assert rows[1].url_key == "shop.example.com/a?id=3"
    assert rows[2].first_id == 1 and rows[2].is_duplicate
    assert not rows[3].is_duplicate and rows[4].url_key == "shop.example.com/a"


def test_salting_splits_hot_domain(spark):
    rows = [(i, "hot.example.com") for i in range(300)] + [(300 + i, f"d{i}.example.com") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, domain string")
    out = G.salted_by_domain(df, 50)
    assert out.count() == 330
    per = {r.salt: r.n for r in out.where(F.col("domain") == "hot.example.com").groupBy("salt").agg(F.count("*").alias("n")).collect()}
    assert len(per) == 6 and max(per.values()) == 50


def test_a_round_does_not_move_the_edges(spark):
    """The ranks are shuffled to the placed edges, the contributions to their targets, nothing else."""
    edges = spark.createDataFrame(_graph(), "src string, dst string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with G.placed_edges(edges, target_rows=4) as placed:
            state = placed.groupBy(F.col("src").alias("url")).agg(F.max("out_deg").alias("out_deg"), F.max("salts").alias("salts"))
            state = state.withColumn("rank", F.lit(1.0)).checkpoint()
            plan = G.contributions(state, placed)._jdf.queryExecution().executedPlan().toString()
            assert state.agg(F.max("salts")).first()[0] > 1
            assert placed.count() == edges.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    lines = plan.split("\n")
    assert sum("Exchange hashpartitioning" in line for line in lines) == 2
    # From the edges' scan up to the join: no exchange on the way.
    at = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    depth = lambda line: re.search(r"[A-Za-z*(]", line).start()
    while "SortMergeJoin" not in lines[at]:
        assert "Exchange" not in lines[at]
        at = next(i for i in range(at - 1, -1, -1) if depth(lines[i]) < depth(lines[at]))


def test_hot_source_and_small_buckets_give_the_same_ranks(spark):
    edges = sorted(set(_graph()) | {("hub", f"n{i}") for i in range(50)})
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r.url: r.rank for r in G.pagerank(df, 0.85, 6, target_rows=3).collect()}
    want = _pagerank(edges, 0.85, 6)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("pagelake_edges")]


def test_salting_keeps_rows_without_a_domain(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "d") for i in range(40)], "page_id long, domain string")
    out = G.salted_by_domain(df, 5)
    assert out.count() == 40 and out.columns == ["page_id", "domain", "domain_rows", "buckets", "salt"]
    assert {(r.domain, r.domain_rows, r.buckets) for r in out.collect()} == {(None, 20, 4), ("d", 20, 4)}
