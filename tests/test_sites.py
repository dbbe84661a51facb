"""Cache hit replay and the recursive flattener against plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pagelake.operators import reports as RP
from pagelake.plans import q_sites as QS

T0 = dt.datetime(2024, 1, 1)


def test_cache_hits_brute_force(spark):
    rnd = random.Random(11)
    rows, t = [], T0
    for i in range(2000):
        t += dt.timedelta(seconds=rnd.choice([1, 30, 400, 1800, 3599, 3600, 5000]))
        url = "hot" if rnd.random() < 0.4 else f"u{rnd.randrange(20)}"
        rows.append((i, url, t, "success" if rnd.random() < 0.6 else "failed"))
    df = spark.createDataFrame(rows, "id long, url string, timestamp timestamp_ntz, status string")
    got = {r.id: r.hit for r in QS.cache_hits(df, 3600).collect()}
    # Narrow fixed segments (many per TTL) give the same answer.
    assert {r.id: r.hit for r in QS.cache_hits(df, 3600, width_s=300).collect()} == got
    last = {}
    want = {}
    for i, url, ts, st in rows:
        prev = last.get(url)
        want[i] = prev is not None and (ts - prev).total_seconds() < 3600
        if st == "success":
            last[url] = ts
    assert got == want
    assert sum(want.values()) > 100


def test_flatten_nested(spark):
    df = spark.createDataFrame(
        [(1, ("a", ("x", 2)), ["p", "q"])],
        "id long, info struct<name: string, deep: struct<k: string, n: int>>, tags array<string>",
    )
    out = RP.flatten(df).collect()[0].asDict()
    assert out == {"id": 1, "info_name": "a", "info_deep_k": "x", "info_deep_n": 2, "tags": "p, q"}


def test_product_record_flattened(spark):
    df = spark.createDataFrame(
        [(" Widget ", "ACME", "$1,234.50", "$2,000.00", None, "In Stock now", ["/a.jpg", "/b.jpg", "/c.jpg"], "u", 0.2)],
        "name string, brand string, price string, original_price string, currency string, availability string, "
        "images array<string>, url string, response_time double",
    )
    r = RP.flatten(RP.product_record(df)).collect()[0]
    assert r.basic_info_name == "Widget" and r.pricing_current_price == 1234.5
    assert abs(r.pricing_discount - 38.275) < 1e-9 and r.pricing_currency == "USD"
    assert r.availability_in_stock and r.media_main_image == "/a.jpg" and r.media_gallery == "/b.jpg, /c.jpg"


def test_numbered_within_groups_matches_sort(spark):
    from pagelake.operators import store as ST

    rnd = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else f"g{rnd.randrange(7)}", rnd.randrange(50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, grp string, v long").repartition(5)
    got = {r.id: r.n for r in ST.numbered(df, [F.col("v").desc(), F.col("id")], group=["grp"], name="n").collect()}
    want = {}
    for g in {r[1] for r in rows}:
        members = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        want.update({r[0]: k + 1 for k, r in enumerate(members)})
    assert got == want
    glob = {r.id: r.number for r in ST.numbered(df, [F.col("id").desc()]).collect()}
    assert glob == {i: 3000 - i for i in range(3000)}
