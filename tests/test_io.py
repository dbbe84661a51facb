"""Sinks and file sources: write to a scratch folder, read back, compare."""

import datetime as dt
import json

from pyspark.sql import functions as F

from pagelake.sinks import writers as K
from pagelake.sources import files as S
from pagelake.sources import tables

T0 = dt.datetime(2024, 1, 31)


def _results(spark):
    return tables.scrape_results(spark, "/root/testdata/sf0.001")


def test_append_partitioned_and_expire(spark, tmp_path):
    r = _results(spark)
    path = str(tmp_path / "store")
    bad = K.append_results(r, path)
    assert bad.count() == 0
    stored = spark.read.parquet(path)
    assert stored.count() == r.count()
    assert "date" in stored.columns
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    cutoff = T0 - dt.timedelta(days=10)
    expect_deleted = r.where(F.col("timestamp") < F.lit(cutoff)).count()
    expect_kept = r.count() - expect_deleted
    deleted = K.expire(spark, path, as_of, days=10)
    assert deleted == expect_deleted > 0
    # The whole store: nothing old is left and nothing else is lost.
    after = spark.read.parquet(path)
    assert after.count() == expect_kept
    assert after.where(F.col("timestamp") < F.lit(cutoff)).count() == 0
    assert K.expire(spark, path, as_of, days=10) == 0


def test_expire_whole_days_and_boundary(spark, tmp_path):
    ts = [dt.datetime(2024, 1, d, h) for d in range(1, 11) for h in (0, 6, 12, 18)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "id long, timestamp timestamp_ntz")
    for hour, label in ((0, "at midnight"), (12, "inside a day"), (23, "after its last row")):
        path = str(tmp_path / label.replace(" ", "-"))
        K.with_day(df).write.partitionBy("date").parquet(path)
        cutoff = dt.datetime(2024, 1, 6, hour)
        as_of = F.lit(str(cutoff + dt.timedelta(days=30))).cast("timestamp_ntz")
        assert K.expire(spark, path, as_of, days=30) == sum(t < cutoff for t in ts)
        assert sorted(r.id for r in spark.read.parquet(path).collect()) == [i for i, t in enumerate(ts) if t >= cutoff]


def test_required_columns_quarantine(spark):
    r = _results(spark).limit(20).withColumn("url", F.when(F.col("id") % 2 == 0, F.col("url")))
    good, bad = K.check_required(r)
    assert good.count() + bad.count() == 20
    assert bad.where(F.array_contains("violations", "url is null")).count() == bad.count() > 0


def test_csv_roundtrip_wide_flatten(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, '{"a": "x", "b": {"c": 1}}'), (2, '{"a": "y"}'), (3, "not json")], "id long, data_json string"
    )
    wide = K.flatten_json_columns(df, ["data_json"])
    assert sorted(wide.columns) == ["data_a", "data_b", "id"]
    path = str(tmp_path / "csv")
    K.export_csv(wide, path)
    back = {r.id: r for r in S.read_csv(spark, path, "id long, data_a string, data_b string").collect()}
    assert back[1].data_a == "x" and json.loads(back[1].data_b) == {"c": 1}
    assert back[2].data_b is None and back[3].data_a is None


def test_json_files_and_missing_key_search(spark, tmp_path):
    d = tmp_path / "json"
    d.mkdir()
    docs = [{"k": 1, "color": "red"}, {"k": 2}, {"k": 3, "color": None}, {"k": 4, "color": "blue"}]
    for i, doc in enumerate(docs):
        (d / f"r{i}.json").write_text(json.dumps(doc, indent=2))
    assert S.read_json_results(spark, str(d)).count() == 4
    raw = S.read_json_documents(spark, str(d))
    hits = S.search_json(raw, "doc", {"color": "red"}).select(F.get_json_object("doc", "$.k").cast("int").alias("k"))
    # A missing key passes; an explicit null is present and unequal.
    assert sorted(r.k for r in hits.collect()) == [1, 2]


def test_xml_export(spark, tmp_path):
    r = _results(spark)
    path = str(tmp_path / "xml")
    K.export_xml(r, path)
    back = spark.read.format("xml").option("rowTag", K.XML_ROW_TAG).load(path)
    assert back.count() == r.where(F.col("status") == "success").count()


def test_xml_has_an_element_for_every_data_key(spark, tmp_path):
    data = ['{"title": "a < b & c", "tags": ["x", "y"], "my key": "v", "9th": 1, "gone": null, "deep": {"k": [1]}}', "{}", "not json", None]
    rows = [(f"u{i}", "success", dt.datetime(2024, 1, 1, 2, 3, 4, 5), d) for i, d in enumerate(data)] + [("f", "failed", None, "{}")]
    df = spark.createDataFrame(rows, "url string, status string, timestamp timestamp_ntz, data_json string")
    path = str(tmp_path / "xml")
    K.export_xml(df, path)
    text = "".join(p.read_text() for p in (tmp_path / "xml").glob("part-*"))
    assert "<title>a &lt; b &amp; c</title>" in text and "<my_key>v</my_key>" in text and "<_9th>1</_9th>" in text
    assert "<item>x</item>" in text and "gone" not in text and '<deep>{"k":[1]}</deep>' in text.replace("&quot;", '"')
    schema = "url string, timestamp string, data struct<title: string, tags: struct<item: array<string>>>"
    back = {r.url: r for r in spark.read.format("xml").option("rowTag", K.XML_ROW_TAG).schema(schema).load(path).collect()}
    assert set(back) == {"u0", "u1", "u2", "u3"}
    assert back["u0"].data.title == "a < b & c" and back["u0"].data.tags.item == ["x", "y"]
    assert back["u0"].timestamp == "2024-01-01T02:03:04.000005"


def test_workbook_is_written_from_one_pass(spark, tmp_path):
    r = _results(spark)
    path = str(tmp_path / "book")
    K.write_workbook(r, path)
    read = lambda name: spark.read.option("header", True).csv(f"{path}/{name}")
    assert read("main").count() == r.where(F.col("status") == "success").count()
    assert read("links").count() == r.agg(F.sum(F.size("links"))).first()[0]
    assert int(read("summary").first().total_results) == r.count()


def test_stored_reads_prune_days_and_push_filters(spark, tmp_path):
    from pagelake.operators import store as ST

    path = str(tmp_path / "store")
    K.append_results(_results(spark), path)
    one = tables.stored_results(spark, path, "2024-01-10", "2024-01-12").where(F.col("status") == "success").select("id", "title")
    shown = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else the list of filters is cut short
    plan = one._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", shown)
    assert "PartitionFilters: [isnotnull(date" in plan and "EqualTo(status,success)" in plan and "html" not in plan
    field = ST.json_field_equals(tables.stored_results(spark, path), "title", "x").select("id")
    assert "html" not in field._jdf.queryExecution().executedPlan().toString()


def test_server_list_defaults(spark, tmp_path):
    p = tmp_path / "servers.json"
    p.write_text(json.dumps([{"name": "a", "hostname": "a.example", "country": "US"}, {"name": "b", "port": 9, "load": 0.3}]))
    rows = {r.name: r for r in S.read_server_list(spark, str(p)).collect()}
    assert rows["a"].port == 1080 and rows["a"].load == 0.0 and rows["a"].latency == 0.0
    assert rows["b"].port == 9 and rows["b"].load == 0.3
    fb = S.fallback_servers(spark, [("x", "x.example", "DE")]).collect()[0]
    assert (fb.load, fb.latency) == (0.5, 100.0)


def test_dead_letter_and_messages(spark, tmp_path):
    r = _results(spark)
    path = str(tmp_path / "dlq")
    K.dead_letter(r, path)
    assert spark.read.parquet(path).count() == r.where(F.col("status") != "success").count()
    m = K.messages(r).limit(1).collect()[0]
    msg = json.loads(m.message)
    assert msg["type"] == "scrape_result" and set(msg["metrics"]) == {"response_time", "links_found", "images_found"}


def test_glob_invalidation():
    import re

    rx = re.compile(K.glob_to_regex("user:*:session?[ab]"))
    assert rx.match("user:42:session1a") and not rx.match("user:42:session1c")


def test_stored_results_prune_by_day(spark, tmp_path):
    r = _results(spark)
    path = str(tmp_path / "store")
    K.append_results(r, path)
    since, until = "2024-01-10", "2024-01-12"
    got = tables.stored_results(spark, path, since, until)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    want = r.where((F.col("timestamp") >= F.lit(since).cast("timestamp_ntz")) & (F.col("timestamp") < F.lit(until).cast("timestamp_ntz")))
    assert got.count() == want.count() > 0


def test_seed_requests_and_paged_urls(spark):
    pages = spark.createDataFrame([(1, "https://a.example/x"), (2, "https://b.example/y?q=1")], "page_id long, url string")
    seeds = spark.createDataFrame([("https://a.example/x",), ("https://c.example/z",)], "url string")
    got = {r.url: (r.page_id, r.state) for r in S.seed_requests(seeds, pages).collect()}
    assert got == {"https://a.example/x": (1, "fetched"), "https://c.example/z": (None, "pending")}
    paged = S.paged_urls(pages, 3).collect()
    assert len(paged) == 6
    assert {r.paged_url for r in paged if r.page_id == 2} == {f"https://b.example/y?q=1?page={n}" for n in (1, 2, 3)}
