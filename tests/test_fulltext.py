"""The stored inverted index against a scan of the texts."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelake.operators import fulltext as FT

TEXTS = [
    (1, "The quick brown fox. The lazy dog"),
    (2, "quick QUICK quick"),
    (3, None),
    (4, ""),
    (5, "dog the fox's den, the dog-house"),
    (6, "über den Fluß the"),
    (7, "the " * 500 + "needle"),
]


def brute(rows, text, mode, limit=50):
    tf = {i: Counter(w for w in re.split(r"\W+", (t or "").lower(), flags=re.A) if w) for i, t in rows}
    words = sorted({w for w in re.split(r"\W+", text.lower(), flags=re.A) if w})
    df = {w: sum(1 for c in tf.values() if c[w]) for w in words}
    out = []
    for i, c in tf.items():
        found = [w for w in words if c[w]]
        if found and (mode == "any" or len(found) == len(words)):
            out.append((i, len(found), round(sum(c[w] * math.log(len(rows) / df[w]) for w in found), 6)))
    return sorted(out, key=lambda r: (-r[2], r[0]))[:limit]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    FT.append(docs.where("doc_id < 4"), path, 0)
    FT.append(docs.where("doc_id >= 4"), path, 1)
    return path


@pytest.mark.parametrize("mode", ["all", "any"])
@pytest.mark.parametrize("text", ["the dog", "Quick", "the fox den", "needle haystack", "THE the", "fox's", "ber flu", "quick the dog lazy brown fox"])
def test_search_equals_scan(spark, index, text, mode):
    got = [tuple(r) for r in FT.search(spark, index, text, mode).collect()]
    assert got == brute(TEXTS, text, mode)


def test_limit_and_empty_queries(spark, index):
    assert [tuple(r) for r in FT.search(spark, index, "the", "any", limit=2).collect()] == brute(TEXTS, "the", "any", 2)
    assert FT.search(spark, index, " ,.", "any").count() == FT.search(spark, index, "", "all").count() == 0
    with pytest.raises(ValueError):
        FT.search(spark, index, "the", "some")


def test_a_retried_append_replaces_itself_and_a_new_one_adds(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for _ in range(2):
        FT.append(docs.where("doc_id < 5"), path, 7)
    assert [tuple(r) for r in FT.search(spark, path, "dog quick", "any").collect()] == brute(TEXTS[:4], "dog quick", "any")
    FT.append(docs.where("doc_id >= 5"), path, 8)
    assert [tuple(r) for r in FT.search(spark, path, "dog quick", "any").collect()] == brute(TEXTS, "dog quick", "any")


def test_plan_reads_the_words_buckets_only(spark, index):
    words = FT.query_terms(spark, "the dog")
    plan = FT.matching(spark, index, words)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(term, [dog,the])" in plan and "ReadSchema: struct<term:string,doc_id:bigint,tf:bigint>" in plan
    found = FT.matching(spark, index, words).select(F.input_file_name().alias("f")).distinct().collect()
    read = {int(re.search(r"bucket=(\d+)", r.f)[1]) for r in found}
    assert read == set(words.values())


def test_hot_term_is_written_by_many_tasks(spark, tmp_path):
    """A term of every document: its bucket is split by size, not by term."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("hot "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
    try:
        FT.append(docs, str(tmp_path / "index"), 0, buckets=4)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    found = FT.matching(spark, str(tmp_path / "index"), FT.query_terms(spark, "hot", 4))
    assert found.count() == 4000
    assert found.select(F.input_file_name()).distinct().count() > 1
