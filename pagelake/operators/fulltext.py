"""A stored inverted index, appended to batch by batch, and ranked search over it.

The index is a Parquet table of postings ``(term, doc_id, tf)`` in folders by
batch and by bucket of the term, sorted by term in each file.  A search reads
only the buckets of its words (``PartitionFilters``), and in them only the row
groups that can hold the words (``PushedFilters``); no text is read or split
again.

A batch is written into a folder of its own with overwrite, so a retried append
replaces itself.  A term that most documents hold has one posting a document:
its bucket is written by as many tasks as its size asks for (``rebalance``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
MODES = ("all", "any")


def terms(text: Column) -> Column:
    """Lower-case runs of word characters, in order, repeats kept."""
    return F.filter(F.split(F.lower(text), r"\W+"), lambda t: t != "")


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``(term, doc_id, tf, bucket)``, one row per term and document.

    A document's rows are in one task, so the partial aggregate already has
    one row per term and document; repeats in a text are not shuffled.
    """
    words = docs.select(F.col(doc_id).alias("doc_id"), F.explode(terms(F.col(text))).alias("term"))
    tf = words.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    return tf.withColumn("bucket", term_bucket(F.col("term"), buckets))


def append(docs: DataFrame, path: str, batch: int, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> None:
    """Add documents that the index does not hold yet, as ``batch``.

    Documents without text have no postings but count as documents.
    """
    laid = postings(docs, doc_id, text, buckets).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
    laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    counted = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    counted.write.mode("overwrite").parquet(f"{path}/documents/batch={batch}")


def query_terms(spark: SparkSession, text: str, buckets: int = BUCKETS) -> dict[str, int]:
    """The distinct words of a query text and their buckets, by the rules of the index."""
    words = spark.range(1).select(F.explode(F.array_distinct(terms(F.lit(text)))).alias("term"))
    return {r.term: r.bucket for r in words.select("term", term_bucket(F.col("term"), buckets).alias("bucket")).collect()}


def matching(spark: SparkSession, path: str, words: dict[str, int]) -> DataFrame:
    """The postings of ``words`` (term → bucket), read from their buckets only."""
    stored = spark.read.schema("term string, doc_id long, tf long, batch int, bucket int").parquet(f"{path}/postings")
    return stored.where(F.col("bucket").isin(sorted(set(words.values()))) & F.col("term").isin(sorted(words))).select("term", "doc_id", "tf")


def search(spark: SparkSession, path: str, text: str, mode: str = "all", limit: int = 50, buckets: int = BUCKETS) -> DataFrame:
    """Documents that hold all (or any) words of ``text`` by Σ tf·ln(documents / documents with the word).

    Returns ``(doc_id, matched, score)``, the best ``limit``; scores have six
    decimals, equal ones go by id.
    A text without words finds nothing.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    words = query_terms(spark, text, buckets)
    found = matching(spark, path, words)
    n = spark.read.schema("n_docs long, batch int").parquet(f"{path}/documents").agg(F.sum("n_docs").alias("n_docs"))
    # One row a query word.
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))
    weighted = found.join(F.broadcast(df), "term").withColumn("w", F.col("tf") * F.log(F.col("n_docs") / F.col("df")))
    scored = weighted.groupBy("doc_id").agg(F.count(F.lit(1)).alias("matched"), F.round(F.sum("w"), 6).alias("score"))
    if mode == "all":
        scored = scored.where(F.col("matched") == len(words))
    return scored.orderBy(F.col("score").desc(), "doc_id").limit(limit)
