"""Training-corpus pipeline over ``documents``: five stages, each one operator.

language ID -> exact dedup -> near dedup -> substring dedup -> packing.

Each stage reads what the one before it wrote.  All but the last return the
columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import langid, naming, ordermin, packing, substrings
from pagelake.llm.common import nested, quoted, table, unused
from pagelake.operators.numbering import saved
from pagelake.session import configure

#: A document goes if no language is found in it or it fits none that was learned.
MIN_LANGUAGE_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified (operator 10), learned from the labelled rows."""
    configure(spark)
    found = langid.identify(nested(docs, text=F.col("text")), langid.train(docs))
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return found.where(known).select("doc.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (operator 5)."""
    return naming.survivors(_ready(spark, docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (operator 8)."""
    return ordermin.survivors(_ready(spark, docs))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has (operator 3).

    A document that loses words keeps the others, joined by one space; one that
    loses none keeps its text as it is.  No document is dropped.
    """
    _ready(spark, docs)
    row, kept = unused(docs, "_row", "_kept")
    cut = substrings.dedup(docs).where("n_removed > 0").select(F.col("rid").alias(row), F.col("kept").cast("string").alias(kept))
    joined = docs.withColumn(row, F.monotonically_increasing_id()).join(cut, row, "left")
    new = {"text": F.coalesce(kept, "text"), "n_chars": F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept).cast("long"))}
    return joined.select(*[new.get(c, F.col(quoted(c))).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens (operator 1)."""
    out = packing.pack(_ready(spark, docs), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _ready(spark: SparkSession, docs: DataFrame) -> DataFrame:
    configure(spark)
    return docs


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: SQL has no classifier, alignment or tokenizer; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row over ``documents``; what each keeps is written and read again."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
