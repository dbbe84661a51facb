"""Operator 12, mixing sources to target weights by subset-sum budget fitting.

Each source has a target in words.  Its documents are counted by exact length;
whole repeats of the source cover the target as often as they fit, and the
budget that remains is fitted on the counts: a proportional share of every
length first, then a bounded-knapsack dynamic program over the last
``BUDGET`` words.  Which documents of a length are taken is settled by a seeded
order of them.

Scale: texts are read once, to count their words.  What is shuffled are rows of
an id, a source and a length.  A source reaches the dynamic program as one row
a distinct length, at most sqrt(2 * words of the source) rows however many
documents it has.  The seeded order is one range sort over all rows, so a length
that a third of all documents share is spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import table, word_counts
from pagelake.llm.registry import query
from pagelake.operators.numbering import global_rank, saved

WEIGHTS = (1, 2, 3)
REPEATS = 3
SEED = 12
BUDGET = 1 << 14  # words that the dynamic program fits at the least


# --------------------------------------------------------------------------
# Fitting a budget on length counts
# --------------------------------------------------------------------------


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length, at most ``counts``, come nearest to ``budget`` (under it, in a tie)."""
    limit = 2 * budget  # farther over the budget than nothing is under it
    reached = np.zeros(limit + 1, bool)
    reached[0] = True
    by = np.full(limit + 1, -1, np.int32)  # bundle that first reached a sum
    bundles: list[tuple[int, int]] = []  # (which length, how many of it)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        left, size = min(counts[i], limit // lengths[i]), 1
        while left > 0 and not reached[budget]:
            size = min(size, left)
            step = size * lengths[i]
            sums = np.flatnonzero(reached[: limit + 1 - step]) + step
            sums = sums[~reached[sums]]
            by[sums] = len(bundles)
            reached[sums] = True
            bundles.append((i, size))
            left -= size
            size *= 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    take = [0] * len(lengths)
    while at:
        i, size = bundles[by[at]]
        take[i] += size
        at -= size * lengths[i]
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, keep: int = BUDGET) -> np.ndarray:
    """Documents of each length (ascending, positive) whose words come near ``budget``, less than all of them."""
    total = int((lengths * counts).sum())
    take = np.zeros(lengths.size, np.int64)
    if budget > keep and total:
        # The margin keeps the product's rounding from passing the budget.
        take = np.floor(counts * ((budget - keep) / total) * (1 - 1e-12)).astype(np.int64)
    left = budget - int((take * lengths).sum())
    # Roundings add up to more than the program fits: longest documents first.
    for i in range(lengths.size - 1, -1, -1):
        if left <= keep:
            break
        more = min(int(counts[i] - take[i]), (left - keep) // int(lengths[i]))
        take[i] += more
        left -= more * int(lengths[i])
    open_ = np.flatnonzero((counts > take) & (lengths <= 2 * left))
    if left > 0 and open_.size:
        take[open_] += knapsack(lengths[open_].tolist(), (counts - take)[open_].tolist(), left)
    return take


# --------------------------------------------------------------------------
# Targets
# --------------------------------------------------------------------------


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``(key, source_size, target)`` from ``(key, source_size)``, one row a source.

    Sources by key take the weights in turn and share all words.  A target
    stops at ``repeats`` times its source; what is above is shared again.
    """
    ranked = global_rank(sources, [F.col("key")], "at")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    rows = saved(ranked.select("key", "source_size", weight.alias("weight"), (repeats * F.col("source_size")).alias("most")), "mix-sources")
    total = int(rows.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        # Words a unit of weight, over the sources that are not full at the last level.
        over = F.col("weight") * F.lit(level) >= F.col("most") if full >= 0 else F.lit(False)
        now = rows.agg(F.count_if(over).alias("full"), F.sum(F.when(over, F.col("most"))).alias("words"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if now.full == full or not now.weight:
            break
        full, level = now.full, (total - int(now.words or 0)) / int(now.weight)
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level))
    return rows.select("key", "source_size", target.alias("target"))


# --------------------------------------------------------------------------
# The mix
# --------------------------------------------------------------------------

PLAN = "key string, size long, first long, source_size long, target double, whole long, more long"


def _plan(repeats: int, keep: int):
    def run(lengths: pd.DataFrame) -> pd.DataFrame:
        lengths = lengths.sort_values("size", ignore_index=True)
        words, target = int(lengths["source_size"][0]), int(round(lengths["target"][0]))
        whole = min(repeats, target // words) if words else 0
        more = np.zeros(len(lengths), np.int64)
        if words and whole < repeats:
            real = lengths["size"].to_numpy() > 0
            more[real] = fit(lengths["size"].to_numpy()[real], lengths["n"].to_numpy()[real], target - whole * words, keep)
        return lengths.assign(whole=whole, more=more)[["key", "size", "first", "source_size", "target", "whole", "more"]]

    return run


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED, keep: int = BUDGET,
    doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """Every row with the words the mix takes of it: ``(doc_id, size, source_size, target, taken)``.

    A null or empty text has size 0 and is not taken; a null source is a source
    of its own, the last.  Repeated rows and ids are documents like others.
    ``taken`` is a whole number of copies of the document, up to ``repeats``.  The
    choice depends on the seed and the ids, not on how rows are laid out.  An
    empty table gives an empty result; other columns are not read.
    """
    # Null sources sort behind all others.
    key = F.coalesce(F.concat(F.lit("1"), F.col(f"`{source}`").cast("string")), F.lit("2"))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), key.alias("key"), F.col(f"`{text}`").alias("text"))
    sized = saved(word_counts(rows, "doc_id", "key").withColumnRenamed("n_words", "size"), "mix-sizes")
    order = [F.col("key"), F.col("size"), F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    ranked = global_rank(sized, order, "at")
    lengths = saved(ranked.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")), "mix-lengths")
    sources = lengths.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(saved(sources, "mix-source-sizes"), weights, repeats)
    plan = saved(lengths.join(goals, "key").groupBy("key").applyInPandas(_plan(repeats, keep), PLAN), "mix-plan")
    # Both sides are tables, so that Spark may split a hot length in the join.
    copies = F.col("whole") + F.when(F.col("at") - F.col("first") < F.col("more"), 1).otherwise(0)
    return ranked.join(plan, ["key", "size"]).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


@query("op12_budget_mixing")
def op12(spark, sf_dir):
    """The mix of all documents, with sources weighing 1, 2, 3 in turn."""
    return mix(table(spark, sf_dir, "documents"))
