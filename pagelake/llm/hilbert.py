"""Operator 6 [native], sharding along a Hilbert curve.

Several metadata dimensions are quantised to ``bits`` bits each, the row's
place on the Hilbert curve through that grid is computed with column
expressions only, rows are sorted by that place, and the sorted run is cut into
shards whose row counts differ by at most one.  Rows near each other in all
dimensions fall into the same few shards, so per-file minima and maxima prune
on each of the dimensions at once.

Strings are quantised by the rank of their value, so neighbours on the curve are
neighbours in the value too.

Scale: texts are read once; one range sort of narrow rows (no text) and a broadcast of one row per
partition.  Ties on the curve (a hot source, copies) are broken by text
checksum, id and row, so a hot grid cell is spread over partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import keyed, table, unused
from pagelake.llm.registry import query
from pagelake.operators.numbering import global_rank, saved

SHARDS = 40
BITS = 8
ROW_BYTES = 16


def quantised_log(column: Column, bits: int = BITS, steps: int = 8) -> Column:
    """Non-negative sizes on a logarithmic grid of ``steps`` cells a doubling."""
    cell = F.floor(F.log2(F.greatest(column, F.lit(0)) + 1) * steps)
    return F.least(cell, F.lit((1 << bits) - 1)).cast("int")


def with_cell(rows: DataFrame, column: str, cell: str, bits: int = BITS) -> DataFrame:
    """``rows`` with ``cell``: the place of the value of ``column`` among its sorted values, on the grid.

    Neighbours in the order of values are neighbours on the grid, so a file's
    minimum and maximum tell what it holds; null comes first.  The values, one
    row each, are numbered by a range sort of their own; Spark joins them by size.
    """
    values = global_rank(rows.select(F.col(column).alias("_value")).distinct(), [F.col("_value").asc_nulls_first()], "_place")
    # One row: the number of values.
    placed = values.crossJoin(F.broadcast(values.agg(F.count(F.lit(1)).alias("_values"))))
    cells = saved(placed.select("_value", F.floor(F.col("_place") * (1 << bits) / F.col("_values")).cast("int").alias(cell)), "value-cells")
    return rows.join(cells, rows[column].eqNullSafe(cells["_value"])).drop("_value")


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve through ``len(dims)`` dimensions of ``bits`` bits.

    The coordinates are turned into the transposed index bit plane by bit plane
    (high to low), then Gray-coded and interleaved.  The planes are folded with
    ``aggregate`` over arrays, so the expression does not grow with ``bits``.
    ``len(dims) * bits`` must stay below 63.
    """
    n = len(dims)
    if n * bits > 62:
        raise ValueError("the index must fit a long")
    axes = F.array(*[d.cast("long") for d in dims])
    planes = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    zero = F.lit(0).cast("long")

    def bit(value, plane):
        return F.call_function("getbit", value, plane)

    def plane_step(x, plane):
        low = F.call_function("shiftleft", F.lit(1).cast("long"), plane) - 1

        def dim_step(acc, i):
            # acc[0] is the running first coordinate, the rest follow in order.
            here = F.when(i == 0, acc[0]).otherwise(F.element_at(x, i + 1))
            swap = acc[0].bitwiseXOR(here).bitwiseAND(low)
            flip = bit(here, plane) == 1
            first = F.when(flip, acc[0].bitwiseXOR(low)).otherwise(acc[0].bitwiseXOR(swap))
            mine = F.when(flip, here).otherwise(here.bitwiseXOR(swap))
            return F.when(i == 0, F.array(first)).otherwise(F.concat(F.array(first), F.slice(acc, 2, n), F.array(mine)))

        return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.array(x[0]), dim_step)

    turned = F.aggregate(planes, axes, plane_step)

    def gray_step(acc, v):
        # Each coordinate is xored with the (already Gray-coded) one before it.
        last = F.when(F.size(acc) == 0, zero).otherwise(F.element_at(acc, -1))
        return F.concat(acc, F.array(last.bitwiseXOR(v)))

    gray = F.aggregate(turned, F.array().cast("array<long>"), gray_step)

    def interleave(g):
        high = F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1))
        mask = F.aggregate(
            high,
            zero,
            lambda t, p: F.when(bit(F.element_at(g, -1), p) == 1, t.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), p) - 1)).otherwise(t),
        )
        whole = F.transform(g, lambda v: v.bitwiseXOR(mask))
        return F.aggregate(planes, zero, lambda acc, p: F.aggregate(whole, acc, lambda a, v: a * 2 + bit(v, p).cast("long")))

    # The Gray code is bound once by a one-element transform, not repeated.
    return F.element_at(F.transform(F.array(gray), interleave), 1)


def shard(rows: DataFrame, dims: list[Column], ties: list[Column], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Add ``curve`` (Hilbert index), ``shard`` (0 .. shards-1) and ``slot``.

    Row counts of shards differ by at most one; ``slot`` is gapless from 0 in
    curve order within a shard.  ``ties`` complete the order of rows of one
    grid cell.  With fewer rows than shards the last shards are empty.
    """
    placed = rows.withColumn("curve", hilbert_index(dims, bits))
    ranked = global_rank(placed, [F.col("curve").asc(), *ties], "_rank")
    total = ranked.agg(F.count(F.lit(1)).alias("_total"))
    # One row: the number of rows.
    at = ranked.crossJoin(F.broadcast(total))
    small = F.floor(F.col("_total") / shards)
    wide = F.col("_total") % shards  # so many shards hold one row more
    edge = wide * (small + 1)
    rank = F.col("_rank")
    which = F.when(rank < edge, F.floor(rank / (small + 1))).otherwise(wide + F.floor((rank - edge) / F.greatest(small, F.lit(1))))
    start = F.when(F.col("shard") < wide, F.col("shard") * (small + 1)).otherwise(edge + (F.col("shard") - wide) * small)
    return (
        at.withColumn("shard", which.cast("int"))
        .withColumn("slot", (rank - start).cast("long"))
        .drop("_rank", "_total")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Shards of ``documents``: dimensions source, language and text size.

    Returns ``rid, doc_id, size, text_crc32, curve, shard, slot``.  A null text
    has no bytes; null source or language is a value of its own; a table
    without these columns uses the size alone for them.  Repeated rows and ids
    are separate rows.
    """
    have = set(docs.columns)
    extra = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("source", "lang")]
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id"),
        *extra,
        (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    rows = saved(rows, "shard-rows")  # numbers only; every later step reads them here
    for c in ("source", "lang"):
        rows = with_cell(rows, c, f"{c}_cell", bits)
    dims = [F.col("source_cell"), F.col("lang_cell"), quantised_log(F.col("size"), bits)]
    ties = [F.col("size").asc(), F.col("text_crc32").asc(), F.col("doc_id").asc_nulls_first(), F.col("rid").asc()]
    return shard(rows, dims, ties, shards, bits).drop("source", "lang", "source_cell", "lang_cell")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, bits: int = BITS) -> None:
    """Write whole documents, one folder ``shard=<n>`` a shard, rows in curve order.

    If ``docs`` has a column of that name, the folders' is ``shard_``.
    """
    row, slot, folder = unused(docs, "_row", "_slot", "shard")
    placed = shard_documents(docs, shards, bits).select(F.col("rid").alias(row), F.col("shard").alias(folder), F.col("slot").alias(slot))
    rows = docs.withColumn(row, F.monotonically_increasing_id()).join(placed, row)
    laid = rows.repartitionByRange(shards, folder, slot).sortWithinPartitions(folder, slot)
    laid.drop(row, slot).write.partitionBy(folder).parquet(path)


@query("op6_hilbert_sharding")
def op6(spark, sf_dir):
    """All documents in 40 shards of near-equal row counts (law ``rows``)."""
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
