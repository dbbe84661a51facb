"""What the training-data operators share: row keys, tables, word hashing."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Word separators of the contracts: space and \\x09-\\x0D, which are the ASCII
# white space that ``bytes.split()`` uses.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by a path that only Spark's readers have to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(rid, doc_id, text)``: the two columns an operator needs and a row key.

    ``doc_id`` may be null or repeated, so rows are told apart by ``rid``
    (partition and position in the scan).  A table scan yields the same ``rid``
    in every branch and on every retry; pass a stored table, not a frame whose
    row order depends on a shuffle.  Other columns, whatever their names, are
    left out.
    """
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def quoted(name: str) -> str:
    """A column name as it stands, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def unused(docs: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until none is a column of ``docs`` (case does not tell columns apart)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def nested(docs: DataFrame, **columns) -> DataFrame:
    """``docs`` as one struct column ``doc``, beside ``columns``: no name of ``docs`` can clash."""
    whole = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("doc")
    return docs.select(whole, *[c.alias(name) for name, c in columns.items()])


def only_rows(docs: DataFrame, rids: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose row key (see ``keyed``) is in ``rids(rid)``."""
    (row,) = unused(docs, "_row")
    tagged = docs.withColumn(row, F.monotonically_increasing_id())
    return tagged.join(rids.select(F.col("rid").alias(row)), row, "left_semi").drop(row)


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, UPPER, UPPER.lower())


def tidy(run):
    """Wrap a ``mapInArrow`` function: a task's freed memory goes back to the system.

    Workers live on for later tasks, of later stages too, and what one stage
    has freed should not be missing in the next.
    """

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def _starts(text: pa.Array, separator: np.ndarray) -> np.ndarray:
    """Words (runs of bytes that are no separator) of each text, 0 for a null."""
    text = text.fill_null("")
    if not len(text):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_string(text.type) else np.int32)
    offsets = offsets[text.offset : text.offset + len(text) + 1].astype(np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    if low == high:
        return np.zeros(len(text), np.int64)
    inside = ~separator[np.frombuffer(text.buffers()[2], np.uint8)[low:high]]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    firsts = offsets[:-1] - low
    firsts = firsts[firsts < start.size]
    start[firsts] = inside[firsts]
    total = np.concatenate([[0], np.cumsum(start)])
    return np.diff(total[offsets - low])


def word_counts(docs: DataFrame, *keep: str, text: str = "text", separators: bytes = b" \t\n\x0b\x0c\r") -> DataFrame:
    """``docs`` with the columns ``keep`` and ``n_words``: runs of bytes other than ``separators`` (a null text: 0)."""
    from pyspark.sql.types import LongType, StructType

    separator = np.zeros(256, bool)
    separator[list(separators)] = True
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_counted_text"))
    schema = StructType([*rows.schema.fields[:-1]]).add("n_words", LongType())

    def run(batches):
        for batch in batches:
            n = pa.array(_starts(batch.column(batch.num_columns - 1), separator), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*batch.schema.names[:-1], "n_words"])

    return rows.mapInArrow(tidy(run), schema)
