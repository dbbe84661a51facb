"""Operator 5, exact dedup by deterministic block naming.

A text is cut into fixed-size blocks.  Equal blocks get one integer name by
sorting (never by hashing, so a name stands for exactly one content); then
adjacent pairs of names are named in the same way, halving the count, until
each document has one integer: its identity.  Two documents have the same
identity if and only if their normalised texts are identical.

A block that occurs once in the corpus needs no place in the sort: no other
document can equal its document, which leaves the recursion at once.  So after
the first level only documents whose blocks all recur are carried on.

Scale: one task batch names its own repeated blocks first, so a text that a
third of all rows share travels once per batch, not once per row.  Contents
are shuffled twice (to find the recurring ones, to join their names back); the
name table holds recurring blocks only, and Spark may split a hot block's side
of the join.  The recursion runs log2(longest text / block) levels on rows of
three integers, each level a written table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import ascii_lower, keyed, only_rows, table, tidy
from pagelake.llm.registry import query
from pagelake.operators.numbering import saved

BLOCK_BYTES = 4096
_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())

LOCAL_BLOCKS = "content binary, members array<struct<rid:long, pos:long, n:long>>"
_LOCAL_ARROW = pa.schema(
    [
        ("content", pa.binary()),
        ("members", pa.list_(pa.struct([("rid", pa.int64()), ("pos", pa.int64()), ("n", pa.int64())]))),
    ]
)


def _cut(block: int):
    def run(batches):
        for batch in batches:
            seen: dict[bytes, list] = {}
            rids = batch.column("rid").to_pylist()
            for rid, text in zip(rids, batch.column("text")):
                raw = (text.as_py() or "").encode().translate(_FOLD)
                n = max(1, -(-len(raw) // block))
                for pos in range(n):
                    seen.setdefault(raw[pos * block : (pos + 1) * block], []).append({"rid": rid, "pos": pos, "n": n})
            yield pa.RecordBatch.from_pydict({"content": list(seen), "members": list(seen.values())}, schema=_LOCAL_ARROW)

    return tidy(run)


def _name(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``keys -> name`` for the key values that occur more than once.

    The distinct recurring values are sorted within their hash partition; the
    place there is the name (unique over partitions).
    """
    n = F.sum("weight") if "weight" in rows.columns else F.count(F.lit(1))
    recurring = rows.groupBy(*keys).agg(n.alias("_n")).where(F.col("_n") > 1).select(*keys)
    return saved(recurring.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()), label)


def identities(rows: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """``(rid, identity)`` for the rows of ``keyed`` whose text recurs.

    ``identity`` is a struct (level, name): the level is the number of halvings
    that the block count of the text needs, and the name is unique within it.
    Rows that are not returned have a text of their own.
    """
    local = rows.select("rid", "text").mapInArrow(_cut(block), LOCAL_BLOCKS)
    names = _name(local.select("content", F.size("members").alias("weight")), ["content"], "block-names")
    level = local.join(names, "content").select(F.explode("members").alias("m"), "name").select("m.rid", "m.pos", "m.n", "name")
    done = None
    step = 0
    while True:
        # A document stays only if each of its blocks recurs.
        whole = level.groupBy("rid").agg(F.count(F.lit(1)).alias("_have"), F.max("n").alias("_n"))
        level = saved(level.join(whole.where(F.col("_have") == F.col("_n")).select("rid"), "rid", "left_semi"), "block-level")
        ready = level.where("n = 1").select("rid", F.struct(F.lit(step).alias("level"), F.col("name")).alias("identity"))
        done = ready if done is None else done.unionByName(ready)
        rest = level.where("n > 1")
        if rest.isEmpty():
            return done
        # An odd last name pairs with -1, which is no name.
        pairs = rest.groupBy("rid", F.floor(F.col("pos") / 2).alias("pos"), F.ceil(F.col("n") / 2).alias("n")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        pairs = saved(pairs, "block-pairs")
        names = _name(pairs, ["left", "right"], "pair-names")
        level = pairs.join(names, ["left", "right"]).select("rid", "pos", "n", "name")
        step += 1


def dedup(docs: DataFrame, block: int = BLOCK_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its group: ``(rid, doc_id, keep_id, group_size, kept)``.

    A null text is an empty text; A-Z are lower-cased, nothing else changes.
    Of equal texts the row with the largest ``doc_id`` stays (null is below
    every id; of rows that repeat that id the first of the scan stays), so each
    group keeps one row.  ``keep_id`` is null only where every id of a group is
    null.  An empty table gives an empty result.
    """
    rows = keyed(docs, doc_id, text)
    ident = identities(rows, block)
    ids = rows.select("rid", "doc_id")
    known = saved(ids.join(ident, "rid"), "identities")
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("real"), F.col("doc_id"), (-F.col("rid")).alias("first"))).alias("best")
    # Written first, so that Spark may split a hot group in the join below.
    groups = saved(known.groupBy("identity").agg(best, F.count(F.lit(1)).alias("group_size")), "identity-groups")
    found = known.join(groups, "identity").select(
        "rid",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == -F.col("best.first")).alias("kept"),
    )
    out = ids.join(found, "rid", "left")
    alone = F.col("kept").isNull()
    return out.select(
        "rid",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("kept", F.lit(True)).alias("kept"),
    )


def survivors(docs: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, all columns."""
    return only_rows(docs, dedup(docs, block).where("kept").select("rid"))


SQL = """WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
g AS (SELECT s, max(doc_id) AS keep_id, count(*) AS group_size, sha256(s) AS text_sha256 FROM t GROUP BY s)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, g.text_sha256 FROM t JOIN g ON t.s = g.s"""


@query("op5_block_naming", SQL)
def op5(spark, sf_dir):
    """Exact dedup of all documents, one row each, with the digest of the normalised text."""
    docs = table(spark, sf_dir, "documents")
    digest = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256)
    digests = keyed(docs).select("rid", digest.alias("text_sha256"))
    return dedup(docs).join(digests, "rid").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
