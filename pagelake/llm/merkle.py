"""Operator 7 [native], Merkle-tree fingerprints of documents.

Leaves are runs of ``LEAF_WORDS`` words of a paragraph (a line), inner nodes
are paragraphs, sections (``SECTION`` paragraphs each) and the root.  Each
node's hash covers its children's, so equal roots mean equal texts, and two
trees are compared from the root down: equal branches are skipped and the
differing ones locate the edit.  The likeness of two trees is the Dice share of
the leaves they have in common.

Everything is column expressions: a tree is built inside its row.  Pairing each
document with the next one ranks ids (no texts) with one range sort; then texts
are shuffled once by row key, and each document sends the one before it only
the prefix and the leaves that one needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import keyed, nested, quoted, table
from pagelake.llm.registry import query
from pagelake.operators.numbering import global_rank, saved

LEAF_WORDS = 4
SECTION = 8
SHORT = 8  # hex digits of a node kept in a fingerprint


def _runs(items: Column, width: int, make) -> Column:
    """``make`` of each run of ``width`` elements of a non-empty array."""
    starts = F.sequence(F.lit(0), F.size(items) - 1, F.lit(width))
    return F.transform(starts, lambda i: make(F.slice(items, i + 1, F.lit(width))))


def _node(children: Column) -> Column:
    return F.md5(F.concat_ws(",", children))


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Add the tree of string column ``text`` (not null) as three columns.

    ``<prefix>_leaves`` array of paragraphs, each an array of leaf hashes;
    ``<prefix>_sections`` section hashes; ``<prefix>_root``.
    """
    lines = F.transform(F.split(F.col(text), "\n", -1), lambda p: F.split(p, " ", -1))
    leaves = F.transform(lines, lambda w: _runs(w, LEAF_WORDS, lambda run: F.md5(F.concat_ws(" ", run))))
    out = df.withColumn(f"{prefix}_leaves", leaves)
    out = out.withColumn(f"{prefix}_paragraphs", F.transform(F.col(f"{prefix}_leaves"), _node))
    out = out.withColumn(f"{prefix}_sections", _runs(F.col(f"{prefix}_paragraphs"), SECTION, _node))
    return out.withColumn(f"{prefix}_root", F.sha2(F.concat_ws(",", F.col(f"{prefix}_sections")), 256)).drop(f"{prefix}_paragraphs")


def fingerprint(prefix: str) -> Column:
    """The tree as a string: root | section hashes | leaves of each paragraph."""
    short = lambda nodes: F.transform(nodes, lambda h: F.substring(h, 1, SHORT))
    sections = F.concat_ws(",", short(F.col(f"{prefix}_sections")))
    leaves = F.concat_ws(";", F.transform(F.col(f"{prefix}_leaves"), lambda p: F.concat_ws("", short(p))))
    return F.concat_ws("|", F.col(f"{prefix}_root"), sections, leaves)


def leaf_set(prefix: str) -> Column:
    """Distinct leaves of a tree, as kept in its fingerprint (numbers travel smaller than digits)."""
    return F.array_distinct(F.transform(F.flatten(F.col(f"{prefix}_leaves")), lambda h: F.hash(F.substring(h, 1, SHORT))))


def likeness(a: Column, b: Column) -> Column:
    """Dice share of common leaves of two leaf sets, 0 to 1 (1 for equal texts)."""
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)).cast("double")


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Indexes of the paragraphs in which two fingerprints differ.

    Empty where the roots agree; else only sections whose hashes differ are
    looked into.  Paragraphs that one text has beyond the other differ.
    """
    part = lambda f, n: F.split_part(f, F.lit("|"), F.lit(n))
    pairs = F.arrays_zip(F.split(part(a, 2), ",").alias("a"), F.split(part(b, 2), ",").alias("b"))
    open_sections = F.filter(F.transform(pairs, lambda p, i: F.when(p["a"].eqNullSafe(p["b"]), F.lit(-1)).otherwise(i)), lambda i: i >= 0)
    paragraphs = F.arrays_zip(F.split(part(a, 3), ";").alias("a"), F.split(part(b, 3), ";").alias("b"))
    inside = F.transform(
        paragraphs,
        lambda p, i: F.when(F.array_contains(open_sections, F.floor(i / SECTION).cast("int")) & ~p["a"].eqNullSafe(p["b"]), i).otherwise(F.lit(-1)),
    )
    changed = F.filter(inside, lambda i: i >= 0)
    return F.when(part(a, 1) == part(b, 1), F.array().cast("array<int>")).otherwise(changed)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` (replaced if there); a null text counts as empty."""
    made = with_tree(nested(docs, body=F.coalesce(F.col(quoted(text)), F.lit(""))), "body", "own")
    others = [F.col("doc").getField(c).alias(c) for c in docs.columns if c != "fingerprint"]
    return made.select(*others, fingerprint("own").alias("fingerprint"))


def next_rows(rows: DataFrame) -> DataFrame:
    """``(rid, next_rid, n_chars)`` of the rows of ``keyed``.

    The order is doc_id (null first), then the scan's; the first row follows the
    last, and a single row follows itself.
    """
    ids = rows.select("rid", "doc_id", F.length("text").cast("long").alias("n_chars"))
    ranked = global_rank(ids, [F.col("doc_id").asc_nulls_first(), F.col("rid").asc()])
    total = ranked.agg(F.count(F.lit(1)).alias("_total"))
    # One row: the number of rows.
    ahead = ranked.crossJoin(F.broadcast(total)).withColumn("_next", (F.col("rank") + 1) % F.col("_total"))
    after = ranked.select(F.col("rank").alias("_next"), F.col("rid").alias("next_rid"))
    return saved(ahead.join(after, "_next").select("rid", "next_rid", "n_chars"), "next-rows")


def edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last quarter of code points (rounded down) replaced
    by as many first ones, or all, of the next document.  A null text is empty;
    repeated rows and null or repeated ids are documents of their own; an empty
    table gives no rows.
    """
    rows = keyed(docs, doc_id, text).withColumn("text", F.coalesce("text", F.lit("")))
    links = next_rows(rows)
    asked = links.select(F.col("next_rid").alias("rid"), F.col("rid").alias("to"), F.floor(F.col("n_chars") / 4).cast("int").alias("quarter"))
    # Both joins read the same columns of ``rows``, so its shuffle is made once.
    given = with_tree(rows.join(asked, "rid"), "text", "next").select(
        F.col("to").alias("rid"),
        F.col("doc_id").alias("next_doc_id"),
        F.expr("substring(text, 1, quarter)").alias("tail"),
        leaf_set("next").alias("next_set"),
    )
    both = rows.join(given, "rid").withColumn("n_chars", F.length("text").cast("long"))
    head = F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 4) AS int))")
    both = with_tree(both.withColumn("edited", F.concat(head, "tail")), "text", "own")
    both = with_tree(both.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)), "edited", "new")
    sets = both.select(
        "rid",
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint("own").alias("fingerprint"),
        fingerprint("new").alias("edited_fingerprint"),
        leaf_set("own").alias("own_set"),
        leaf_set("new").alias("new_set"),
        "next_set",
        "next_doc_id",
    )
    return sets.select(
        *sets.columns[:6],
        likeness(F.col("own_set"), F.col("new_set")).alias("near_edited"),
        likeness(F.col("own_set"), F.col("next_set")).alias("near_next"),
        "next_doc_id",
    )


@query("op7_merkle_fingerprints")
def op7(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts."""
    return edits(table(spark, sf_dir, "documents")).drop("rid")
