"""Small document tables with every awkward case, shared by the operator tests."""

from pyspark.sql import functions as F

CLASHES = ["_row", "_ROW_", "_kept", "_cut", "_body", "_found", "_kept_row", "_kept_rid", "a.b", "score", "shard", "doc", "own_root", "fingerprint"]

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, name string"

_LONG = " ".join(f"word{i % 977} of{i % 53}" for i in range(9000))


def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    texts = [
        None,
        "",
        " \n\t",
        "one",
        "The quick brown fox jumps over the lazy dog. " * 3,
        "the quick brown FOX jumps over the lazy dog. " * 3,
        "Ünï cödé straße ÀÉ日本語 😀 l'été n'est pas d'hiver",
        _LONG,
        _LONG.upper(),
        _LONG + " tail",
        "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a",
    ]
    out = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    out.append(out[4])  # a repeated row
    out.append((4, "another text under a repeated id", "en", None, 5, None, None))
    out.append((None, "a row without an id", None, None, None, None, None))
    out.append((None, None, None, None, None, None, None))
    return out


def frame(spark, data=None):
    return clashing(spark.createDataFrame(rows() if data is None else data, DOC_SCHEMA).repartition(3)).cache()


def empty(spark):
    return clashing(spark.createDataFrame([], DOC_SCHEMA))


def clashing(df):
    """More columns, under names that an operator might like to use itself."""
    return df.withColumns({c: F.lit("clash") for c in CLASHES})
