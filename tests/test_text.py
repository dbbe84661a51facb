"""Text cleaning (X10), price parsing (X11) and number extraction
against plain-Python statements of the same rules."""

import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from pagelake.functions import text as T

CHARS = st.sampled_from(
    list("aZé9_ .,!?-$€#@") + ["\t", "\n", " ", " ", "́", "٣", "..", "!!!", "?,", "ß", "漢"]
)


def py_clean(text):
    """Whitespace runs → one space (Python's notion of whitespace); keep word
    characters (letters, numbers, underscore), whitespace and .,!?-; a run of
    one repeated mark among .,!? becomes a single mark; trim."""
    if not text:
        return ""
    t = " ".join(text.split())
    t = "".join(c for c in t if c.isalnum() or c == "_" or c.isspace() or c in ".,!?-")
    out = []
    for ch, grp in itertools.groupby(t):
        n = len(list(grp))
        out.append(ch if ch in ".,!?" else ch * n)
    return "".join(out).strip()


@given(st.lists(st.lists(CHARS, max_size=12), min_size=20, max_size=30))
@settings(max_examples=6, deadline=None)
def test_clean_text_matches_python(spark, batch):
    values = ["".join(p) for p in batch] + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    got = {r.i: r.c for r in df.select("i", T.clean_text("v").alias("c")).collect()}
    assert got == {i: py_clean(v) for i, v in enumerate(values)}


def test_whitespace_class_is_pythons():
    import sys

    import re

    from pagelake.functions import html as H

    # Java and RE2 read \x{..}; Python's re does not, so spell the escapes out.
    body = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m.group(1), 16))), H.PY_WHITESPACE)
    rx = re.compile("[" + body + "]")
    got = {c for c in range(sys.maxunicode + 1) if rx.fullmatch(chr(c))}
    assert got == {c for c in range(sys.maxunicode + 1) if chr(c).isspace()}


def test_word_count_python_split(spark):
    from pagelake.functions import html as H

    vals = ["a b", "a b", " 　x y\x1cz ", "", "\x85", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i long, v string")
    got = {r.i: r.n for r in df.select("i", H.word_count("v").alias("n")).collect()}
    assert got == {i: len((v or "").split()) for i, v in enumerate(vals)}
