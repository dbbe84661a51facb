"""Text, price and number expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions.html import PY_WHITESPACE, WS_RE, collapse_ws, strip, word_count  # noqa: F401  (re-exported)

# Fixed patterns.
# Applied after whitespace is collapsed, when a space is the only whitespace left.
NOT_WORD_PUNCT_RE = r"[^\p{L}\p{N}_ .,!?\-]"
PRICE_KEEP_RE = r"[^\d.,]"
NUMBER_RE = r"\d+(?:\.\d+)?"
REPEATED_PUNCT = ["!", ".", ",", "?"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(text) -> Column:
    """Collapse whitespace, keep word chars and ``.,!?-``, collapse runs of
    the same punctuation mark; NULL/empty → ''.

    ``\\w`` is Unicode here, as in Python (letters, numbers, underscore).  The back-reference form
    ``([.,!?])\\1+`` is written as one pass per mark, which is the same function.
    """
    t = _col(text)
    t = F.trim(collapse_ws(t))
    t = F.regexp_replace(t, NOT_WORD_PUNCT_RE, "")
    # One pass with a back-reference (Java regex), the same function as one
    # pass per mark (the form the DuckDB oracle uses, as RE2 has no \1).
    marks = "".join(REPEATED_PUNCT)
    t = F.regexp_replace(t, "([" + re.escape(marks) + "])\\1+", "$1")
    return F.coalesce(F.trim(t), F.lit(""))


def clean_price(price) -> Column:
    """X11 ``clean_price``: digits, dots and commas kept, commas dropped, then
    a double; NULL when empty or not a number."""
    p = F.regexp_replace(F.regexp_replace(_col(price).cast("string"), PRICE_KEEP_RE, ""), ",", "")
    return F.when(_col(price).isNull() | (_col(price).cast("string") == ""), F.lit(None).cast("double")).otherwise(
        p.try_cast("double")
    )


def parse_price(price) -> Column:
    """X11 ``parse_price``: as ``clean_price`` but 0.0 instead of NULL."""
    return F.coalesce(clean_price(price), F.lit(0.0))


def simple_price(price) -> Column:
    """Strip ``$`` and read a double (default "0")."""
    return F.coalesce(F.replace(F.coalesce(_col(price), F.lit("0")), F.lit("$"), F.lit("")).try_cast("double"), F.lit(0.0))


def numbers(text) -> Column:
    """Every number in the text, as doubles."""
    return F.transform(F.regexp_extract_all(F.coalesce(_col(text).cast("string"), F.lit("")), F.lit(NUMBER_RE), 0), lambda n: n.cast("double"))


def in_stock(availability) -> Column:
    """Availability text contains 'in stock', ignoring case."""
    return F.lower(F.coalesce(_col(availability), F.lit(""))).contains("in stock")


def highlight(title, term: str) -> Column:
    """Literal, case-sensitive ``**term**`` markup in the title."""
    return F.replace(_col(title), F.lit(term), F.lit(f"**{term}**"))


def discount_pct(price, original) -> Column:
    """X14 (our definition, the reference calls it without defining it):
    ``(original - price) / original * 100``, NULL when original <= 0."""
    o, p = _col(original), _col(price)
    return F.when(o > 0, (o - p) / o * 100)
