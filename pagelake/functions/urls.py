"""URL expressions (X1, X2, X4–X8).  All are Catalyst expressions: no UDF.

The rules follow Python's ``urllib.parse`` (which is what the reference calls),
restricted to what a web page actually holds:

* ``netloc`` is everything between ``//`` and the next ``/ ? #`` — port and
  userinfo included.
* ``resolve`` is ``urljoin``: absolute URLs pass, ``//host/x`` gets the base
  scheme (dot segments left in place), ``/path`` and relative paths are
  resolved with dot-segment removal, ``?q`` and ``#f`` replace the tail.
  ``;params`` are treated as part of the path (documented deviation).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns (RFC 3986 scheme syntax, as urllib.parse uses it).
SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
NETLOC_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
HTTP_PREFIX_RE = r"^https?://"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_scheme(url) -> Column:
    """Prefix ``https://`` unless the URL starts with http:// or https://."""
    u = _col(url)
    return F.when(u.rlike(HTTP_PREFIX_RE), u).otherwise(F.concat(F.lit("https://"), u))


def netloc(url) -> Column:
    """Network location (``urlparse(url).netloc``); '' when there is none."""
    return F.regexp_extract(_col(url), NETLOC_RE, 1)


def scheme_raw(url) -> Column:
    """The scheme as written (``urljoin`` keeps the base's spelling)."""
    return F.regexp_extract(_col(url), SCHEME_RE, 1)


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_col(url), SCHEME_RE, 1))


def is_valid_url(url) -> Column:
    """Both scheme and netloc present."""
    u = _col(url)
    return u.isNotNull() & (scheme(u) != "") & (netloc(u) != "")


def normalise(url) -> Column:
    """Add the scheme; NULL when the result has no netloc (rejected)."""
    u = with_scheme(_col(url))
    return F.when(netloc(u) != "", u)


def url_decode(url) -> Column:
    """``urllib.parse.unquote``: valid ``%XX`` escapes decoded as UTF-8
    (invalid bytes become U+FFFD), ``+`` kept, a malformed ``%`` left as is.

    Spark's decoder turns ``+`` into a space and fails on a bare ``%``, so
    both are escaped first (``%2B``, ``%25``)."""
    u = F.replace(_col(url), F.lit("+"), F.lit("%2B"))
    u = F.regexp_replace(u, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(u)


def drop_fragment(url) -> Column:
    return F.regexp_replace(_col(url), r"#.*$", "")


def _remove_dot_segments(segments: Column) -> Column:
    """Fold over path segments with ``..`` popping and ``.`` skipped."""
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segments, -1)
    trailing = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    joined = F.array_join(trailing, "/")
    # urlunparse puts a '/' before a path that lacks one when there is a netloc.
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def resolve(base, link) -> Column:
    """``urllib.parse.urljoin(base, link)`` as one Catalyst expression."""
    b, l = _col(base), _col(link)
    # '//' with an empty authority is a path ('///x' → '/x'); '//' alone is
    # the base without its fragment, as an empty '?' is.
    empty_authority = F.coalesce(l.rlike(r"^//([/?#].*)?$"), F.lit(False))
    l = F.when(
        empty_authority, F.when(F.length(l) == 2, F.lit("?")).otherwise(F.substring(l, 3, 1 << 30))
    ).otherwise(l)
    b_scheme = F.regexp_extract(b, SCHEME_RE, 1)
    b_netloc = netloc(b)
    b_root = F.concat(b_scheme, F.lit("://"), b_netloc)
    b_rest = F.regexp_replace(b, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", "")
    b_path = F.regexp_extract(b_rest, r"^([^?#]*)", 1)
    b_query_part = F.regexp_extract(b_rest, r"^[^?#]*(\?[^#]*)?", 1)

    l_path = F.regexp_extract(l, r"^([^?#]*)", 1)
    l_query = F.regexp_extract(l, r"^[^?#]*\?([^#]*)", 1)
    l_frag = F.regexp_extract(l, r"#(.*)$", 1)
    # urlunparse leaves out an empty '?' or '#'.
    q_part = F.when(l_query != "", F.concat(F.lit("?"), l_query)).otherwise(F.lit(""))
    f_part = F.when(l_frag != "", F.concat(F.lit("#"), l_frag)).otherwise(F.lit(""))
    l_tail = F.concat(q_part, f_part)

    # '/x': absolute path, segments taken as they are (empty ones kept).
    abs_path = _remove_dot_segments(F.split(l_path, "/"))
    # 'x/y': merge with the base directory; inner empty segments dropped.
    base_parts = F.split(b_path, "/")
    base_dir = F.when(F.element_at(base_parts, -1) != "", F.slice(base_parts, 1, F.size(base_parts) - 1)).otherwise(
        base_parts
    )
    merged = F.concat(base_dir, F.split(l_path, "/"))
    n = F.size(merged)
    inner = F.filter(F.slice(merged, 2, F.greatest(n - 2, F.lit(0))), lambda s: s != "")
    merged_clean = F.when(
        n >= 2, F.concat(F.slice(merged, 1, 1), inner, F.slice(merged, -1, 1))
    ).otherwise(merged)
    rel_path = _remove_dot_segments(merged_clean)

    has_scheme = l.rlike(SCHEME_RE)
    return (
        F.when(l.isNull() | b.isNull(), F.lit(None).cast("string"))
        .when(l == "", b)
        .when(has_scheme, l)
        .when(l.startswith("//") & ~empty_authority, F.concat(b_scheme, F.lit(":"), l))
        .when(l.startswith("/"), F.concat(b_root, abs_path, l_tail))
        .when(l.startswith("?") | l.startswith("#"),
              F.concat(b_root, b_path, F.when(l_query != "", q_part).otherwise(b_query_part), f_part))
        .otherwise(F.concat(b_root, rel_path, l_tail))
    )


def clean_url(url, base=None) -> Column:
    """Resolve against ``base`` (when given) and drop the fragment; '' → NULL."""
    u = _col(url)
    resolved = resolve(base, u) if base is not None else u
    out = drop_fragment(resolved)
    return F.when(u.isNull() | (F.trim(u) == ""), F.lit(None).cast("string")).otherwise(out)


def file_stem(domain, ts) -> Column:
    """``<domain>_<yyyyMMdd_HHmmss>`` name of one stored result."""
    return F.concat(_col(domain), F.lit("_"), F.date_format(_col(ts), "yyyyMMdd_HHmmss"))
