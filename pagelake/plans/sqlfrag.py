"""DuckDB SQL fragments for the oracle queries.

They restate the Catalyst expressions of ``pagelake.functions`` in SQL over
the same parquet tables, using the same regular expressions (Java and RE2
agree on the ASCII classes and inline flags used here).
"""

from __future__ import annotations

from pagelake.functions import html as H
from pagelake.functions import urls as U
from pagelake.sources.tables import AS_OF, ERROR_CODES, METHODS


def lit(s: str) -> str:
    """SQL string literal (quotes doubled, backslashes kept)."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(H.EDGE_WS_RE)}, '', 'g')"


EXTRA_WS_SQL = "(" + " || ".join(f"chr({ord(c)})" for c in H.EXTRA_WHITESPACE) + ")"


def collapse_ws(x: str) -> str:
    """Python whitespace runs → one space (see ``html.collapse_ws``)."""
    t = f"translate({x}, {EXTRA_WS_SQL}, repeat(' ', {len(H.EXTRA_WHITESPACE)}))"
    return f"regexp_replace({t}, {lit(H.ASCII_WS_RE)}, ' ', 'g')"


def first_group(x: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {lit(pattern)}) THEN regexp_extract({x}, {lit(pattern)}, 1) END"


def netloc(url: str) -> str:
    return f"regexp_extract({url}, {lit(U.NETLOC_RE)}, 1)"


def scheme(url: str) -> str:
    return f"regexp_extract({url}, {lit(U.SCHEME_RE)}, 1)"


def title(html: str) -> str:
    return strip(first_group(html, H.TITLE_RE))


def meta_description(html: str) -> str:
    return strip(first_group(html, H.META_DESCRIPTION_RE))


def headings(html: str) -> str:
    return "list_concat(" + ", ".join(_heading(html, lv) for lv in (1, 2, 3)) + ")"


def _heading(html: str, level: int) -> str:
    pat = H.HEADING_RE.format(level=level)
    cleaned = strip(f"regexp_replace(x, {lit(H.TAG_RE)}, '', 'g')")
    return f"list_filter(list_transform(regexp_extract_all({html}, {lit(pat)}, 1), lambda x: {cleaned}), lambda x: x <> '')"


def resolve_root(url: str, x: str) -> str:
    """urljoin for the link forms of H11's root mode: absolute http(s) kept,
    ``//host`` gets the scheme, ``/path`` (no dot segments) gets scheme://netloc."""
    return (
        f"CASE WHEN starts_with({x}, 'http://') OR starts_with({x}, 'https://') THEN {x} "
        f"WHEN starts_with({x}, '//') THEN {scheme(url)} || ':' || {x} "
        f"ELSE {scheme(url)} || '://' || {netloc(url)} || {x} END"
    )


def links(html: str, url: str, pattern: str = H.LINK_RE) -> str:
    """H11 root mode as a sorted distinct list."""
    keep = "starts_with(x, 'http://') OR starts_with(x, 'https://') OR starts_with(x, '/')"
    return (
        f"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all({html}, {lit(pattern)}, 1), "
        f"lambda x: {keep}), lambda x: {resolve_root(url, 'x')})))"
    )


def images(html: str, url: str) -> str:
    return links(html, url, H.IMAGE_RE)


def visible_text(html: str) -> str:
    t = f"regexp_replace({html}, {lit(H.SCRIPT_BLOCK_RE)}, '', 'g')"
    t = f"regexp_replace({t}, {lit(H.STYLE_BLOCK_RE)}, '', 'g')"
    t = f"regexp_replace({t}, {lit(H.TAG_RE)}, ' ', 'g')"
    return f"trim({collapse_ws(t)})"


def word_count(text: str) -> str:
    t = f"trim({collapse_ws(f'coalesce({text}, {chr(39)}{chr(39)})')})"
    return f"CASE WHEN {t} = '' THEN 0 ELSE len(string_split({t}, ' ')) END"


def contains_any(low: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({low}, {lit(w)})" for w in words) + ")"


def attempts_cte(events: str = "events", pages: str = "pages") -> str:
    """The attempt stand-in (S11) as SQL."""
    methods = ", ".join(lit(m) for m in METHODS)
    codes = ", ".join(str(c) for c in ERROR_CODES)
    return f"""
attempts AS (
  SELECT e.event_id AS attempt_id, e.ts,
         'req' || CAST(e.event_id // 3 AS VARCHAR) AS request_id,
         e.event_id % n.n_pages AS page_id,
         [{methods}][CAST(e.event_id % 3 AS BIGINT) + 1] AS method,
         CASE WHEN e.event_type = 'error' THEN [{codes}][CAST(e.user_id % 4 AS BIGINT) + 1] ELSE 200 END AS status_code,
         CASE WHEN e.event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
         e.value / 100 AS response_time,
         'proxy' || CAST(e.user_id AS VARCHAR) AS proxy_id,
         e.user_id, e.event_type, p.url
  FROM {events} e
  CROSS JOIN (SELECT count(*) AS n_pages FROM {pages}) n
  JOIN {pages} p ON p.page_id = e.event_id % n.n_pages
)"""


def results_cte() -> str:
    """``scrape_results`` as SQL (depends on ``attempts``)."""
    return f"""
extracted AS (
  SELECT page_id, {title('html')} AS title, {meta_description('html')} AS meta_description,
         {headings('html')} AS headings, length(html) AS content_length,
         {links('html', 'url')} AS links, {images('html', 'url')} AS images
  FROM pages
),
scrape_results AS (
  SELECT a.attempt_id AS id, a.url, {netloc('a.url')} AS domain, a.method AS method_used, a.status,
         a.status_code, a.response_time, a.ts AS timestamp,
         CASE WHEN a.status = 'success' THEN x.title END AS title,
         CASE WHEN a.status = 'success' THEN x.content_length END AS content_length,
         CASE WHEN a.status = 'success' THEN len(x.links) ELSE 0 END AS links_count,
         CASE WHEN a.status = 'success' THEN len(x.images) ELSE 0 END AS images_count,
         CASE WHEN a.status = 'success' THEN '{{' || concat_ws(',',
              CASE WHEN x.title IS NOT NULL THEN '"title":' || CAST(to_json(x.title) AS VARCHAR) END,
              CASE WHEN x.meta_description IS NOT NULL THEN '"meta_description":' || CAST(to_json(x.meta_description) AS VARCHAR) END,
              '"headings":' || CAST(to_json(x.headings) AS VARCHAR)) || '}}' ELSE '{{}}' END AS data_json,
         CASE WHEN a.status = 'success' THEN x.links ELSE [] END AS links,
         CASE WHEN a.status = 'success' THEN x.images ELSE [] END AS images,
         CASE WHEN a.status <> 'success' THEN 'HTTP ' || CAST(a.status_code AS VARCHAR) END AS error_message,
         a.ts AS created_at, a.request_id, a.proxy_id
  FROM attempts a LEFT JOIN extracted x ON a.page_id = x.page_id
)"""


def with_results(body: str) -> str:
    return "WITH " + attempts_cte() + "," + results_cte() + "\n" + body


def with_attempts(body: str) -> str:
    return "WITH " + attempts_cte() + "\n" + body


AS_OF_SQL = f"TIMESTAMP {lit(AS_OF)}"
