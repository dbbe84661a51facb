"""Selector extraction over the page corpus.

The one real per-row Python stage: each page is parsed once with the
standard-library ``html.parser`` inside ``mapInPandas`` (Arrow batches, no
shuffle), and every requested selector is evaluated against that tree.

Supported CSS: ``tag``, ``*``, ``#id``, ``.class``, ``[attr]``,
``[attr=value]``, descendant (space) and child (``>``) combinators, comma
groups, and the ``::text`` / ``::attr(name)`` pseudo-elements.  XPath (a
selector starting with ``//``): ``//`` and ``/`` steps over tag names or
``*``, ``[@a]`` / ``[@a='v']`` predicates, and a final ``/@attr`` or
``/text()``.  Anything else raises ``ValueError`` when the job is built,
never a silent NULL at run time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions import scoring as S

# Elements that never have an end tag.
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
MODES = ("text", "html")


# ---------------------------------------------------------------------------
# Selector compilation (driver side, before the job)
# ---------------------------------------------------------------------------
@dataclass
class Compound:
    tag: str | None = None
    ids: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    attrs: list[tuple[str, str | None]] = field(default_factory=list)


@dataclass
class Chain:
    steps: list[tuple[str, Compound]]  # (combinator, compound); first combinator is ' '
    output: tuple[str, str | None] = ("node", None)  # node | text | attr


_COMPOUND_RE = re.compile(
    r"""(?P<tag>[A-Za-z][A-Za-z0-9-]*|\*)?(?P<rest>(?:\#[\w-]+|\.[\w-]+|\[\s*[\w:-]+\s*(?:=\s*(?:"[^"]*"|'[^']*'|[^\]\s]+)\s*)?\])*)$"""
)
_PART_RE = re.compile(r"""\#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]""")


def _compound(text: str, selector: str) -> Compound:
    m = _COMPOUND_RE.match(text)
    if not text or not m:
        raise ValueError(f"unsupported selector {selector!r} (at {text!r})")
    c = Compound(tag=None if m.group("tag") in (None, "*") else m.group("tag").lower())
    for pm in _PART_RE.finditer(m.group("rest")):
        if pm.group(1):
            c.ids.append(pm.group(1))
        elif pm.group(2):
            c.classes.append(pm.group(2))
        else:
            v = pm.group(4)
            if v is not None and v[:1] in "\"'":
                v = v[1:-1]
            c.attrs.append((pm.group(3).lower(), v))
    return c


def _compile_css(selector: str) -> list[Chain]:
    chains = []
    for group in selector.split(","):
        g = group.strip()
        output: tuple[str, str | None] = ("node", None)
        pm = re.search(r"::(text|attr\(([\w:-]+)\))$", g)
        if pm:
            output = ("text", None) if pm.group(1) == "text" else ("attr", pm.group(2).lower())
            g = g[: pm.start()]
        if not g or re.search(r"[:+~()]", g):
            raise ValueError(f"unsupported selector {selector!r}")
        tokens = re.findall(r">|[^\s>]+", g)
        steps, comb = [], " "
        for t in tokens:
            if t == ">":
                comb = ">"
                continue
            steps.append((comb, _compound(t, selector)))
            comb = " "
        if not steps:
            raise ValueError(f"unsupported selector {selector!r}")
        chains.append(Chain(steps, output))
    return chains


def _compile_xpath(selector: str) -> list[Chain]:
    s = selector.strip()
    output: tuple[str, str | None] = ("node", None)
    m = re.search(r"/(@([\w:-]+)|text\(\))$", s)
    if m:
        output = ("attr", m.group(2).lower()) if m.group(2) else ("text", None)
        s = s[: m.start()]
    steps = []
    for sep, name, preds in re.findall(r"(//|/)([A-Za-z][\w-]*|\*)((?:\[[^\]]*\])*)", s):
        c = Compound(tag=None if name == "*" else name.lower())
        for p in re.findall(r"\[([^\]]*)\]", preds):
            pm = re.fullmatch(r"""\s*@([\w:-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'))?\s*""", p)
            if not pm:
                raise ValueError(f"unsupported XPath predicate in {selector!r}")
            val = pm.group(2) if pm.group(2) is not None else pm.group(3)
            if pm.group(1).lower() == "class" and val is not None:
                c.attrs.append(("class", val))
            else:
                c.attrs.append((pm.group(1).lower(), val))
        steps.append((" " if sep == "//" else ">", c))
    rebuilt = "".join(re.findall(r"(?://|/)(?:[A-Za-z][\w-]*|\*)(?:\[[^\]]*\])*", s))
    if not steps or rebuilt != s:
        raise ValueError(f"unsupported XPath {selector!r}")
    return [Chain(steps, output)]


def compile_selector(selector: str) -> list[Chain]:
    """CSS, or XPath when the selector starts with ``//`` (as the reference does)."""
    return _compile_xpath(selector) if selector.strip().startswith("//") else _compile_css(selector)


# ---------------------------------------------------------------------------
# Page tree (executor side)
# ---------------------------------------------------------------------------
class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "start", "end")

    def __init__(self, tag, attrs, parent, start):
        self.tag, self.attrs, self.parent, self.start = tag, attrs, parent, start
        self.children: list = []  # Node or str, in document order
        self.end = None


# Implied end tags: a start tag closes the open elements on its right, looked
# for up to the nearest boundary element.
_BLOCK_TAGS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPE = frozenset("#root html body table td th caption button template object applet marquee".split())
_CLOSES = {
    "li": (frozenset(["li"]), _SCOPE | {"ul", "ol", "menu"}),
    "dt": (frozenset(["dt", "dd"]), _SCOPE | {"dl"}),
    "dd": (frozenset(["dt", "dd"]), _SCOPE | {"dl"}),
    "option": (frozenset(["option"]), frozenset(["#root", "select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["#root", "select"])),
    "td": (frozenset(["td", "th"]), frozenset(["#root", "table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["#root", "table", "tr"])),
    "tr": (frozenset(["tr"]), frozenset(["#root", "table", "thead", "tbody", "tfoot"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["#root", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["#root", "table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["#root", "table"])),
}


class _TreeBuilder(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html = html
        self.line_starts = [0]
        for m in re.finditer("\n", html):
            self.line_starts.append(m.end())
        self.root = Node("#root", {}, None, 0)
        self.stack = [self.root]
        self.order: list[Node] = []

    def _offset(self) -> int:
        line, col = self.getpos()
        return self.line_starts[line - 1] + col

    def _close_open(self, tags, boundary, end: int) -> None:
        """Close the outermost open element of ``tags`` inside ``boundary``, with all in it."""
        found = None
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                found = i
            elif self.stack[i].tag in boundary:
                break
        if found is not None:
            for n in self.stack[found:]:
                if n.end is None:
                    n.end = end
            del self.stack[found:]

    def _imply_ends(self, tag: str, start: int) -> None:
        if tag in _CLOSES:
            self._close_open(*_CLOSES[tag], start)
        if tag in _BLOCK_TAGS:
            self._close_open(frozenset(["p"]), _SCOPE, start)
        if tag in _HEADINGS and self.stack[-1].tag in _HEADINGS:
            self.stack.pop().end = start

    def handle_starttag(self, tag, attrs):
        start = self._offset()
        self._imply_ends(tag, start)
        node = Node(tag, {k.lower(): (v if v is not None else "") for k, v in attrs}, self.stack[-1], start)
        self.stack[-1].children.append(node)
        self.order.append(node)
        if tag in VOID_TAGS:
            text = self.get_starttag_text() or ""
            node.end = start + len(text)
        else:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        # The slash means nothing in HTML: <div/> opens a div.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                end = self.html.find(">", self._offset())
                end = len(self.html) if end < 0 else end + 1
                for n in self.stack[i:]:
                    if n.end is None:
                        n.end = end
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)

    def finish(self):
        self.close()
        for n in self.stack[1:]:
            if n.end is None:
                n.end = len(self.html)
        return self


def parse(html: str) -> _TreeBuilder:
    """Parse one page into a tree (used by the jobs and by tests)."""
    return _feed(html or "")


def _feed(html: str) -> _TreeBuilder:
    tb = _TreeBuilder(html)
    tb.feed(html)
    return tb.finish()


def node_text(n: Node) -> str:
    out = []
    stack = [n]
    while stack:
        cur = stack.pop()
        if isinstance(cur, str):
            out.append(cur)
        else:
            stack.extend(reversed(cur.children))
    return "".join(out)


def _matches(n: Node, c: Compound) -> bool:
    if c.tag is not None and n.tag != c.tag:
        return False
    for i in c.ids:
        if n.attrs.get("id") != i:
            return False
    if c.classes:
        have = set(n.attrs.get("class", "").split())
        if not all(k in have for k in c.classes):
            return False
    for a, v in c.attrs:
        if a not in n.attrs or (v is not None and n.attrs[a] != v):
            return False
    return True


def _chain_match(n: Node, steps, i: int) -> bool:
    comb, comp = steps[i]
    if not _matches(n, comp):
        return False
    if i == 0:
        return True
    p = n.parent
    if comb == ">":
        return p is not None and p.tag != "#root" and _chain_match(p, steps, i - 1)
    while p is not None and p.tag != "#root":
        if _chain_match(p, steps, i - 1):
            return True
        p = p.parent
    return False


def select(tree: _TreeBuilder, chains: list[Chain], mode: str = "text") -> list[str]:
    """Values of every hit in document order (text, or raw HTML in ``html`` mode)."""
    out = []
    # Of a lone selector, the last step's tag and class rule most nodes out at once.
    only = chains[0].steps[-1][1] if len(chains) == 1 else Compound()
    tag, classed = only.tag, bool(only.classes)
    for n in tree.order:
        if (tag is not None and n.tag != tag) or (classed and "class" not in n.attrs):
            continue
        for ch in chains:
            if _chain_match(n, ch.steps, len(ch.steps) - 1):
                kind, arg = ch.output
                if kind == "attr":
                    if arg in n.attrs:
                        out.append(n.attrs[arg])
                elif kind == "text":
                    out.extend(x for x in n.children if isinstance(x, str))
                elif mode == "html":
                    out.append(tree.html[n.start : n.end])
                else:
                    t = node_text(n).strip()
                    out.append(t if t else tree.html[n.start : n.end])
                break
    return out


def body_text(tree: _TreeBuilder, how: str = "all") -> str:
    """(a) ``direct`` body text nodes joined by a space, (b) ``stripped``
    every text node stripped and concatenated, (c) ``all`` full text content."""
    body = next((n for n in tree.order if n.tag == "body"), None)
    if body is None:
        return ""
    if how == "direct":
        return " ".join(x for x in body.children if isinstance(x, str)).strip()
    if how == "stripped":
        parts = []
        stack = [body]
        while stack:
            cur = stack.pop()
            if isinstance(cur, str):
                parts.append(cur.strip())
            else:
                stack.extend(reversed(cur.children))
        return "".join(parts)
    return node_text(body)


# ---------------------------------------------------------------------------
# Spark jobs
# ---------------------------------------------------------------------------
def _compile_all(selectors: dict[str, str]) -> list[tuple[str, list[Chain]]]:
    if not selectors:
        raise ValueError("no selectors given")
    return [(name, compile_selector(sel)) for name, sel in selectors.items()]


def select_fields(pages: DataFrame, selectors: dict[str, str], mode: str = "text") -> DataFrame:
    """H12/H13 long form: ``(page_id, field, n_hits, ord, value)``.

    A field with no hit gives one row with ``n_hits = 0`` and NULL value.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    compiled = _compile_all(selectors)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = {"page_id": [], "field": [], "n_hits": [], "ord": [], "value": []}
            for pid, html in zip(pdf["page_id"], pdf["html"]):
                tree = _feed(html if isinstance(html, str) else "")
                for name, chains in compiled:
                    vals = select(tree, chains, mode)
                    if not vals:
                        vals_out = [(None, None)]
                    else:
                        vals_out = list(enumerate(vals))
                    for o, v in vals_out:
                        rows["page_id"].append(pid)
                        rows["field"].append(name)
                        rows["n_hits"].append(len(vals))
                        rows["ord"].append(o)
                        rows["value"].append(v)
            yield pd.DataFrame(rows)

    return pages.select("page_id", "html").mapInPandas(
        run, "page_id long, field string, n_hits long, ord long, value string"
    )


def selector_lists(pages: DataFrame, selectors: dict[str, str], mode: str = "text") -> DataFrame:
    """One row per page with a list column per field (NULL when no hit), and nothing else of the page.

    The list columns leave the workers as Arrow lists; body text and scores,
    which ``selector_record`` adds, are not computed.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    compiled = _compile_all(selectors)
    names = [n for n, _ in compiled]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [[] for _ in compiled]
            for html in batch.column("html").to_pylist():
                tree = _feed(html or "")
                for (_, chains), column in zip(compiled, found):
                    column.append(select(tree, chains, mode) or None)
            lists = [pa.array(column, pa.list_(pa.string())) for column in found]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *lists], names=["page_id", *names])

    kind = dict(pages.dtypes)["page_id"]
    fields = ", ".join(f"`{n}` array<string>" for n in names)
    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, {fields}")


def selector_record(pages: DataFrame, selectors: dict[str, str], mode: str = "text", status_col: str | None = None) -> DataFrame:
    """H12 record form with X18/X19: one row per page with ``data``
    (field → values, NULL when no hit), success score and completeness."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    compiled = _compile_all(selectors)
    names = [n for n, _ in compiled]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = {"page_id": [], "data": [], "body_text": []}
            for pid, html in zip(pdf["page_id"], pdf["html"]):
                tree = _feed(html if isinstance(html, str) else "")
                data = {}
                for name, chains in compiled:
                    vals = select(tree, chains, mode)
                    data[name] = vals if vals else None
                out["page_id"].append(pid)
                out["data"].append(data)
                out["body_text"].append(body_text(tree, "stripped"))
            yield pd.DataFrame(out)

    rec = pages.select("page_id", "html").mapInPandas(
        run, "page_id long, data map<string, array<string>>, body_text string"
    )
    # One string per field: the single value, or the JSON list for many hits.
    values = F.array(
        *[
            F.when(F.size(F.col("data")[n]) == 1, F.col("data")[n][0]).when(
                F.col("data")[n].isNotNull(), F.to_json(F.col("data")[n])
            )
            for n in names
        ]
    )
    code = F.col(status_col) if status_col else F.lit(200)
    return rec.select(
        "page_id",
        "data",
        "body_text",
        S.success_score(code, values).alias("success_score"),
        S.data_completeness(values, F.lit(len(names))).alias("data_completeness"),
    )
