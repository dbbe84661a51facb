"""Operator 9, main text of HTML pages by classified flat text blocks.

A page becomes a flat list of text blocks (no tree).  Each block has its word
count, its link density, the same two of the blocks before and after it, and
the zone its containers put it in, which is settled when the whole page is read.  A decision tree, grown here from the
small labelled table below, says which blocks are main text; those are joined
in page order.  Pages are independent, so there is no shuffle; one page is held
at a time.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagelake.llm.common import table
from pagelake.llm.registry import query

FEATURES = ("words", "links", "before_words", "before_links", "after_words", "after_links", "zone", "heading")
BOILER, OPEN, ARTICLE = -1, 0, 1

# Labelled blocks: the eight features in order, then 1 for main text.  Links
# are the share of a block's words inside anchors.
LABELLED = [
    # inside an article or main element: prose, headings, short lines, linked prose
    (9, 0.0, 12, 1.0, 60, 0.0, ARTICLE, 1, 1),
    (4, 0.0, 1, 1.0, 80, 0.0, ARTICLE, 1, 1),
    (75, 0.0, 8, 0.0, 90, 0.0, ARTICLE, 0, 1),
    (120, 0.05, 60, 0.0, 70, 0.1, ARTICLE, 0, 1),
    (5, 0.0, 90, 0.0, 60, 0.0, ARTICLE, 0, 1),
    (1, 0.0, 40, 0.0, 50, 0.0, ARTICLE, 0, 1),
    (2, 0.0, 3, 0.0, 2, 0.0, ARTICLE, 0, 1),
    (3, 1.0, 60, 0.0, 70, 0.0, ARTICLE, 0, 1),
    (6, 1.0, 45, 0.1, 30, 0.0, ARTICLE, 0, 1),
    (14, 0.6, 30, 0.0, 9, 0.0, ARTICLE, 0, 1),
    (30, 0.0, 5, 0.0, 12, 0.4, ARTICLE, 0, 1),
    (8, 0.0, 0, 0.0, 0, 0.0, ARTICLE, 0, 1),
    (10, 0.0, 70, 0.0, 12, 0.0, ARTICLE, 0, 1),
    (70, 0.0, 80, 0.0, 0, 0.0, ARTICLE, 0, 1),
    (6, 0.0, 80, 0.0, 0, 0.0, ARTICLE, 0, 1),
    (3, 0.0, 2, 1.0, 1, 1.0, ARTICLE, 0, 1),
    (1, 0.0, 1, 0.0, 1, 0.0, ARTICLE, 0, 1),
    (5, 0.0, 1, 1.0, 5, 1.0, ARTICLE, 1, 1),
    # a list of links inside an article
    (4, 1.0, 5, 1.0, 4, 1.0, ARTICLE, 0, 1),
    (7, 1.0, 6, 1.0, 8, 1.0, ARTICLE, 0, 1),
    (3, 1.0, 4, 1.0, 3, 1.0, ARTICLE, 0, 1),
    # menus, headers, footers, sidebars, notices, adverts, forms, reader comments
    (1, 1.0, 1, 1.0, 1, 1.0, BOILER, 0, 0),
    (2, 1.0, 0, 0.0, 3, 1.0, BOILER, 0, 0),
    (9, 0.0, 1, 1.0, 8, 0.0, BOILER, 0, 0),
    (14, 0.0, 70, 0.0, 0, 0.0, BOILER, 0, 0),
    (45, 0.0, 40, 0.0, 60, 0.0, BOILER, 0, 0),
    (90, 0.02, 80, 0.0, 70, 0.0, BOILER, 0, 0),
    (150, 0.0, 60, 0.0, 90, 0.0, BOILER, 0, 0),
    (5, 0.0, 3, 0.0, 40, 0.0, BOILER, 1, 0),
    (3, 0.0, 90, 0.0, 20, 0.0, BOILER, 1, 0),
    (25, 0.5, 20, 0.4, 30, 0.0, BOILER, 0, 0),
    (22, 0.0, 70, 0.0, 0, 0.0, BOILER, 0, 0),
    (60, 0.0, 90, 0.0, 0, 0.0, BOILER, 0, 0),
    (35, 0.0, 3, 1.0, 5, 1.0, BOILER, 0, 0),
    (18, 0.1, 50, 0.0, 2, 1.0, BOILER, 0, 0),
    (120, 0.0, 2, 0.0, 4, 0.0, BOILER, 0, 0),
    (40, 0.0, 0, 0.0, 90, 0.0, BOILER, 0, 0),
    (200, 0.0, 0, 0.0, 0, 0.0, BOILER, 0, 0),
    # no telling container: word count and link density of the block and its neighbours
    (80, 0.0, 90, 0.0, 75, 0.0, OPEN, 0, 1),
    (60, 0.1, 7, 0.0, 80, 0.0, OPEN, 0, 1),
    (40, 0.0, 50, 0.0, 35, 0.0, OPEN, 0, 1),
    (28, 0.2, 60, 0.0, 45, 0.0, OPEN, 0, 1),
    (22, 0.0, 3, 1.0, 50, 0.0, OPEN, 0, 1),
    (18, 0.0, 45, 0.0, 60, 0.0, OPEN, 0, 1),
    (6, 0.0, 55, 0.0, 70, 0.0, OPEN, 0, 1),
    (4, 0.0, 40, 0.0, 38, 0.0, OPEN, 0, 1),
    (35, 0.0, 2, 1.0, 6, 1.0, OPEN, 0, 1),
    (16, 0.0, 70, 0.0, 4, 1.0, OPEN, 0, 1),
    (200, 0.0, 0, 0.0, 0, 0.0, OPEN, 0, 1),
    (60, 0.0, 0, 0.0, 0, 0.0, OPEN, 0, 1),
    (30, 0.0, 1, 1.0, 0, 0.0, OPEN, 0, 1),
    (45, 0.1, 60, 0.0, 0, 0.0, OPEN, 0, 1),
    (8, 0.0, 2, 1.0, 60, 0.0, OPEN, 1, 1),
    (3, 0.0, 50, 0.0, 45, 0.0, OPEN, 1, 1),
    (6, 0.0, 5, 0.3, 40, 0.0, OPEN, 1, 1),
    (5, 0.0, 3, 1.0, 4, 1.0, OPEN, 0, 0),
    (3, 0.0, 1, 1.0, 2, 1.0, OPEN, 0, 0),
    (7, 0.0, 4, 0.0, 3, 1.0, OPEN, 0, 0),
    (4, 0.0, 3, 0.0, 5, 0.0, OPEN, 0, 0),
    (2, 0.0, 0, 0.0, 0, 0.0, OPEN, 0, 0),
    (9, 0.0, 60, 0.0, 2, 1.0, OPEN, 0, 0),
    (8, 0.1, 45, 0.0, 0, 0.0, OPEN, 0, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, OPEN, 0, 0),
    (4, 1.0, 60, 0.0, 4, 1.0, OPEN, 0, 0),
    (1, 1.0, 2, 1.0, 40, 0.0, OPEN, 0, 0),
    (3, 1.0, 1, 1.0, 70, 0.0, OPEN, 0, 0),
    (6, 0.9, 4, 1.0, 25, 0.1, OPEN, 0, 0),
    (2, 1.0, 60, 0.0, 50, 0.0, OPEN, 0, 0),
    (12, 0.9, 6, 1.0, 9, 0.8, OPEN, 0, 0),
    (30, 0.8, 20, 0.7, 25, 0.9, OPEN, 0, 0),
    (25, 0.6, 4, 1.0, 6, 1.0, OPEN, 0, 0),
    (3, 0.0, 2, 1.0, 3, 1.0, OPEN, 1, 0),
    (2, 0.0, 5, 0.0, 4, 1.0, OPEN, 1, 0),
]

# Elements whose content is no text of the page.
# (A head may be left open, so it is read like any other; what is in it is silent by itself.)
SILENT = "script|style|template|title|textarea|select|svg|iframe|object|canvas|audio|video"
# Elements that end a block without being containers of blocks.
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd td th tr pre hr figcaption caption summary legend address option optgroup".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset(
    "html body div section article main nav aside footer header form ul ol dl menu table thead tbody tfoot blockquote figure details dialog fieldset center".split()
)
BOILER_TAGS = frozenset("nav aside footer form menu dialog".split())
ARTICLE_TAGS = frozenset(["article", "main"])
# Words of class, id and role values.
BOILER_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
    notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu
    breadcrumb breadcrumbs sidebar aside widget widgets related recommended recommendations share sharing social comment
    comments commentlist reply replies respond responses feedback disqus discussion footer masthead topbar toolbar copyright legal disclaimer
    search pagination pager contentinfo complementary dialog skip hidden teaser teasers""".split()
)
ARTICLE_WORDS = frozenset("article post entry story content main".split())
# A compound that begins or ends with one tells a state of the page.
STATES = frozenset("has no not with without is show hide js can supports open closed enabled disabled active loaded ready on off free".split())

_TAG = re.compile(
    rf"""<!--.*?(?:-->|\Z)
    | <(?P<silent>{SILENT})\b(?:[^>"']|"[^"]*"|'[^']*')*(?:/>|>.*?(?:</(?P=silent)\s*>|\Z))
    | <(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*'|["'](?=[^"'>]*>))*)>
    | <[!?][^>]*(?:>|\Z)
    | </?[a-z][^<>]*\Z""",
    re.I | re.S | re.X,
)
_MARKS = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _hit(token: str) -> int:
    """2 if a class, id or role names boilerplate, 1 if other words stand beside such a word, else 0.

    A state of the page (``has-sidebar``, ``comments-open``) names nothing.
    """
    words = _WORD.findall(_CAMEL.sub(" ", token).lower())
    if not BOILER_WORDS.intersection(words) or words[0] in STATES or words[-1] in STATES:
        return 0
    return 2 if BOILER_WORDS.issuperset(words) else 1


def _marks(attrs: str) -> tuple[bool, int, bool]:
    """Whether an element is hidden, the strongest hit of its words, and whether one is of articles."""
    hit, article = 0, False
    for key, value in _MARKS.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True, hit, article
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, hit, article
        elif key in ("class", "id", "role"):
            for token in value.split():
                hit = max(hit, _hit(token))
                article = article or not ARTICLE_WORDS.isdisjoint(_WORD.findall(_CAMEL.sub(" ", token).lower()))
    return False, hit, article


def _zones(boxes: list[tuple[int, str, bool, int, bool]], words: list[int]) -> list[int]:
    """Zone of each container (parent, name, hidden, hit, article word) from the whole page.

    ``words`` are those directly in each.  A hit makes a container boilerplate
    unless it is the layout around the page's text: if no article stands outside
    all hits, those that hold one (or, without any, most of the words) give way,
    from the outside in.
    """
    n = len(boxes)
    fixed, hits, good = [False] * n, [0] * n, [False] * n
    for i, (parent, name, hidden, hit, article) in enumerate(boxes):
        if i:
            fixed[i] = fixed[parent] or name in BOILER_TAGS or (hidden and name not in ("html", "body"))
        good[i] = not fixed[i] and (name == "main" or (name == "article" and (hit < 2 or article)))
        hits[i] = 0 if good[i] or name in ("html", "body") else hit
    inside = [0 if f else w for f, w in zip(fixed, words)]
    main = [g and box[1] == "main" for g, box in zip(good, boxes)]
    holds = list(good)
    for i in range(n - 1, 0, -1):
        parent = boxes[i][0]
        inside[parent] += inside[i]
        holds[parent] = holds[parent] or holds[i]
        main[parent] = main[parent] or main[i]
    while True:
        top = [-1] * n  # the outermost container with a hit
        for i in range(1, n):
            top[i] = top[boxes[i][0]] if top[boxes[i][0]] >= 0 else i if hits[i] else -1
        if any(g and t < 0 for g, t in zip(good, top)):
            break
        most = lambda i: 2 * inside[i] > inside[0]
        layout = {i for i in set(top) if i >= 0 and not fixed[i] and (most(i) or (holds[i] and (main[i] or hits[i] == 1)))}
        if not layout:
            break
        for i in layout:
            hits[i] = 0
    zones = [OPEN] * n
    for i in range(1, n):
        parent, name, _, _, article = boxes[i]
        within = zones[parent]
        if fixed[i] or top[i] >= 0:
            zones[i] = BOILER
        elif name in ("html", "body"):
            zones[i] = within
        elif name == "header":  # a page's header; that of an article holds its title
            zones[i] = within if within == ARTICLE or holds[i] else BOILER
        else:
            zones[i] = ARTICLE if name in ARTICLE_TAGS or article else within
        if within == BOILER:
            zones[i] = BOILER
    return zones


def blocks(page: str) -> list[tuple[str, int, float, int, int]]:
    """Flat text blocks of a page: (text, words, link share, zone, heading).

    Tags that are not closed, and a page that breaks off inside a tag, comment
    or script, are read as far as they go.
    """
    out = []
    parts: list[str] = []
    linked: list[str] = []
    boxes, sizes = [(0, "", False, 0, False)], [0]
    stack = [0]
    leaf, heading, in_link, pos = OPEN, 0, False, 0

    def flush():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            words = text.count(" ") + 1
            share = min(1.0, len("".join(linked).split()) / words)
            out.append((text, words, share, stack[-1], leaf, heading))
            sizes[stack[-1]] += words
        parts, linked = [], []

    def say(raw: str):
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked.append(text + " ")

    for m in _TAG.finditer(page):
        if m.start() > pos:
            say(page[pos : m.start()])
        pos = m.end()
        name = m["name"]
        if name is None:
            continue
        name, closing = name.lower(), bool(m["close"])
        if name == "a":
            in_link = not closing
        elif name == "br":
            parts.append(" ")
        elif name in LEAVES:
            flush()
            in_link = False
            leaf, heading = OPEN, 0
            if not closing:
                heading = int(name in HEADINGS)
                if m["attrs"].strip():
                    hidden, hit, _ = _marks(m["attrs"])
                    leaf = BOILER if hidden or hit else OPEN
        elif name in CONTAINERS:
            flush()
            in_link, leaf, heading = False, OPEN, 0
            if not closing:
                if not m["attrs"].endswith("/") or name in ("div", "section"):
                    boxes.append((stack[-1], name, *(_marks(m["attrs"]) if m["attrs"].strip() else (False, 0, False))))
                    sizes.append(0)
                    stack.append(len(boxes) - 1)
            elif any(boxes[i][1] == name for i in stack):
                while boxes[stack[-1]][1] != name:
                    stack.pop()
                stack.pop()
    if pos < len(page):
        say(page[pos:])
    flush()
    zones = _zones(boxes, sizes)
    return [(text, words, share, BOILER if leaf == BOILER else zones[box], heading) for text, words, share, box, leaf, heading in out]


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 16) -> tuple:
    """Classification tree by Gini impurity: (feature, threshold, low, high) or a label.

    Thresholds lie halfway between values; of equal splits the first feature
    and lowest threshold is taken, so the tree is the same everywhere.
    """
    share = labels.mean()
    if depth == 0 or share in (0.0, 1.0):
        return (int(share >= 0.5),)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = rows[:, f] <= cut
            gini = sum(part.size * part.mean() * (1 - part.mean()) for part in (labels[low], labels[~low]))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(cut))
    if best is None:
        return (int(share >= 0.5),)
    _, f, cut = best
    low = rows[:, f] <= cut
    return (f, cut, grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1))


def trained_tree(labelled=LABELLED) -> tuple:
    """Grow the tree on the labelled blocks and their twins in other zones.

    Each block has a twin in a menu, advert or the like, which is never main
    text, and one that is mostly not links has a twin inside an article, which
    always is.  A block and its twin differ in the zone alone, so the paths
    of both kinds test the zone."""
    data = np.array(labelled, float)
    zone, links = FEATURES.index("zone"), FEATURES.index("links")
    menu, article = data.copy(), data[data[:, links] < 0.5]
    menu[:, zone], menu[:, -1] = BOILER, 0
    article[:, zone], article[:, -1] = ARTICLE, 1
    data = np.vstack([data, menu, article])
    return grow(data[:, :-1], data[:, -1])


def decide(tree: tuple, features) -> int:
    while len(tree) > 1:
        f, cut, low, high = tree
        tree = low if features[f] <= cut else high
    return tree[0]


def main_text(page: str | None, tree: tuple) -> str:
    """Main text of one page; empty for a null page or one without main text."""
    found = blocks(page or "")
    none = ("", 0, 0.0, OPEN, 0)
    kept = []
    for i, (text, words, links, zone, heading) in enumerate(found):
        before = found[i - 1] if i else none
        after = found[i + 1] if i + 1 < len(found) else none
        if decide(tree, (words, links, before[1], before[2], after[1], after[2], zone, heading)):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", labelled=LABELLED) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages``.

    Null ids and urls pass through, a null page has an empty text, repeated
    rows are extracted each; other columns are left out.
    """
    tree = trained_tree(labelled)

    def run(batches):
        for batch in batches:
            texts = [main_text(p.as_py(), tree) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.selectExpr(f"`{page_id}` AS page_id", f"`{url}` AS url", f"`{html}` AS html")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


@query("op9_block_extraction")
def op9(spark, sf_dir):
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
