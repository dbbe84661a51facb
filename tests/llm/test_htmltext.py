from pagelake.llm import htmltext as h

TREE = h.trained_tree()

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href="/">Site name of this place</a></header><nav><ul><li><a href="/a">menu</a></li><li>more menu</li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site and this notice tells you at length about all of them.</p></div>
<!-- <p>commented out text</p> --><div class="ad">Buy this thing now, it is cheap and you surely need one.</div>
<article><h1>Head &amp; line</h1><p class="lead">First&nbsp;para
graph with <b>bold</b> and <a href="x>y">a link</a>.<br>After a break<p>Short.</p>
<form><label>Mail</label><input value="x"><p>Give us your address please and press the button below.</p></form>
<p>Caf&eacute; &lt;tag&gt; &#8364;5 &copy</p><ul><li>item one</li><li>item two</li></ul></article>
<aside><p>A side bar that talks about something quite different from the article beside it.</p></aside>
<section id="comments"><article class="comment"><p>I am a reader and I have a long opinion about this article here.</p></article></section>
<footer>&copy; 2020 owner of the site and all that is on it, for ever and ever.</footer></body></html>"""

TEXT = "Head & line\nFirst para graph with bold and a link. After a break\nShort.\nCafé <tag> €5 ©\nitem one\nitem two"


def test_article_page():
    assert h.main_text(PAGE, TREE) == TEXT


def test_page_that_breaks_off():
    start = PAGE[: PAGE.index("Short.") + 6]
    assert h.main_text(start, TREE) == "\n".join(TEXT.split("\n")[:3])
    assert h.main_text(start + "<a href='", TREE) == "\n".join(TEXT.split("\n")[:3])
    assert h.main_text(start + "<script>var x = 1; <p>", TREE) == "\n".join(TEXT.split("\n")[:3])


def test_page_without_telling_containers():
    prose = "These are quite a few words that make up a paragraph of plain prose without any link in it at all. " * 2
    page = f"<body><div><a>one</a> <a>two</a></div><div><a>three</a></div><div><p>{prose}</p><p>{prose}</p></div><div><a>next page</a></div></body>"
    assert h.main_text(page, TREE) == "\n".join([prose.strip()] * 2)


def test_no_main_text():
    for page in (None, "", "   ", "<p>", "<nav>a</nav>", "<html><body></body></html>", "<!-- never closed"):
        assert h.main_text(page, TREE) == ""


def test_tree_fits_its_table_and_uses_the_zone():
    for *features, label in h.LABELLED:
        assert h.decide(TREE, features) == label
    flat = str(TREE)
    assert f"({h.FEATURES.index('zone')}, " in flat and f"({h.FEATURES.index('links')}, " in flat


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", "y"), (3, "w", "<p>" + "word " * 200000, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in h.extract(df).collect()), key=str)
    long = ("word " * 200000).strip()
    want = [(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0), (2, "v", "", 0), (3, "w", long, len(long))]
    assert out == sorted(want, key=str)
    assert h.extract(df.limit(0)).count() == 0


def test_given_pages_hold_whole_articles(spark):
    """Every given page: the article element, its blocks in order, nothing else."""
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for page_id, page in pages.items():
        body = re.sub(r"<[^>]*\Z", "", re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1])
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert h.main_text(page, TREE) == "\n".join(p for p in parts if p), page_id


def test_layout_classes_leave_the_text():
    swaps = [
        ("<body>", "<body class='has-sidebar'>"),
        ("<body>", "<body class='sidebar search ad'>"),
        ("<html>", "<html class='no-cookie'>"),
        ("<article>", "<article class='post comments-open'>"),
        ("<article>", "<article class='has-comments'>"),
        ("<article>", "<article class='sidebar-left'>"),
        ("<article>", "<main class='search widget'><article>"),
        ("<body>", "<body><div id='page' class='with-comments'>"),
        ("<body>", "<body><div class='sidebar-layout'><div class='widget-area banner'>"),
        ("<article>", "<div class='subscribe-wrap'><article>"),
    ]
    for old, new in swaps:
        assert old in PAGE and h.main_text(PAGE.replace(old, new, 1), TREE) == TEXT, new


def test_layout_classes_without_an_article():
    prose = "These are quite a few words that make up a paragraph of plain prose without any link in it at all. " * 2
    page = f"<body><div class='%s'><p>{prose}</p><p>{prose}</p></div><div class='comments'><p>{prose}</p></div></body>"
    for name in ("sidebar-page", "widget", "has-comments"):
        assert h.main_text(page % name, TREE) == "\n".join([prose.strip()] * 2), name
    assert h.main_text(page.replace("%s", "page"), TREE) == "\n".join([prose.strip()] * 2)


def test_comments_stay_out_beside_an_article():
    reader = "<article><p>I am a reader and I have a long opinion about this article here.</p></article>" * 30
    page = PAGE.replace('<section id="comments">', f'<section id="comments">{reader}')
    for wrap in ("<body>", "<body><div class='with-comments'>", "<body><div class='sidebar-layout'>"):
        assert h.main_text(page.replace("<body>", wrap), TREE) == TEXT


def test_formulas_and_labels_in_an_article_are_text():
    page = "<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> so.</p><noscript><p>Plain words.</p></noscript><p>Press <button>Go</button> now.</p></article>"
    assert h.main_text(page, TREE) == "Energy is E=m so.\nPlain words.\nPress Go now."


def test_head_that_is_not_closed():
    page = "<html><head><meta charset=utf-8><title>x <b></title><style>p{}</style><body><article><h1>Head</h1><p>Some text of the article.</p></article>"
    assert h.main_text(page, TREE) == "Head\nSome text of the article."
    assert h.main_text(PAGE.replace("</head>", ""), TREE) == TEXT


def test_linked_items_of_an_article_stay():
    items = "".join(f'<li><a href="/{i}">item number {i}</a></li>' for i in range(5))
    page = f"<body><ul><li><a>menu</a></li><li><a>more</a></li></ul><article><p>These are the items that the text is about.</p><ul>{items}</ul></article>"
    assert h.main_text(page, TREE).split("\n")[1:] == [f"item number {i}" for i in range(5)]


def test_reader_responses_go():
    page = PAGE.replace('<section id="comments">', '<section class="reader-responses">')
    assert h.main_text(page, TREE) == TEXT


def test_a_quote_that_is_not_closed():
    for tag in ('<p class="lead>', "<p class='lead>", '<p title="a" class="lead>'):
        page = f"<article>{tag}Words of a paragraph.</p><p>And more of them.</p></article>"
        assert h.main_text(page, TREE) == "Words of a paragraph.\nAnd more of them.", tag
    # Up to the next quote, as a browser reads it; never the tag itself.
    assert "<" not in h.main_text('<article><p class="lead>one</p><p>two <a href="x">three</a> four</p></article>', TREE)
