"""P6 records from hand-made article pages."""

from pagelake.operators import articles

PAGE = """<html><body><h1 class="lead article-title"> Big &amp; small </h1><span class="author-name">A. Writer</span>
<time datetime="2024-05-01">May 1</time><div class="article-content"><p>First part.</p><div><p>Second <b>bold</b> part.</p></div></div><p>outside</p>
<div class="article-tags"><a>one</a><a>two</a></div><div class="related-articles"><a>no link</a><a href="/r">Other story</a></div></body></html>"""


def test_article_fields(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>nothing</p>"), (3, None)], "page_id long, html string")
    got = {r.page_id: r for r in articles.article_records(pages).collect()}
    r = got[1]
    assert (r.headline, r.author, r.date) == ("Big & small", "A. Writer", "May 1")
    assert r.content == "First part. Second bold part." and r.word_count == 5
    assert r.tags == ["one", "two"] and r.related == ["Other story"]
    for empty in (got[2], got[3]):
        assert tuple(empty)[1:] == ("", "", "", "", [], [], 0)


def test_own_selectors(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    own = articles.ARTICLE_SELECTORS | {"headline": "time", "content": "p"}
    r = articles.article_records(pages, own).first()
    assert r.headline == "May 1" and r.content == "First part. Second bold part. outside"


def test_records_take_only_the_fields_asked_for(spark, monkeypatch):
    """No body text is gathered for a record, and the content is cut into words once."""
    pages = spark.createDataFrame([(1, PAGE.replace("First part.", " First 　\tpart. ")), (None, None)], "page_id long, html string")
    rec = articles.article_records(pages)
    plan = rec._jdf.queryExecution().optimizedPlan().toString()
    assert "body_text" not in plan and plan.count("split(") == 1
    got = {r.page_id: r.word_count for r in rec.collect()}
    assert got == {1: 5, None: 0}
