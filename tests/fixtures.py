"""Hand-made pages for the forms the driver's pages do not contain."""

TEST_PAGE = """<html><head><title>Test Page</title></head><body>
<h1>Test Title</h1>
<div class="content">Test Content</div>
<a href="/page1">Page 1</a>
<a href="/page2">Page 2</a>
<img src="/image1.jpg">
<img src="/image2.jpg">
</body></html>"""

META_PAGE = """<html><head>
<meta name="description" content="It's a page about things">
<meta content="reversed order" name="description">
<meta name="keywords" content="a,b">
<meta name="keywords" content="c,d">
<meta name="robots">
<meta property="og:title" content="OG">
<title lang="x">Attr title</title>
<title>Second
 title</title>
</head><body><p>Para one<p>Para <b>two</b></p>
<form action="/a"><input name=q></form><form>x</form><form>unclosed
<script src="https://cdn.example.com/jquery.min.js"></script>
<script>var x = 1;</script>
<h2>Sub &amp; head</h2><h1> Main <i>heading</i> </h1><h3></h3><h4>four</h4>
<nav><ul><li><a href="/n1">One</a></li><li><a href='/n2'> Two </a></li></ul></nav>
</body></html>"""

LINK_PAGE = """<html><body>
<a href="http://abs.example.com/x">abs</a>
<a href="https://abs.example.com/y">abs2</a>
<a href="HTTP://UPPER.example.com/z">upper</a>
<a href="/a">root</a>
<a href="//other.example.org/b/../c">proto</a>
<a href="/a/../b">dots</a>
<a href="rel/c">rel</a>
<a href="#frag">frag</a>
<a href="mailto:me@example.com">mail</a>
<a href="javascript:void(0)">js</a>
<a href="/a">dup</a>
<a class="x" href='/single'>single</a>
<img src="/i1.png"><img data-src="/lazy.png"><img src="http://img.example.com/i2.png">
<div ng-app="x" v-if="y">reaction $(</div>
</body></html>"""

JSON_PAGE = '{"a": 1, "b": {"c": [1, 2]}, "d": "x"}'

PAGES = [
    (1, "https://example.com", TEST_PAGE),
    (2, "https://user:pw@site.example.net:8443/dir/page.html?q=1#top", META_PAGE),
    (3, "http://links.example.com/base/index.html", LINK_PAGE),
    (4, "https://api.example.com/json", JSON_PAGE),
    (5, "https://empty.example.com/", ""),
    (6, "https://none.example.com/", None),
]
