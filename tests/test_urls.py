"""X4 URL resolution against urllib.parse.urljoin (property test)."""

from urllib.parse import urljoin

from hypothesis import given, settings
from hypothesis import strategies as st

from pagelake.functions import urls as U

SEG = st.sampled_from(["a", "b", "..", ".", "", "c.html", "x-y"])
BASES = [
    "http://h.example.com/d1/d2/page.html?q=1#f",
    "https://h.example.com/",
    "https://h.example.com",
    "http://u:p@h.example.com:8080/a/b/",
]


@st.composite
def links(draw):
    kind = draw(st.sampled_from(["abs", "root", "rel", "query", "frag", "proto"]))
    path = "/".join(draw(st.lists(SEG, min_size=1, max_size=5)))
    if kind == "abs":
        return "https://other.example.org/" + path
    if kind == "root":
        return "/" + path
    if kind == "query":
        return "?" + path.replace("/", "")
    if kind == "frag":
        return "#" + path.replace("/", "")
    if kind == "proto":
        return "//cdn.example.net/" + path
    return path or "x"


def test_resolve_matches_urljoin(spark):
    samples = []

    @settings(max_examples=150, deadline=None)
    @given(st.sampled_from(BASES), links())
    def collect(base, link):
        samples.append((base, link))

    collect()
    df = spark.createDataFrame(samples, "base string, link string")
    got = df.select("base", "link", U.resolve("base", "link").alias("r")).collect()
    bad = [(r.base, r.link, r.r, urljoin(r.base, r.link)) for r in got if r.r != urljoin(r.base, r.link)]
    assert not bad, bad[:5]


def test_netloc_and_validity(spark):
    df = spark.createDataFrame([("https://u:p@h.com:81/x",), ("no-scheme.com/x",), ("//h.com/y",)], "u string")
    r = df.select(U.netloc("u").alias("n"), U.is_valid_url("u").alias("v"), U.with_scheme("u").alias("w")).collect()
    assert [x.n for x in r] == ["u:p@h.com:81", "", "h.com"]
    assert [x.v for x in r] == [True, False, False]
    assert r[1].w == "https://no-scheme.com/x"


PIECES = st.sampled_from(["a", "+", "%", "%2", "%20", "%zz", "%C3%A9", "%E9", "%2B", "%25", "é", "/", "?x=1&y=2", " "])


@given(st.lists(st.lists(PIECES, min_size=0, max_size=8), min_size=20, max_size=40))
@settings(max_examples=5, deadline=None)
def test_url_decode_matches_unquote(spark, batch):
    from urllib.parse import unquote

    values = ["".join(p) for p in batch]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    got = {r.i: r.d for r in df.select("i", U.url_decode("v").alias("d")).collect()}
    assert got == {i: unquote(v) for i, v in enumerate(values)}
