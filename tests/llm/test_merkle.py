import hashlib

from pyspark.sql import functions as F

from pagelake.llm import merkle
from pagelake.llm.common import keyed

from .helpers import empty, frame


def brute(rows):
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    texts = [r[2] or "" for r in order]
    out = {}
    for k, (rid, doc_id, _) in enumerate(order):
        t, nxt = texts[k], texts[(k + 1) % len(texts)]
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        out[rid] = (doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), t, e, nxt)
    return out


def leaves(text):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    words = [p.split(" ") for p in text.split("\n")]
    return [[md5(" ".join(w[i : i + 4])) for i in range(0, len(w), 4)] for w in words]


def tree(text):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    lv = leaves(text)
    par = [md5(",".join(p)) for p in lv]
    sec = [md5(",".join(par[i : i + 8])) for i in range(0, len(par), 8)]
    root = hashlib.sha256(",".join(sec).encode()).hexdigest()
    return "|".join([root, ",".join(s[:8] for s in sec), ";".join("".join(h[:8] for h in p) for p in lv)])


def dice(a, b):
    a, b = ({h[:8] for p in leaves(t) for h in p} for t in (a, b))
    return 2 * len(a & b) / (len(a) + len(b))


def check(spark, df):
    want = brute([tuple(r) for r in keyed(df).collect()])
    got = merkle.edits(df).collect()
    assert {r.rid for r in got} == set(want) and len(got) == len(want)
    for r in got:
        doc_id, n, sha, t, e, nxt = want[r.rid]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (doc_id, n, sha)
        assert r.fingerprint == tree(t) and r.edited_fingerprint == tree(e)
        assert abs(r.near_edited - dice(t, e)) < 1e-12 and abs(r.near_next - dice(t, nxt)) < 1e-12


def test_awkward_rows(spark):
    check(spark, frame(spark))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, docs)
    near = merkle.edits(docs).where("n_chars > 100").agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).first()
    assert near.e > 0.6 > 0.1 > near.n


def test_one_row_and_none(spark):
    one = frame(spark, [(7, "abcdefgh", None, None, None, None, None)])
    r = merkle.edits(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert merkle.edits(empty(spark)).count() == 0
    assert merkle.fingerprints(empty(spark)).count() == 0


def test_differing_paragraphs(spark):
    base = [f"paragraph {i} has some words that stay as they are" for i in range(30)]
    new = base[:]
    new[3], new[17] = "changed", base[17] + " more"
    cases = [(base, base, []), (base, new, [3, 17]), (base, base[:28], [28, 29]), (["x"], ["y"], [0])]
    df = spark.createDataFrame([("\n".join(a), "\n".join(b), w) for a, b, w in cases], "a string, b string, want array<int>")
    fa = merkle.fingerprints(df, "a").withColumnRenamed("fingerprint", "fa")
    both = merkle.fingerprints(fa, "b").select("want", merkle.differing_paragraphs(F.col("fa"), F.col("fingerprint")).alias("got"))
    assert all(r.got == r.want for r in both.collect())
