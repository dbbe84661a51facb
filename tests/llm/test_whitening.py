import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, component string, v string"


def frame(spark, vectors):
    rows = [(i, v, 1, "clash", None) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def good(v, d):
    return v is not None and len(v) == d and all(c is not None and abs(c) * 64 < 2**62 for c in v)


def brute(df, d, k):
    """Rows by exact integers and the library's symmetric eigensolver."""
    rows = [(r.vec_id, [math.floor(64 * c) + 1_000_000 for c in r.embedding]) for r in df.collect() if good(r.embedding, d)]
    fit = sorted({tuple(x) for _, x in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for vec_id, x in rows:
        away = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        centred = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)])
        for i in range(min(k, d)):
            out.setdefault((vec_id, i + 1), []).append((n, away, float(centred @ vectors[:, i]) / math.sqrt(values[i]), values[i] / values.sum()))
    return out


def check(df, d, k=16):
    got = {}
    for r in whitening.whiten(df, whitening.train(df, k)).collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
    want = brute(df, d, k)
    assert got.keys() == want.keys()
    signs = {}
    for key, rows in got.items():
        assert len(rows) == len(want[key])
        for r, (n, away, white, explained) in zip(rows, want[key]):
            assert (r.n, r.deviation) == (n, away)
            assert r.explained == pytest.approx(explained, rel=1e-9)
            assert abs(abs(r.whitened) - abs(white)) < 1e-8
            assert r.identity_error < 1e-9
            if abs(white) > 1e-6:
                assert signs.setdefault(key[1], r.whitened * white > 0) == (r.whitened * white > 0)


def test_against_the_eigensolver(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((300, 12)) * np.linspace(0.2, 2, 12)).tolist()
    check(frame(spark, vectors + vectors[:40] + [vectors[0]] * 200), 12)
    check(frame(spark, vectors), 12, k=3)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((40, 3)).tolist()
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 1.0], [float("inf"), 0.0, 1.0], [1e300, 0.0, 0.0], [1.0], [0.0] * 9]
    wide = [[1e9, -3.0, 0.25], [-1e9, 5.0, 40000.0], [2.0**31, 1.0, 1.0], [-0.0, 0.0, -1e-9]]
    df = frame(spark, bad + vectors[:20] + bad + vectors + wide)
    small = frame(spark, bad + vectors[:20] + bad + vectors)
    check(small, 3)
    model = whitening.train(df)
    assert model.n == 44
    got = whitening.whiten(df, model)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.count() == 64 * model.values.size


def test_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 2.0]), (None, [2.0, 2.5]), (1, [0.0, 7.0]), (1, [0.0, 7.0]), (1, [3.0, 0.0])]
    df = spark.createDataFrame([(i, v, None, None, None) for i, v in rows], SCHEMA)
    assert whitening.whiten(df, whitening.train(df)).where("n = 4").count() == 10


def test_no_variance(spark):
    none = spark.createDataFrame([], SCHEMA)
    for df in (none, frame(spark, [None, []]), frame(spark, [[1.0, 2.0]] * 5)):
        assert whitening.whiten(df, whitening.train(df)).count() == 0
    # One constant dimension, two equal ones: only components with variance are numbered.
    rng = np.random.default_rng(5)
    df = frame(spark, [[a, a, 3.0] for a in rng.standard_normal(30).tolist()])
    out = whitening.whiten(df, whitening.train(df))
    assert out.agg(F.max("component")).first()[0] == 1
    assert out.first().explained == pytest.approx(1)


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_spectrum(d):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((d, d))
    a = a + a.T
    values, vectors = whitening.spectrum(a, d)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-13)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-12)


@pytest.mark.parametrize("values", [[1] * 6, [3, 2, 1], [5, 5, 5, 1, 1, 0, 0], [1e9, 1, 1, 1e-9], list(range(20)), [0, 0], [-1, 0, 1]])
def test_spectrum_with_equal_or_spread_components(values):
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    for a in (np.diag(np.array(values, float)), q * np.array(values, float) @ q.T):
        a = (a + a.T) / 2
        got, vectors = whitening.spectrum(a, len(values))
        scale = max(map(abs, values)) or 1
        assert np.allclose(got, sorted(values, reverse=True), atol=1e-13 * scale * len(values))
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13)


def test_polar_factor():
    rng = np.random.default_rng(9)
    a = rng.standard_normal((9, 9))
    u, _, v = np.linalg.svd(a)
    assert np.allclose(whitening.polar(a), u @ v, atol=1e-12)


def test_given_embeddings(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), 64)
