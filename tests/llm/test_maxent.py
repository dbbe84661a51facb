import math
import random
import zlib
from collections import Counter

import numpy as np

from pagelake.llm import maxent

from .helpers import empty, frame

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return (text or "").translate(FOLD).encode().split() + [b""]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def check_base(rows, out):
    """rows: (doc_id, text) of the table; out: rows of ``train_and_score`` by the same order key."""
    counts = Counter(t for d, x in rows if not held(d) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, x in rows:
        ts = tokens(x)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        want.append((str(d), len(ts), sum(counts[t] > 0 for t in ts), n, round(base, 6)))
    got = [(str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out]
    assert sorted(got) == sorted(want)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = maxent.op4(spark, "/root/testdata/sf0.01").collect()
    check_base([(r.doc_id, r.text) for r in docs.collect()], out)
    unseen = [r for r in out if r.held_out]
    assert {r.doc_id for r in unseen} == {r.doc_id for r in out if held(r.doc_id)}
    # Better than the base on held-out text, by far and nearly everywhere.
    assert sum(r.score for r in unseen) > 0.97 * sum(r.base_score for r in unseen)
    assert np.mean([r.score > r.base_score for r in unseen]) > 0.9
    assert all(r.score < 0 for r in out)


def test_probabilities_add_up_to_one(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("the of and a Zebra. lion, tiger x1 y22 z333 q".split()) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    rows = frame(spark, [(i, t, None, None, None, None, None) for i, t in enumerate(texts)]).select("text")
    counts = maxent.count_words(rows)
    model = maxent.fit(rows, maxent.vocabulary(counts, 9, 12), 3)
    n, v = model.vocab.frequent, model.vocab
    history = np.array([0, 5, 70, 900, maxent.NEAR * maxent.SKIP - 1])
    chosen = np.exp(model.class_log(history))
    assert np.allclose(chosen.sum(axis=1), 1, atol=1e-5)
    words = np.exp(model.word_log(np.arange(model.classes + 1)))
    group = model.buckets.group[:n]
    for g in range(group.max() + 1):
        if (group == g).any():
            assert np.allclose(words[:, group == g].sum(axis=1), 1, atol=1e-5)
    # Ending classes: shares of their words and one unseen word.
    mass = np.full(maxent.ENDINGS, maxent.SMOOTH)
    for r in counts.collect():
        if bytes(r.word) not in v.words[:n]:
            mass[maxent.ending(bytes(r.word))] += r.c + maxent.SMOOTH
    assert np.allclose(mass, v.mass)


def test_rare_words_by_join(spark):
    """With a tiny broadcast list most counts come by the join; the base is the same."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = maxent.train_and_score(docs, 4, 6).collect()
    check_base([(r.doc_id, r.text) for r in docs.collect()], out)


def test_awkward_rows(spark):
    df = frame(spark)
    out = maxent.train_and_score(df).collect()
    check_base([(r.doc_id, r.text) for r in df.collect()], out)
    assert len({r.rid for r in out}) == df.count() and all(np.isfinite(r.score) for r in out)


def test_empty_table(spark):
    assert maxent.train_and_score(empty(spark)).count() == 0


def test_nothing_to_learn(spark):
    only = frame(spark, [(i, "a few words", None, None, None, None, None) for i in range(60) if held(i)])
    out = maxent.train_and_score(only).collect()
    assert out and all(r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) for r in out)
