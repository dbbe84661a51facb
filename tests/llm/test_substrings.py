import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pagelake.llm import substrings as sub

from .helpers import empty, frame


def brute(rows, window):
    """rows: (rid, doc_id, text)."""
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    seen, out = set(), []
    for rid, doc_id, text in order:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone.update(range(i, i + window))
            seen.add(w)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((rid, doc_id, len(words), len(gone), kept, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(spark, data, window=20, seed=8):
    df = frame(spark, data)
    rows = [tuple(r) for r in sub.keyed(df).collect()]
    got = sub.dedup(df, window, seed).collect()
    assert sorted((r.rid, r.doc_id, r.n_words, r.n_removed, bytes(r.kept), r.kept_sha256) for r in got) == brute(rows, window)
    for r in got:
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed


def doc(i, text):
    return (i, text, None, None, None, None, None)


def test_awkward_rows(spark):
    check(spark, None)


def test_empty_table(spark):
    assert sub.dedup(empty(spark)).count() == 0


def test_planted_passages(spark, monkeypatch):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(15, 90))] for _ in range(6)]
    data = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, 10)
            words += [rng.choice(vocab) for _ in range(rng.randint(0, 30))] + p[a : len(p) - rng.randint(0, 10)]
        data.append(doc(rng.randint(0, 5000), rng.choice([" ", "\n", "\t "]).join(words)))
    check(spark, data + data[:10])


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=60), max_size=12))
def test_low_complexity(spark, texts):
    check(spark, [doc(i, t) for i, t in enumerate(texts)], 5, 2)


def test_paths_cover_each_window_once():
    import numpy as np

    rng = np.random.default_rng(1)
    codes = rng.integers(0, 50, 3000).astype(np.uint64)
    valid = np.ones(3000, bool)
    valid[-19:] = False
    valid[1000:1019] = False
    _, _, lo, n = sub.paths(codes, valid, 20, 8)
    assert sorted(x for a, c in zip(lo, n) for x in range(a, a + c)) == list(np.flatnonzero(valid))


def test_long_document_in_chunks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(sub, "CHUNK", 64)
    batch = sub.pa.RecordBatch.from_pydict({"rid": [0, 1], "doc_id": [0, 1], "text": [" ".join(f"x{i % 90}" for i in range(500)), "a " * 30]})
    out = next(sub._paths(20, 8)(iter([batch]))).to_pydict()
    got = sorted((r, lo + k) for r, lo, n in zip(out["rid"], out["lo"], out["n"]) for k in range(n))
    assert got == [(0, i) for i in range(481)] + [(1, i) for i in range(11)]
    assert isinstance(sub.hashes([b"a"]), np.ndarray)
