import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelake.llm import common, phrases

from .helpers import empty, frame

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
        yield re.findall(r"[^\x20\x09]+", piece)


def counted(rows, longest):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            n[lang] += len(ws)
            for m in range(1, longest + 1):
                for i in range(len(ws) - m + 1):
                    f[lang][tuple(ws[i : i + m])] += 1
    return f, n


def brute(rows, threshold, longest=4, top=2000):
    f, n = counted(rows, longest)
    out = []
    for lang, c in f.items():
        keep = {p: a for p, a in c.items() if len(p) >= 2 and a >= threshold}
        left = []
        for p, a in keep.items():
            inside = any(
                len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in keep.items()
            )
            if not inside:
                score, _, x, y = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                left.append((-score, -a, " ".join(p).encode(), x, y))
        left.sort()
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(left[:top], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def pairs(df):
    return [(r.lang, r.text) for r in df.select("lang", "text").collect()]


SENTENCES = [
    "New York City, New York State. the new york times!",
    "machine\x0blearning is fun\tand machine learning is hard; Machine Learning",
    "a a a a a a . a a",
    "straße Straße STRASSE\nstraße straße",
    "\x00 odd \x00 odd \xa0 nbsp\xa0joined",
]


def sample():
    rows = [(i, SENTENCES[i % 5] + " " + SENTENCES[i * 3 % 5], ["en", "de", None, "und"][i % 4], None, None, "c", "c") for i in range(60)]
    return rows + [(900 + i, "hot pair " * 40, "en", "src0", None, None, None) for i in range(5)]


def test_equals_brute_force(spark):
    df = frame(spark, sample())
    for threshold, top in ((7, 2000), (3, 4)):
        assert got(phrases.collocations(df, threshold, top=top)) == brute(pairs(df), threshold, top=top)


def test_awkward_rows(spark):
    df = frame(spark).withColumnRenamed("rid", "part").withColumnRenamed("name", "phrase")
    assert got(phrases.collocations(df, 20)) == brute(pairs(df), 20)
    assert phrases.collocations(empty(spark)).count() == 0


@pytest.fixture
def small(monkeypatch):
    """Parts of a few bytes, chunks of a few words, and a bitmap that lets nearly everything through."""
    monkeypatch.setattr(phrases, "PIECE_BYTES", 7)
    monkeypatch.setattr(phrases, "CHUNK", 50)


def test_parts_and_chunks_cut_nothing(small):
    for text in ("one two three, four five six seven eight nine ten", "x" * 40 + " y z " + "w" * 30, "", "a.b", "...a  b\t\tc...", " "):
        found = Counter()
        for words, old in phrases.words_of(text):
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    gram = words[i : i + n]
                    if phrases._END not in gram and i + n > old:
                        found[tuple(w.decode() for w in gram)] += 1
        assert found == counted([("x", text)], 4)[0]["x"], text


def test_chunks_of_two_languages(small):
    import pyarrow as pa

    texts = ["red green blue. red green"] * 30
    batch = pa.RecordBatch.from_pydict({"lang": ["x", "y"] * 15, "text": texts})
    f = defaultdict(Counter)
    for chunk in phrases._chunks([batch], 4):
        grams, _ = chunk.grams(4)
        for n, (_, at) in enumerate(grams, 1):
            for a in at.tolist():
                f[chunk.lang][tuple(w.decode() for w in chunk.words[a : a + n])] += 1
    assert f == counted(list(zip(["x", "y"] * 15, texts)), 4)[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=80), max_size=6), st.integers(2, 9))
def test_merged_summaries_keep_every_frequent_key(parts, threshold):
    mass = sum(map(len, parts))
    whole = phrases.Summary(mass // threshold + 1, threshold)
    true = Counter()
    for part in parts:
        s = phrases.Summary(mass // threshold + 1, threshold)
        keys, n = np.unique(np.array(part, np.uint32), return_counts=True)
        s.add(keys, n)
        whole.merge(s)
        true.update(part)
    assert {k for k, c in true.items() if c >= threshold} <= set(whole.frequent().tolist())
    assert whole.error < threshold


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 200), max_size=600), st.integers(2, 12), st.integers(1, 40))
def test_one_summary_over_many_sums(keys, threshold, capacity):
    s = phrases.Summary(capacity, threshold)
    for at in range(0, len(keys), 17):
        k, n = np.unique(np.array(keys[at : at + 17], np.uint32), return_counts=True)
        s.add(k, n)
    kept = set(s.frequent().tolist())
    assert {k for k, c in Counter(keys).items() if c >= threshold} <= kept
    # Capacity over mass / threshold: it never has to grow.
    if capacity * threshold > len(keys):
        assert s.capacity == capacity and s.error * (s.capacity + 1) <= len(keys)


def test_small_summaries_lose_nothing(spark):
    """Capacity far under the number of n-grams: survivors are few, counts are exact."""
    rows = [("en", " ".join(f"w{i}x{j}" for j in range(50)) + ". " + SENTENCES[0]) for i in range(40)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    found, _ = phrases.survivors(df, mass=4 * 40 * 60, threshold=30, counters=8)
    assert found.agg({"n": "sum"}).first()[0] < 1000  # of some 8000 n-grams
    assert got(phrases.collocations(df, 30)) == brute(rows, 30)


def test_word_counts(spark):
    texts = [None, "", " ", "a", " a  b\tc\n", "ü ü\x0bü", "x" * 50, "\x1c\x85 q"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").repartition(3)
    n = {r.i: r.n_words for r in common.word_counts(df, "i").collect()}
    assert [n[i] for i in range(len(texts))] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
