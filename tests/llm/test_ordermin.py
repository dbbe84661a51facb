import random
from collections import Counter

import numpy as np
import pytest

from pagelake.llm import ordermin as om

from .helpers import empty, frame


def codes(words):
    return om.hashes([w.encode() for w in words])


def lcs(a, b):
    """Length of the longest common subsequence, a whole row at a time."""
    ids = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    a, b = np.array([ids[x] for x in a]), np.array([ids[x] for x in b])
    row = np.zeros(len(b) + 1, int)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return int(row[-1])


def grams(w, k=5):
    return [tuple(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)] if w else []


def exact(a, b):
    """Share of k-mers in common order by full dynamic programming (0 if even any order gives too few)."""
    ka, kb = grams(a), grams(b)
    if not ka or not kb:
        return 0.0
    most = sum((Counter(ka) & Counter(kb)).values())
    if most / (len(ka) + len(kb) - most) < 0.8 - 1e-12:
        return 0.0
    c = lcs(ka, kb)
    return c / (len(ka) + len(kb) - c)


def edited(rng, words, rate):
    out = []
    for w in words:
        r = rng.random()
        if r < rate:
            out.append(f"x{rng.randint(0, 99)}")
        elif r < 1.5 * rate:
            continue
        else:
            out.append(w)
            if r > 1 - rate / 2:
                out.append(f"y{rng.randint(0, 99)}")
    return out


def test_similarity_decides_as_the_full_alignment():
    rng = random.Random(2)
    for _ in range(400):
        base = [f"w{rng.randint(0, rng.choice([3, 300]))}" for _ in range(rng.randint(1, 120))]
        other = edited(rng, base, rng.choice([0, 0.01, 0.03, 0.1]))
        want, got = exact(base, other), om.similarity(codes(base), codes(other))
        assert (got >= 0.8 - 1e-9) == (want >= 0.8 - 1e-12) and got <= want + 1e-9


def test_order_counts():
    a = [f"w{i}" for i in range(200)]
    assert om.similarity(codes(a), codes(a[100:] + a[:100])) == 0.0


def test_occurrence_labels():
    values = np.array([5, 7, 5, 5, 5], np.uint64)
    doc = np.array([0, 0, 0, 1, 1])
    out = om.labelled(values, doc)
    assert out[0] == out[3] and out[2] == out[4] and len(set(out[:3])) == 3


def brute(rows):
    """Classes by comparing all pairs."""
    words = [om.words_of(r[2]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if not words[i] or not words[j] or find(i) == find(j):
                continue
            if words[i] == words[j] or exact(words[i], words[j]) >= 0.8 - 1e-12:
                parent[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    out = {}
    for members in groups.values():
        first = min(members, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
        for r in members:
            out[r[0]] = (r[1], first[1], len(members), r[0] == first[0])
    return out


def check(spark, df):
    rows = [tuple(r) for r in om.keyed(df).collect()]
    classes, links = om.near_duplicates(df)
    assert {r.rid: (r.doc_id, r.class_id, r.class_size, r.kept) for r in classes.collect()} == brute(rows)
    assert links.where("similarity < 0.8 OR a >= b").isEmpty()
    kept = om.survivors(df)
    assert kept.columns == df.columns and kept.count() == sum(v[3] for v in brute(rows).values())


def doc(i, text):
    return (i, text, None, None, None, None, None)


def test_awkward_rows(spark):
    data = [r for r in __import__("tests.llm.helpers", fromlist=["rows"]).rows() if len(r[1] or "") < 10000]
    long = " ".join(f"word{i % 977} of{i % 53}" for i in range(3000))
    check(spark, frame(spark, data + [doc(80, long), doc(81, long + " tail"), doc(82, long.upper()), doc(82, long)]))


def test_empty_table(spark):
    classes, links = om.near_duplicates(empty(spark))
    assert classes.count() == 0 and links.count() == 0 and om.survivors(empty(spark)).count() == 0


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(om, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    sets = [[np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype("<u4") for _ in range(k)] for k in (9, 5)]
    want = [[len(np.intersect1d(a, b)) for b in sets[1]] for a in sets[0]]
    assert om.shared_counts(*sets).tolist() == want


def test_groups_of_near_copies_and_a_shared_passage(spark, monkeypatch):
    monkeypatch.setattr(om, "BLOCK_KMERS", 600)  # many blocks a bucket
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 3000)}"
    passage = [word() for _ in range(60)]
    data = []
    for _ in range(4):
        base = [word() for _ in range(rng.randint(30, 200))]
        data += [" ".join(edited(rng, base, rng.choice([0.0, 0.004, 0.012]))) for _ in range(25)]
    data += [" ".join([word() for _ in range(rng.randint(5, 60))] + passage + [word() for _ in range(rng.randint(5, 60))]) for _ in range(60)]
    check(spark, frame(spark, [doc(i, t) for i, t in enumerate(data)]))


def test_each_component_takes_one_pair(spark, monkeypatch):
    import zstandard

    monkeypatch.setattr(om, "BLOCK_DOCS", 30)  # several blocks
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 3000)}" for _ in range(150)]
    docs = [edited(rng, base, 0.004) for _ in range(100)] + [[f"v{rng.randint(0, 3000)}" for _ in range(150)]]
    texts = [(i, bytearray(zstandard.compress(" ".join(w).encode()))) for i, w in enumerate(docs)]
    inside = spark.createDataFrame([(0, 1, i, len(grams(w)), i) for i, w in enumerate(docs)], "t int, key long, node long, n long, label long")
    signatures = om.signed(inside, spark.createDataFrame(texts, "rid long, packed binary"), 5)
    counts = [Counter(grams(w)) for w in docs]
    alike = set()
    for b in range(len(docs)):
        for a in range(b):
            most = (counts[a] & counts[b]).total()
            if most / (counts[a].total() + counts[b].total() - most) >= 0.8:
                alike.add((a, b))
    assert len(alike) > 2000
    got = [tuple(r) for r in om.across_components(inside, signatures, None, 0.8).collect()]
    assert {x[0] for x in got} == {v for p in alike for v in p} and len(got) <= 100  # before: every pair
    first = {x[1:] for x in got}
    assert first <= alike
    refused = spark.createDataFrame(sorted(first), "a long, b long")
    again = [tuple(r)[1:] for r in om.across_components(inside, signatures, refused, 0.8, 1 << 40).collect()]
    assert set(again) == alike - first


def test_hub_of_another_size(spark):
    base = [f"w{i}" for i in range(40)]
    longer = base + [f"v{i}" for i in range(25)]
    data = [" ".join(base), " ".join([*longer, "end"]), " ".join([*longer, "tail"])]
    check(spark, frame(spark, [doc(i, t) for i, t in enumerate(data)]))


def test_texts_are_found_without_a_shuffle(spark, monkeypatch):
    plans = {}

    def saved(df, name, save=om.saved):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return save(df, name)

    monkeypatch.setattr(om, "saved", saved)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if the row keys were many
    try:
        df = frame(spark, [doc(i, f"some words of the text {'twice' if i < 2 else i} " * 9 + str(i)) for i in range(20)])
        check(spark, df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "MapInArrow" in plans["texts"] and "BroadcastHashJoin" in plans["texts"]
    assert "SortMergeJoin" not in plans["texts"] and "ShuffledHashJoin" not in plans["texts"]


@pytest.mark.parametrize("bitmaps", [8192, 0])
def test_chosen_rows(spark, monkeypatch, bitmaps):
    monkeypatch.setattr(om, "BITMAPS", bitmaps)
    rng = random.Random(4)
    starts = [0, 1 << 33, (1 << 33) + 32760, 5 << 33, (1 << 33) * 70000]
    all_rids = [s + i for s in starts for i in range(3 * 32768 if s == 5 << 33 else 20)]
    some = {0, 1, 5 << 33, (5 << 33) + 32767, (5 << 33) + 32768, (5 << 33) + 32769, *rng.sample(all_rids, 5000)}
    rows = spark.createDataFrame([(i, f"t{i}") for i in all_rids], "rid long, text string").repartition(5)
    rids = spark.createDataFrame([(i,) for i in [*some, 0, 7, 7, 1 << 34]], "rid long")
    got = om.chosen(rows, rids)
    assert got.columns == ["rid", "text"]
    assert sorted(tuple(r) for r in got.collect()) == [(i, f"t{i}") for i in sorted(some | {7})]


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 400), (400, 450)]
    got = {r.v: r.label for r in om.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, 400: 400, 450: 400, 500: 400}
