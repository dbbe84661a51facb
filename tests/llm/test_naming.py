from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from pagelake.llm import naming

from .helpers import empty, frame

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(FOLD)].append(r[0])
    out = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        kept = [i == keep for i in ids]
        first = kept.index(True)
        out += [(i, keep, len(ids), n == first) for n, i in enumerate(ids)]
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()], key=str)


def check(spark, data, block):
    df = frame(spark, data)
    assert got(naming.dedup(df, block)) == brute([tuple(r) for r in df.collect()])
    assert naming.survivors(df, block).columns == df.columns
    assert naming.survivors(df, block).count() == sum(r[3] for r in brute([tuple(r) for r in df.collect()]))


def test_awkward_rows(spark):
    for block in (7, 4096):
        check(spark, None, block)


def test_empty_table(spark):
    assert naming.dedup(empty(spark)).count() == 0
    assert naming.survivors(empty(spark)).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aAb", max_size=9), max_size=40))
def test_small_alphabet(spark, texts):
    check(spark, [(i, t, None, None, None, None, None) for i, t in enumerate(texts)], 2)


def test_many_copies_over_partitions(spark):
    texts = ["copy " * 50] * 400 + [f"copy {i // 2} " * 40 for i in range(200)]
    check(spark, [(i * 7 % 1009, t, None, None, None, None, None) for i, t in enumerate(texts)], 16)
