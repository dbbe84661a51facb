from collections import defaultdict

import corpus_pipeline as cp
from pagelake.llm import langid
from pagelake.operators.numbering import saved

from . import test_naming, test_ordermin, test_packing, test_substrings
from .helpers import empty, frame

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage_rows(spark, docs):
    """Rows after each stage but the last, and the last stage's rows."""
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(saved(stage(spark, out[-1], ""), f"test-{name}"))
    return out


def check(spark, docs):
    first, known, exact, near, cut, packed = stage_rows(spark, docs)
    key = lambda rows: sorted(((r[0], r[1]) for r in rows), key=str)
    # Language: what the classifier rejects goes.
    found = langid.identify(first, langid.train(first)).collect()
    want = [r for r in found if r.lang_pred != "und" and r.score >= cp.MIN_LANGUAGE_SCORE]
    assert key(known.select("doc_id", "text").collect()) == key([(r.doc_id, r.text) for r in want])
    # Exact copies.
    groups = defaultdict(list)
    for r in known.collect():
        groups[r.text.translate(test_naming.FOLD)].append(r)
    best = [max(g, key=lambda r: (r.doc_id is not None, r.doc_id or 0)) for g in groups.values()]
    assert sorted(r.doc_id or -1 for r in exact.collect()) == sorted(r.doc_id or -1 for r in best)
    # Near copies.
    rows = [tuple(r) for r in test_ordermin.om.keyed(exact).collect()]
    classes = test_ordermin.brute(rows)
    keep = [r for r in rows if classes[r[0]][3]]
    assert key(near.select("doc_id", "text").collect()) == key([(r[1], r[2]) for r in keep])
    # Repeated passages.
    rows = [tuple(r) for r in test_ordermin.om.keyed(near).collect()]
    texts = {r[0]: r[2] for r in rows}
    want = [(d, kept.decode() if gone else texts[rid]) for rid, d, _, gone, kept, _ in test_substrings.brute(rows, 20)]
    assert key(cut.select("doc_id", "text").collect()) == key(want)
    for stage in (known, exact, near, cut):
        assert stage.columns == docs.columns
    # Packing: every id of every document once.
    from pagelake.llm import packing

    full = packing.pack(cut, cp.public_tokenizers.path("word_bpe_49k.json")).collect()
    sizes = test_packing.check(cut, full, 4096)
    assert sorted((r.doc_id or -1, r.start, r.length, r.ids_crc32) for r in packed.collect()) == sorted((r.doc_id or -1, r.start, r.length, r.ids_crc32) for r in full)
    assert test_packing.padding(sizes, 4096) <= 0.02 * sum(sizes)


def test_given_documents(spark):
    check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_run_is_the_stages(spark):
    sf = "/root/testdata/sf0.001"
    want = stage_rows(spark, spark.read.parquet(f"{sf}/documents.parquet"))[-1]
    assert sorted(map(tuple, cp.run(spark, sf).collect())) == sorted(map(tuple, want.collect()))


def test_awkward_rows(spark):
    data = [(r[0], (r[1] or "")[:3000] if r[1] else r[1], r[2], r[3], r[4], r[5], r[6]) for r in frame(spark).collect()]
    check(spark, frame(spark, data))


def test_empty_table(spark):
    assert stage_rows(spark, empty(spark))[-1].count() == 0
