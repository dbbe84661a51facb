import zlib

import numpy as np
from pyspark.sql import functions as F

from pagelake.llm import langid

from .helpers import empty, frame

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_query(spark):
    rows = langid.op10(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert np.mean(held) > 0.95


def test_families_hold_alike_languages(spark):
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sorted(map(sorted, model.families)) == [["de", "en"], ["es", "fr"]]


def test_training_ignores_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spoiled = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = langid.train(docs), langid.train(spoiled)
    assert a.families == b.families and np.array_equal(a.family_svms, b.family_svms)


def test_pieces_count_as_a_whole(monkeypatch):
    text = "The quick brown fox ünd dér Hund. " * 50
    whole = langid.features([text])
    monkeypatch.setattr(langid, "PIECE_BYTES", 17)
    assert np.array_equal(whole, langid.features([text]))


def test_awkward_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    df = frame(spark)
    out = langid.identify(df, model)
    assert out.columns == [*[c for c in df.columns if c != "score"], "lang_pred", "score"]
    for r in out.collect():
        no_letter = r.text is None or not any(ch.isalpha() for ch in r.text)
        assert (r.lang_pred == "und") == no_letter and (r.score == 0) == no_letter
    assert langid.identify(empty(spark), model).count() == 0


def test_nothing_to_learn(spark):
    for df in (empty(spark), frame(spark).withColumn("lang", F.lit(None).cast("string"))):
        assert langid.train(df).families == []
        assert {r.lang_pred for r in langid.identify(df, langid.train(df)).collect()} <= {"und"}
    one = langid.train(frame(spark))
    assert one.families == [["en"]] and {r.lang_pred for r in langid.identify(frame(spark), one).collect()} == {"en", "und"}


def _planted():
    import random

    dice = random.Random(7)
    draw = lambda letters, n: "".join(dice.choice(letters) for _ in range(n))
    out = {f"letters {n}": draw("abcdefghijklmnopqrstuvwxyz    ", n) for n in (40, 200, 3000)}
    out |= {f"digits {n}": draw("0123456789 #%&", n) + " x" for n in (40, 200, 3000)}
    out |= {f"hex {n}": draw("0123456789abcdef", n) + " x" for n in (40, 200, 3000)}
    out["pl"] = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem."
    out["fi"] = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."
    out["ru"] = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью."
    out["zh"] = "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。"
    return out


def test_stage_rejects_gibberish_and_keeps_clean_held_out_documents(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(-1 - i, text, None, name, len(text)) for i, (name, text) in enumerate(_planted().items())]
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {r.doc_id for r in cp.identify_language(spark, both, "").select("doc_id").collect()}
    assert not [name for i, name in enumerate(_planted()) if -1 - i in kept]
    assert {r.doc_id for r in docs.where(langid.held_out()).collect()} <= kept


def test_stage_rejects_a_language_that_was_not_learned(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for gone in ("de", "es"):
        hidden = docs.withColumn("lang", F.when(F.col("lang") != gone, F.col("lang")))
        kept = {r.doc_id for r in cp.identify_language(spark, hidden, "").collect()}
        named = [(r.lang, r.doc_id in kept) for r in docs.collect()]
        assert np.mean([k for lang, k in named if lang == gone]) < 0.05
        assert all(k for lang, k in named if lang != gone)


def test_floor_does_not_depend_on_the_number_of_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, four = langid.train(docs.where("lang = 'en'")), langid.train(docs)
    for name, text in _planted().items():
        assert max(one.score([text])[0][1], four.score([text])[0][1]) < 0.2, name


def test_number_characters_are_no_letters(spark):
    df = spark.createDataFrame([(1, "²"), (2, "½ ¼"), (3, "Ⅷ"), (4, "½ a ½"), (5, "٣")], "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in langid.identify(df, langid.train(frame(spark))).collect()}
    assert found == {1: "und", 2: "und", 3: "und", 4: "en", 5: "und"}
