import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pagelake.llm import packing

from .helpers import empty, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def padding(sizes, sequence):
    return sum(0 if n & (n - 1) == 0 else sequence - n for n in sizes)


def check(df, out, sequence):
    docs = {r.rid: r for r in packing.keyed(df).collect()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.rid].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(docs)
    for rid, parts in by_doc.items():
        ids, at = ids_of(docs[rid].text), 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_id == docs[rid].doc_id and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    sizes = []
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= sequence
        sizes.append(at)
    return sizes


def test_awkward_rows(spark):
    df = frame(spark)
    for sequence, grid in ((4096, 8), (256, 4)):
        sizes = check(df, packing.pack(df, PATH, sequence, grid).collect(), sequence)
        assert sequence == 256 or padding(sizes, sequence) <= 0.012 * sum(sizes)


def test_empty_table(spark):
    assert packing.pack(empty(spark), PATH).count() == 0


def test_words_give_the_ids_of_whole_texts(spark, monkeypatch):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["Ünï wörds, don't stop! \n\t " * 3000, "a\u00a0b\u2003c\u0301 d\u0301", "ΟΔΟΣ ΟΔΟΣ, 日本語 <|endoftext|> x\x1cy\x0bz", "İi e\u0301\n\u0301x 12ab3's", "AbC.,, ÀÉÎ!!\u0338 don't. 's's 'S x1** ***$ Straße) it's."]
    texts += ["İ( İ, İSTANBULİ. ûİ$ uƮɁİ, … GELDİ! e\u0301. É\u0301, ŉ. ǰ) ΐ* ﬁ. ß, İ̇.", "İİ..İ( a\u0307. A\u0307. ①. Ⅷ, ½! x²."]
    letters = "İıIiÉe\u0301\u0307ßŉǰﬁΣςσ.,(!$*a1 "
    rng = random.Random(6)
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(400)]
    monkeypatch.setattr(packing, "CACHE", 300)
    monkeypatch.setattr(packing, "PART", 70)
    for text, ids in zip(texts, packing.token_ids(texts, PATH)):
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 2], text[:50]
    known = packing._words[PATH]
    assert all(len(x) <= 1200 for x in (known.words, known.old_words, known.parts, known.old_parts))


def test_plan_covers_every_piece_with_little_padding():
    rng = random.Random(3)
    cases = [(1, 4095), (40, 900), (3000, 4095), (20000, 700), (5000, 60)]
    tables = [[rng.randint(1, top) if rng.random() < 0.97 else 4096 for _ in range(n)] for n, top in cases]
    tables += [[2100] * 999, [4090] * 10 + [3] * 7, [1], []]
    for lengths in tables:
        lengths = np.array(sorted(lengths, reverse=True), np.int64)
        made = packing.plan(Counter(lengths.tolist()))
        rank = np.arange(len(lengths))
        places = defaultdict(list)
        if len(rank):
            seq, slot = made.place(rank)
            line = seq < 0
            for q, k, n in zip(seq[~line], slot[~line], lengths[~line]):
                places[q].append((k, n))
            for n, parts in zip(lengths[line], made.parts(rank[line], lengths[line])):
                assert [p[0] for p in parts] == list(np.cumsum([0, *[p[1] for p in parts]])[:-1]) and sum(p[1] for p in parts) == n
                for _, ln, q, offset in parts:
                    places[q].append((offset, ln))
        fill = {q: sum(n for _, n in own) for q, own in places.items()}
        assert all(len({k for k, _ in own}) == len(own) for own in places.values())
        assert sum(fill.values()) == lengths.sum() and all(n <= 4096 for n in fill.values())
        last = fill.pop(made.last, 0)  # cut at powers of two by ``pack``
        most = (0.012 if sum(fill.values()) > 20 * len(lengths) * packing.MARK else 0.3) * sum(fill.values())
        assert padding(fill.values(), 4096) <= most, (len(lengths), padding(fill.values(), 4096), sum(fill.values()), last)


def test_checksums_between_marks():
    ids = np.arange(1000, dtype="<u4").tobytes()
    marks = packing.running_checksums(ids)
    assert len(marks) == 62
    for a in (0, 16, 480):
        for b in (16, 496, 992, 1000):
            if a < b:
                first = marks[a // 16 - 1] if a else 0
                both = zlib.crc32(ids) if b == 1000 else marks[b // 16 - 1]
                assert packing.checksum_between(first, both, 4 * (b - a)) == zlib.crc32(ids[4 * a : 4 * b])


def test_knapsack_against_enumeration():
    value, size = np.array([2.0, 3.1, 0.9]), np.array([3, 5, 2])
    best = max(2.0 * a + 3.1 * b + 0.9 * c for a in range(6) for b in range(4) for c in range(8) if 3 * a + 5 * b + 2 * c <= 14)
    got, count = packing.knapsack(value, size, 14)
    assert abs(got - best) < 1e-9 and count @ size <= 14 and abs(count @ value - got) < 1e-9


def test_most_pieces_lie_in_patterns():
    rng = np.random.default_rng(5)
    for n, mean in ((1500, 6.2), (12000, 6.4), (12000, 4.5)):
        lengths = np.sort(np.clip(np.exp(rng.normal(mean, 1.0, n)).astype(int) + 1, 1, 4095))[::-1]
        made = packing.plan(Counter(lengths.tolist()))
        seq, _ = made.place(np.arange(n))
        short = lengths < 4096 - packing.MAX_GAP
        assert (seq[short] >= 0).mean() >= 0.9, (n, mean, (seq[short] >= 0).mean())
        fill = np.bincount(seq[seq >= 0], weights=lengths[seq >= 0])
        assert fill.max() <= 4096 and (4096 - fill[fill > 0]).mean() <= packing.MAX_GAP


def test_fullest_against_enumeration():
    rng = random.Random(7)
    for _ in range(200):
        size = np.array(sorted(rng.sample(range(1, 25), rng.randrange(1, 6)), reverse=True))
        left = np.array([rng.randrange(0, 4) for _ in size])
        room = rng.randrange(0, 60)
        count = packing.fullest(size, left, room)
        sums = {0}
        for s, c in zip(size.tolist(), left.tolist()):
            sums = {a + k * s for a in sums for k in range(c + 1)}
        assert (count <= left).all() and count @ size == max(s for s in sums if s <= room)


def test_letter_runs_have_the_tokenizers_ids(monkeypatch):
    """Parts of plain letters go straight to the model; the whole tokenizer sees the others only."""
    import random

    import public_tokenizers

    from pagelake.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = packing.tokenizer(path)
    rnd = random.Random(3)
    letters = [chr(c) for c in range(0x10000) if packing.LETTERS.fullmatch(chr(c))]
    words = ["".join(rnd.choice(rnd.choice((letters, letters[:300]))) for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    words += ["İx", "été.", "don't", "Σς", "a1", "́a", "..", "Café,", "ª"]
    want = [whole.encode(w, add_special_tokens=False).ids + [packing.END_ID] for w in words]
    seen = []
    known = packing.Words(path)
    monkeypatch.setitem(packing._words, path, known)
    through = known._tokenised
    monkeypatch.setattr(known, "_tokenised", lambda parts: (seen.extend(parts), through(parts)))
    assert [x.tolist() for x in packing.token_ids(words, path)] == want
    assert seen and not [p for p in seen if packing.LETTERS.fullmatch(p.decode())]
