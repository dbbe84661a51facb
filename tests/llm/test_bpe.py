import hashlib

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelake.llm import bpe

from .helpers import empty, frame

PATH = P.path("byte_bpe_multi_50k.tiktoken")
CODER = bpe.coder(PATH, P.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODER.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aabeth  's\n\té日😀ſ1²_-", max_size=80) | st.text(max_size=40))
def test_same_ids_as_tiktoken(text):
    ids = CODER.encode(text)
    assert ids == TIKTOKEN.encode_ordinary(text)
    assert CODER.decode(ids) == text.encode()


def test_very_long_pre_tokens():
    for text in ("ab" * 40000, "a" * 70000, "thequickbrown" * 6000 + "日" * 9000, " " * 30000):
        ids = CODER.encode(text)
        assert ids == TIKTOKEN.encode_ordinary(text) and CODER.decode(ids) == text.encode()


def test_queue_is_empty_after_use():
    CODER.merge(b"straightforwardness" * 7)
    assert not any(CODER.words) and not any(CODER.buckets)


def test_cache_turns_over(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    c = bpe.Coder(PATH, P.PATTERN)
    text = "one two three four five one two six seven one" * 3
    assert c.encode(text) == TIKTOKEN.encode_ordinary(text) and len(c.cache) <= 3 >= len(c.cache.old)


def test_awkward_rows(spark):
    df = frame(spark)
    want = []
    for r in df.collect():
        ids = TIKTOKEN.encode_ordinary(r.text or "")
        joined = ",".join(map(str, ids)).encode()
        want.append((r.doc_id, len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(df, PATH, P.PATTERN).collect()), key=str) == sorted(want, key=str)
    both = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") and r.name in ("clash", None) for r in both)
    assert bpe.digests(empty(spark), PATH, P.PATTERN).count() == 0
