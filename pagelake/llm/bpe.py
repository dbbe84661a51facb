"""Operator 2, byte-level BPE encoding and decoding with a rank queue.

A pre-token's bytes are a linked list.  Each mergeable neighbour pair waits in
the bucket of its merge rank; a two-level bitmap has a bit for each bucket in
use and one for each word of such bits, so the lowest rank is found by two
find-first-set steps.  A bucket yields its leftmost position.  A merge changes
the two pairs around it, whose old entries turn stale and are skipped when
drawn.  The work is n log n in a pre-token's length, so a pre-token of
megabytes is no special case.

Documents are independent: one pass, no shuffle.  Pre-tokens met before by the
same Python worker are looked up in a cache of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import table
from pagelake.llm.registry import query

CACHE = 400_000  # pre-tokens of a generation of a worker's cache
CACHE_CHARS = 64  # longer pre-tokens are not kept

_coders: dict = {}


class Coder:
    """Encoder and decoder for one rank file and pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.longest = max(map(len, self.ranks))
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        # The rank queue: a heap of positions a rank, a bit for each rank in use
        # in words of 256 (``merge`` keeps a summary bit for each such word).
        self.buckets: list[list[int] | None] = [None] * size
        self.words = [0] * (size // 256 + 1)
        self.decimal = [str(i) for i in range(size)]
        self.split = regex.compile(pattern).findall
        self.cache = _Cache(self)

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if raw in ranks:
            return [ranks[raw]]
        n = len(raw)
        if n < 2:
            return [ranks[raw]] if n else []
        get, longest = ranks.get, self.longest
        buckets, words = self.buckets, self.words  # all empty between calls
        end = list(range(1, n + 1))  # end of the part that starts here; 0: no part does
        before = list(range(-1, n))  # start of the part before
        summary = 0

        for i in range(n - 1):
            rank = get(raw[i : i + 2])
            if rank is not None:
                bucket = buckets[rank]
                if bucket:
                    bucket.append(i)  # ascending, so a heap
                else:
                    buckets[rank] = [i]
                    w = rank >> 8
                    words[w] |= 1 << (rank & 255)
                    summary |= 1 << w

        while summary:
            w = (summary & -summary).bit_length() - 1
            bits = words[w]
            rank = w << 8 | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                buckets[rank] = None
                bits &= bits - 1
                words[w] = bits
                if not bits:
                    summary &= summary - 1
            mid = end[i]
            if not mid or mid >= n:
                continue  # stale: the part is gone or has no neighbour
            stop = end[mid]
            if get(raw[i:stop]) != rank:
                continue  # stale: the pair has changed
            end[i] = stop
            end[mid] = 0
            left = before[i]
            if left >= 0 and stop - left <= longest:
                rank = get(raw[left:stop])
                if rank is not None:
                    bucket = buckets[rank]
                    if bucket:
                        heappush(bucket, left)
                    else:
                        buckets[rank] = [left]
                        w = rank >> 8
                        words[w] |= 1 << (rank & 255)
                        summary |= 1 << w
            if stop < n:
                before[stop] = i
                last = end[stop]
                if last - i <= longest:
                    rank = get(raw[i:last])
                    if rank is not None:
                        bucket = buckets[rank]
                        if bucket:
                            heappush(bucket, i)
                        else:
                            buckets[rank] = [i]
                            w = rank >> 8
                            words[w] |= 1 << (rank & 255)
                            summary |= 1 << w

        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.cache.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Cache(dict):
    """Ids of pre-tokens met, in two generations: when the young one is full it
    becomes the old one, so pre-tokens in use stay and memory is bounded."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder = coder
        self.old: dict = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = tuple(self.coder.merge(piece.encode()))
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def coder(path: str, pattern: str) -> Coder:
    """The coder of a rank file, read once by each worker."""
    key = (path, pattern)
    if key not in _coders:
        _coders[key] = Coder(path, pattern)
    return _coders[key]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int); a null text has the ids of an empty one.

    An ``ids`` column of ``docs`` is replaced, all others pass through.
    """
    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        code = coder(path, pattern).encode
        return pd.Series([code(t or "") for t in texts])

    return docs.withColumn("ids", ids(F.col(f"`{text}`")))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded`` (binary): the bytes that ``ids`` stand for; null ids are none."""
    @F.pandas_udf("binary")
    def raw(lists: pd.Series) -> pd.Series:
        back = coder(path, pattern).decode
        return pd.Series([back([] if x is None else [int(i) for i in x]) for x in lists])

    return docs.withColumn("decoded", raw(F.col(f"`{ids}`")))


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encode and decode in one pass.

    The ids of a document never leave its task.  Null and repeated ids pass
    through, one row each.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        c = coder(path, pattern)
        for batch in batches:
            n, named, back = [], [], []
            for text in batch.column("text"):
                ids = c.encode(text.as_py() or "")
                n.append(len(ids))
                named.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(named, pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op2_rank_queue_bpe")
def op2(spark, sf_dir):
    """Ids and decoded bytes of every document, as digests."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
