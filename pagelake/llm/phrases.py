"""Operator 13, phrase collocation mining with mergeable Misra-Gries summaries.

First pass: every n-gram of up to ``LONGEST`` words, with its language, has an
address: a hash partition and a 32-bit slot in it.  A task sums its own n-grams
by address; the sums of one hash partition are merged into one Misra-Gries
summary, whose capacity exceeds the partition's mass divided by the threshold.
A summary that has subtracted ``error`` in all knows that an address with a
true sum of f has a counter of f - error at least, so every n-gram that reaches
the threshold survives.  Two n-grams at one address only add to its counter.

Second pass: the n-grams at surviving addresses are counted exactly, by their
words, and those under the threshold go.  Cuts, scores and containment are
joins over the few n-grams that are left.

Scale: the number of hash partitions grows with the corpus, so a summary is
bounded whatever the input.  What is shuffled in the first pass is four bytes
and a count for each n-gram that a chunk of a task holds; repeats, a hot word
or passage among them, are summed before.  Survivors reach the second pass as a
bitmap of at most ``BITMAP_BITS`` bits; a corpus with more survivors than fit
lets more rare n-grams through to the exact count, and the result is the same.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagelake.llm.common import table, tidy, word_counts
from pagelake.llm.registry import query
from pagelake.operators.numbering import saved

LONGEST = 4
THRESHOLD = 30
TOP = 2000
SCALE = 2_000_000
CONTAINED_PERCENT = 80
NO_LANGUAGE = "und"

CHUNK = 1 << 20  # words whose n-grams are summed at once
PIECE_BYTES = 1 << 22  # of one text, split into words at once
COUNTERS = 1 << 19  # of a hash partition, before the slack
SLACK = 4  # capacity over mass / threshold: a summary subtracts at most a quarter of the threshold
LEAST_PARTS = 16
BITMAP_BITS = 1 << 27
BITS_PER_SURVIVOR = 64
SALTS = 64

WORD_SEPARATORS = b" \t"
PIECE_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(
    _UPPER + WORD_SEPARATORS + PIECE_SEPARATORS,
    _UPPER.lower() + b" " * len(WORD_SEPARATORS) + b"\n" * len(PIECE_SEPARATORS),
)
_END = b"\xff"  # the end of a piece; no byte of UTF-8

_U = np.uint64


# --------------------------------------------------------------------------
# Misra-Gries
# --------------------------------------------------------------------------


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    if not keys.size:
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)


class Summary:
    """Misra-Gries counters of one hash partition.

    ``error`` is what has been subtracted from any counter in all.  It stays
    under ``threshold``: a summary whose capacity turns out too small for its
    mass grows instead.
    """

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.error = max(1, capacity), threshold, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self._new: list[tuple[np.ndarray, np.ndarray]] = []
        self._waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Merge in exact sums (or the counters of another summary with no error)."""
        self._new.append((keys, counts.astype(np.int64)))
        self._waiting += keys.size
        if self._waiting > self.capacity:
            self._settle()

    def merge(self, other: "Summary") -> None:
        """Merge in another summary: errors add up."""
        other._settle()
        if self.error + other.error >= self.threshold:
            raise ValueError("summaries too small for their threshold")
        self.error += other.error
        self.add(other.keys, other.counts)

    def _settle(self) -> None:
        if not self._new:
            return
        keys = np.concatenate([self.keys, *(k for k, _ in self._new)])
        counts = np.concatenate([self.counts, *(c for _, c in self._new)])
        self._new, self._waiting = [], 0
        keys, counts = _summed(keys, counts)
        while keys.size > self.capacity:
            least = int(np.partition(counts, keys.size - self.capacity - 1)[keys.size - self.capacity - 1])
            if self.error + least >= self.threshold:
                self.capacity *= 2
                continue
            self.error += least
            stay = counts > least
            keys, counts = keys[stay], counts[stay] - least
        self.keys, self.counts = keys, counts

    def frequent(self) -> np.ndarray:
        """Keys whose true sum may reach the threshold: none that does is missing."""
        self._settle()
        return self.keys[self.counts + self.error >= self.threshold]


# --------------------------------------------------------------------------
# Words and n-grams of a chunk
# --------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words_of(text: str | None, longest: int = LONGEST):
    """``(words, n_old)``: the words of a text in parts, a piece's end as ``_END``.

    A part of a long text starts with up to ``longest - 1`` words of the part
    before it, ``n_old`` in number, so that no n-gram is cut.
    """
    raw = (text or "").encode().translate(_FOLD)
    at, old = 0, []
    while at < len(raw):
        to = at + PIECE_BYTES
        if to < len(raw):
            cut = max(raw.rfind(b" ", at, to), raw.rfind(b"\n", at, to))
            if cut < 0:  # one word of this length: up to its end
                ends = [e for e in (raw.find(b" ", to), raw.find(b"\n", to)) if e >= 0]
                cut = min(ends) if ends else len(raw) - 1
            to = cut + 1
        new = raw[at:to].replace(b"\n", b" \xff ").split()
        at = to
        if at >= len(raw):
            new.append(_END)
        words = old + new
        yield words, len(old)
        old = words[-(longest - 1) :] if longest > 1 else []
        if _END in old:
            old = old[len(old) - old[::-1].index(_END) :]


class Chunk:
    """Words of many texts of one language, with the n-grams they make."""

    def __init__(self, lang: str):
        self.lang, self.words, self.old = lang, [], []

    def add(self, words: list[bytes], n_old: int) -> None:
        if n_old:  # repeated words must not follow on themselves
            self.words.append(_END)
        self.old.append((len(self.words), n_old))
        self.words += words

    def grams(self, longest: int):
        """Per n: ``(hash, first word's position)`` of its n-grams, and the exact word numbers."""
        number = defaultdict(count().__next__)
        ids = np.fromiter(map(number.__getitem__, self.words), np.int64, len(self.words))
        codes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), _U, len(number))
        hashes = _mix(codes ^ _U(xxhash.xxh3_64_intdigest(self.lang.encode())))[ids]
        word = ids != number[_END] if _END in number else np.ones(ids.size, bool)
        fresh = np.ones(ids.size, bool)
        for at, n in self.old:
            fresh[at : at + n] = False
        out = []
        for n in range(1, longest + 1):
            if n == 1:
                h, whole = hashes, word
            else:
                h = _mix(h[:-1] * _U(0x9E3779B97F4A7C15) + hashes[n - 1 :])
                whole = whole[:-1] & word[n - 1 :]
            at = np.flatnonzero(whole & fresh[n - 1 :])
            out.append((h[at], at))
        return out, ids


def _chunks(batches, longest: int):
    """Chunks of the rows' texts, each of one language."""
    open_, size = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            lang = lang.as_py()
            for words, n_old in words_of(text.as_py(), longest):
                chunk = open_.get(lang)
                if chunk is None:
                    chunk = open_[lang] = Chunk(lang)
                chunk.add(words, n_old)
                size += len(words)
                if size >= CHUNK:
                    yield from open_.values()
                    open_, size = {}, 0
    yield from open_.values()


# --------------------------------------------------------------------------
# Two passes
# --------------------------------------------------------------------------

SUMS = "part long, slots binary, counts binary"
_SUMS_ARROW = pa.schema([("part", pa.int64()), ("slots", pa.binary()), ("counts", pa.binary())])
SURVIVORS = "part long, slots binary, n long"
_SURVIVORS_ARROW = pa.schema([("part", pa.int64()), ("slots", pa.binary()), ("n", pa.int64())])
BITS = "part long, bits binary"
_BITS_ARROW = pa.schema([("part", pa.int64()), ("bits", pa.binary())])
COUNTED = "lang string, phrase string, n long"
_COUNTED_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _sum_chunks(part_bits: int, longest: int):
    shift = _U(32 - part_bits)

    def run(batches):
        for chunk in _chunks(batches, longest):
            grams, _ = chunk.grams(longest)
            at, n = np.unique(np.concatenate([h for h, _ in grams]) >> shift, return_counts=True)
            parts = (at >> _U(32)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if at.size else []
            for a, b in zip(starts, [*starts[1:], at.size]):
                slots = (at[a:b] & _U(0xFFFFFFFF)).astype(np.uint32).tobytes()
                yield pa.RecordBatch.from_pydict(
                    {"part": [int(parts[a])], "slots": [slots], "counts": [n[a:b].astype(np.uint32).tobytes()]}, schema=_SUMS_ARROW
                )

    return tidy(run)


def _merge_sums(capacity: int, threshold: int):
    """Rows come sorted by hash partition; one summary is held at a time."""

    def told(part, summary):
        keys = summary.frequent()
        return pa.RecordBatch.from_pydict({"part": [part], "slots": [keys.tobytes()], "n": [keys.size]}, schema=_SURVIVORS_ARROW)

    def run(batches):
        now, summary = None, None
        for batch in batches:
            for part, slots, n in zip(batch.column("part"), batch.column("slots"), batch.column("counts")):
                part = part.as_py()
                if part != now:
                    if summary is not None:
                        yield told(now, summary)
                    now, summary = part, Summary(capacity, threshold)
                # Copies: a summary must not hold on to the batch.
                summary.add(np.frombuffer(slots.as_buffer(), np.uint32).copy(), np.frombuffer(n.as_buffer(), np.uint32))
        if summary is not None:
            yield told(now, summary)

    return tidy(run)


def _mark(slot_bits: int):
    shift = np.uint32(32 - slot_bits)

    def run(batches):
        for batch in batches:
            for part, slots in zip(batch.column("part"), batch.column("slots")):
                bits = np.zeros(1 << slot_bits, np.uint8)
                bits[np.frombuffer(slots.as_buffer(), np.uint32) >> shift] = 1
                packed = np.packbits(bits, bitorder="little").tobytes()
                yield pa.RecordBatch.from_pydict({"part": [part.as_py()], "bits": [packed]}, schema=_BITS_ARROW)

    return tidy(run)


def survivors(docs: DataFrame, mass: int, threshold: int = THRESHOLD, longest: int = LONGEST, counters: int = COUNTERS):
    """``(rows, part_bits)``: addresses of all n-grams that may reach the threshold.

    ``docs`` has ``lang`` (no nulls) and ``text``; ``mass`` is the number of
    n-grams or more.  Rows: ``(part, slots, n)``, one a hash partition.
    """
    need = max(LEAST_PARTS, -(-mass // (threshold * counters)))
    part_bits = min(32, (need - 1).bit_length())
    capacity = SLACK * -(-mass // (threshold << part_bits)) + 1
    sums = docs.select("lang", "text").mapInArrow(_sum_chunks(part_bits, longest), SUMS)
    merged = sums.repartition("part").sortWithinPartitions("part").mapInArrow(_merge_sums(capacity, threshold), SURVIVORS)
    return saved(merged, "phrase-survivors"), part_bits


def _bitmap(rows: DataFrame, part_bits: int) -> tuple[np.ndarray, int]:
    """Bitmap over the top bits of surviving addresses, at most ``BITMAP_BITS`` bits."""
    n = rows.agg(F.sum("n")).first()[0] or 0
    bits = min(BITMAP_BITS, 1 << max(10 + part_bits, (n * BITS_PER_SURVIVOR).bit_length()))
    slot_bits = min(32, max(3, bits.bit_length() - 1 - part_bits))
    marks = np.zeros(((1 << part_bits) << slot_bits) >> 3, np.uint8)
    width = (1 << slot_bits) >> 3
    for row in rows.mapInArrow(_mark(slot_bits), BITS).collect():
        marks[row.part * width : (row.part + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return marks, part_bits + slot_bits


def _count_marked(marks, address_bits: int, longest: int):
    shift = _U(64 - address_bits)

    def run(batches):
        bitmap = marks.value
        for chunk in _chunks(batches, longest):
            grams, ids = chunk.grams(longest)
            found: dict[bytes, int] = defaultdict(int)
            for n, (h, at) in enumerate(grams, 1):
                place = h >> shift
                hit = (bitmap[place >> _U(3)] >> (place & _U(7)).astype(np.uint8)) & np.uint8(1)
                hit = np.flatnonzero(hit)
                h, at = h[hit], at[hit]
                if not at.size:
                    continue
                _, first, group, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                same = np.ones(at.size, bool)
                for j in range(n):
                    same &= ids[at + j] == ids[at[first[group]] + j]
                if not same.all():  # n-grams of one hash: only the first is in the sums
                    times = np.bincount(group[same], minlength=times.size)
                    for a in at[~same].tolist():
                        found[b" ".join(chunk.words[a : a + n])] += 1
                for a, k in zip(at[first].tolist(), times.tolist()):
                    found[b" ".join(chunk.words[a : a + n])] += k
            for some in _slices(list(found.items()), 100_000):
                yield pa.RecordBatch.from_pydict(
                    {"lang": [chunk.lang] * len(some), "phrase": [p.decode() for p, _ in some], "n": [k for _, k in some]},
                    schema=_COUNTED_ARROW,
                )

    return tidy(run)


def _slices(items: list, size: int):
    for at in range(0, len(items), size):
        yield items[at : at + size]


def frequent(docs: DataFrame, words: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST) -> DataFrame:
    """``(lang, phrase, f)``: exact counts of all n-grams that reach the threshold.

    ``docs`` has ``lang`` (no nulls) and ``text``; ``words`` is ``(lang, n)``.
    """
    spark = docs.sparkSession
    mass = longest * int(words.agg(F.sum("n")).first()[0] or 0)
    rows, part_bits = survivors(docs, mass, threshold, longest)
    marks, address_bits = _bitmap(rows, part_bits)
    counted = docs.select("lang", "text").mapInArrow(_count_marked(spark.sparkContext.broadcast(marks), address_bits, longest), COUNTED)
    f = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= threshold)
    return saved(f, "phrase-counts")


# --------------------------------------------------------------------------
# Scores
# --------------------------------------------------------------------------


def _exact(column: str):
    return F.col(column).cast("decimal(20,0)")


def scored(counts: DataFrame) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` of all phrases of two words or more, by their lowest-scoring cut."""
    words = F.split("phrase", " ", -1)
    phrases = counts.withColumn("words", words).withColumn("m", F.size("words")).where("m >= 2")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "words", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("tail"),
    )
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    both = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    both = both.select("*", _exact("a").alias("da"), _exact("l").alias("dl"), _exact("r").alias("dr"))
    score = F.expr(f"cast(({SCALE} * da) div (dl + dr) as long)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("best")
    return both.groupBy("lang", "phrase").agg(best).select("lang", "phrase", "best.a", "best.l", "best.r", "best.score")


def contained(counts: DataFrame, percent: int = CONTAINED_PERCENT) -> DataFrame:
    """``(lang, phrase)`` of the phrases that lie in a longer one with ``percent`` of their count or more."""
    phrases = counts.withColumn("words", F.split("phrase", " ", -1)).withColumn("m", F.size("words")).where("m >= 3")
    sizes = phrases.select("lang", "f", "words", "m", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("size"))
    parts = sizes.select("lang", "f", "words", "size", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1)).alias("at"))
    inner = parts.select("lang", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("phrase"), F.col("f").alias("longer"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return most.join(counts, ["lang", "phrase"]).where(100 * _exact("longer") >= percent * _exact("f")).select("lang", "phrase")


def collocations(
    docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, top: int = TOP, percent: int = CONTAINED_PERCENT,
    lang: str = "lang", text: str = "text",
) -> DataFrame:
    """The ``top`` phrases of each language: ``(lang, rank, phrase, a, l, r, n, score)``.

    A-Z are lower-cased; phrases lie within pieces between ``.,;:!?`` and line
    ends.  A null text is empty; a null language is ``und``, and so is that
    word itself.  Repeated rows and ids count as often as they occur; other
    columns, whatever their names, are not read.  An empty table, or one with
    no phrase that is frequent enough, gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(f"`{text}`").alias("text"))
    counted = word_counts(rows, "lang", separators=WORD_SEPARATORS + PIECE_SEPARATORS)
    words = saved(counted.groupBy("lang").agg(F.sum("n_words").alias("n")), "phrase-words")
    counts = frequent(rows, words, threshold, longest)
    left = scored(counts).join(contained(counts, percent), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # A language is first cut down in shares, so that no task ranks all its phrases.
    share = W.partitionBy("lang", "share").orderBy(*order)
    few = left.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(s, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
i AS (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS pos FROM w CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS m) t WHERE len(ws) >= m),
f AS (SELECT lang, array_to_string(list_slice(ws, pos, pos + m - 1), ' ') AS phrase, m, count(*) AS f FROM i GROUP BY 1, 2, 3),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS ws, m, f AS a FROM f WHERE m >= 2 AND f >= 30),
k AS (SELECT lang, phrase, a, m, k, array_to_string(list_slice(ws, 1, k), ' ') AS head, array_to_string(list_slice(ws, k + 1, m), ' ') AS tail
  FROM c CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) t WHERE k < m),
s AS (SELECT k.lang, k.phrase, k.a, k.k, h.f AS l, t.f AS r, CAST((CAST(2000000 AS HUGEINT) * k.a) // (h.f + t.f) AS BIGINT) AS score
  FROM k JOIN f h ON h.lang = k.lang AND h.phrase = k.head JOIN f t ON t.lang = k.lang AND t.phrase = k.tail),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s) q WHERE cut = 1),
e AS (SELECT lang, a, ws, m, size, unnest(range(1, m - size + 2)) AS pos FROM c CROSS JOIN (SELECT unnest([2, 3]) AS size) t WHERE size < m),
x AS (SELECT lang, array_to_string(list_slice(ws, pos, pos + size - 1), ' ') AS phrase, max(a) AS longer FROM e GROUP BY 1, 2),
z AS (SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase WHERE x.longer IS NULL OR CAST(100 AS HUGEINT) * x.longer < CAST(80 AS HUGEINT) * b.a)
SELECT z.lang, CAST(z.rank AS BIGINT) AS rank, z.phrase, z.a, z.l, z.r, CAST(n.n AS BIGINT) AS n, z.score
FROM z JOIN n ON n.lang = z.lang WHERE z.rank <= 2000"""


@query("op13_misra_gries_phrases", SQL)
def op13(spark, sf_dir):
    """The first 2000 phrases of each language over all documents."""
    return collocations(table(spark, sf_dir, "documents"))
