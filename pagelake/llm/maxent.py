"""Operator 4, language-model scoring with a hashed maximum-entropy model.

The model factors a token's probability by class:

    P(w | history) = P(class(w) | history) * P(w | class(w), class before)

Both factors are maximum-entropy models.  The class factor has a bias and
hashed features of the word before (n-gram), of the word before that (skip) and
of both together.  The word factor, for the ``FREQUENT`` words, has a bias and
hashed (class before, word) features.  Frequent words are put in classes by
what comes before them; all other words share classes by their ending, within
which each has its smoothed corpus share, and so has one unseen word a class.
The probabilities of all these outcomes add up to one.

Training is by distributed gradient updates: the events of the whole training
corpus are counted into a table (its size is bounded by the feature buckets,
not by the corpus), and each update sums the partitions' gradients, observed
minus expected feature counts, by feature block in Spark.  Scoring goes through
the texts in sparse numpy batches: an index per token into the tables of log
probabilities.  Counts of words outside a bounded broadcast list come by a join.

Scale: what the corpus yields are its word counts (a shuffle that grows with
it) and bounded event tables; the driver holds the word list and the weights.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import keyed, table
from pagelake.llm.registry import query
from pagelake.operators.numbering import saved

FREQUENT = 4096  # words with probabilities of their own, the end token among them
KNOWN = 200_000  # words whose counts are broadcast (a bound on the list, not on what is counted)
GROUPS = 32  # classes of frequent words
ENDINGS = 64  # classes of other words, by ending
NEAR, SKIP = 256, 64  # buckets of the word before, and of the one before that
PAIRS = 4096  # hashed features of both
WORDS = 1 << 17  # hashed (class before, word) features
UPDATES = 12
RATE, DECAY = 0.35, 2.0
END = b""  # no word is empty
SMOOTH = 0.5
STEPS = 32  # steps of a doubling of the count
FLUSH = 300_000  # distinct words a task counts before it passes them on

_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())
_MARKS = b".,;:!?\"'()[]{}*#$%&-|"
_LOG10 = np.log(10)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def ending(word: bytes, of: int = ENDINGS) -> int:
    """Class of a word by its last two bytes without punctuation."""
    return zlib.crc32((word.rstrip(_MARKS) or word)[-2:]) % of


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, mod 5, is 1; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


class _Index(dict):
    """Place of a word in a list; other words: -1 - class by ending (not kept)."""

    def __missing__(self, word: bytes) -> int:
        return -1 - ending(word)


def _places(index: _Index, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(index.__getitem__, words), np.int64, len(words))


def count_words(rows: DataFrame) -> DataFrame:
    """``(word, c)`` of all rows' tokens, the end token included."""

    def run(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for text in batch.column("text"):
                held.update(words_of(text.as_py()))
                held[END] += 1
                if len(held) >= FLUSH:
                    yield out()
                    held.clear()
        if held:
            yield out()

    counted = rows.select("text").mapInArrow(run, "word binary, c long")
    return saved(counted.groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


@dataclass
class Vocabulary:
    """Bounded word list and corpus totals."""

    words: list[bytes]  # by count, the end token first
    counts: np.ndarray
    tokens: int  # N
    distinct: int  # V
    mass: np.ndarray  # smoothed count of each ending class, its unseen word included
    frequent: int  # so many have probabilities of their own


def vocabulary(counts: DataFrame, frequent: int = FREQUENT, known: int = KNOWN) -> Vocabulary:
    """At most ``known`` most frequent words and the totals of a ``(word, c)`` table."""
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    # Whole steps of the count from the top, as many as fit: what reaches the
    # driver is bounded by the steps and by ``known``, not by tasks times ``known``.
    step = F.floor(F.log2("c") * STEPS)
    words = counts.where(F.length("word") > 0)
    room, least = known - 1, None
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.step):
        if r.n > room:
            break
        room, least = room - r.n, r.step
    top = [] if least is None else words.where(step >= least).collect()
    top.sort(key=lambda r: (-r.c, bytes(r.word)))
    end = counts.where(F.length("word") == 0).collect()
    words = [END] + [bytes(r.word) for r in top]
    listed = np.array([end[0].c if end else 0] + [r.c for r in top], np.int64)
    own = set(words[:frequent])
    shared = counts.sparkSession.sparkContext.broadcast(own)

    def run(batches):
        mass = np.zeros(ENDINGS)
        for batch in batches:
            for word, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
                if word not in shared.value:
                    mass[ending(word)] += c + SMOOTH
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ENDINGS)), pa.array(mass)], names=["k", "m"])

    found = counts.mapInArrow(run, "k long, m double").groupBy("k").agg(F.sum("m").alias("m")).collect()
    mass = np.full(ENDINGS, SMOOTH)
    for r in found:
        mass[r.k] += r.m
    return Vocabulary(words, listed, int(total.n or 0), int(total.v or 0), mass, min(frequent, len(words)))


def _batches_of_places(batches, index: _Index, before: int):
    """Token places of a batch: (places with ``before`` start marks a document, documents, words)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            words = [words_of(t.as_py()) for t in part.column("text")]
            sizes = np.array([len(w) + 1 + before for w in words])
            flat = np.full(sizes.sum(), START)
            stop = np.cumsum(sizes)
            for w, end in zip(words, stop):
                flat[end - 1] = 0  # the end token
                if w:
                    flat[end - 1 - len(w) : end - 1] = _places(index, w)
            yield part, flat, np.repeat(np.arange(len(words)), sizes), words


START = 1 << 40  # before the first word


@dataclass
class Buckets:
    """Feature buckets and classes of places: frequent words, ending classes, start."""

    frequent: int
    near: np.ndarray
    skip: np.ndarray
    group: np.ndarray

    def code(self, places: np.ndarray) -> np.ndarray:
        """Row in the tables: a frequent word, else its ending class, else the start."""
        return np.where(places == START, self.frequent + ENDINGS, np.where(places < 0, self.frequent - 1 - places, places))


def buckets(frequent: int, group: np.ndarray | None = None) -> Buckets:
    """The most frequent words have a bucket each; the others share some by hash or ending."""
    size = frequent + ENDINGS + 1

    def spread(limit):
        own = limit - ENDINGS - 1 if limit > ENDINGS + 1 else limit // 2
        rest = limit - 1 - own
        out = np.array([i if i < own else own + zlib.crc32(str(i).encode()) % rest for i in range(size)])
        out[frequent : frequent + ENDINGS] = own + np.arange(ENDINGS) % rest
        out[-1] = limit - 1
        return out

    return Buckets(frequent, spread(NEAR), spread(SKIP), np.zeros(size, int) if group is None else group)


def _summed(rows: DataFrame, run, label: str) -> DataFrame:
    return saved(rows.select("text").mapInArrow(run, "kind int, k long, c long").groupBy("kind", "k").agg(F.sum("c").alias("c")), label)


class _Tally:
    """Sums of event counts by code, passed on when they grow large."""

    def __init__(self, kind: int):
        self.kind, self.keys, self.counts, self.held = kind, [], [], 0

    def add(self, codes: np.ndarray) -> None:
        k, c = np.unique(codes, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.held += len(k)

    def merge(self):
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.keys, self.counts, self.held = [keys], [np.bincount(at, np.concatenate(self.counts)).astype(np.int64)], len(keys)

    def rows(self):
        if not self.keys:
            return
        self.merge()
        n = len(self.keys[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, self.kind, np.int32)), pa.array(self.keys[0].astype(np.int64)), pa.array(self.counts[0])], names=["kind", "k", "c"]
        )


MERGE = 2_000_000


def word_groups(rows: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """Class of each frequent word: k-means of what stands before it.

    The end token has a class of its own (0).  The counts are bounded by
    frequent words times buckets; the start is the most frequent words of the
    corpus, so the result is the same everywhere.
    """
    n = vocab.frequent
    b = buckets(n)
    shared = rows.sparkSession.sparkContext.broadcast((_list_index(vocab.words[:n]), b))

    def run(batches):
        index, bk = shared.value
        tally = _Tally(0)
        for _, flat, _, _ in _batches_of_places(batches, index, 1):
            own = np.flatnonzero((flat >= 0) & (flat < n))
            own = own[own > 0]
            tally.add(flat[own] * NEAR + bk.near[bk.code(flat[own - 1])])
            if tally.held > MERGE:
                tally.merge()
        yield from tally.rows()

    seen = _summed(rows, run, "before-words").select("k", "c").toPandas()
    m = np.zeros((n, NEAR))
    m.ravel()[seen["k"].to_numpy()] = seen["c"].to_numpy()
    m = np.sqrt(m / np.maximum(m.sum(axis=1, keepdims=True), 1))
    groups = min(GROUPS - 1, max(1, n - 1))
    centre = m[1 : groups + 1].copy() if n > 1 else np.zeros((1, NEAR))
    label = np.zeros(n, int)
    for _ in range(15):
        near = m[1:] @ centre.T
        label = near.argmax(axis=1) if len(near) else label[1:]
        for g in range(len(centre)):
            mine = m[1:][label == g]
            if len(mine):
                c = mine.mean(axis=0)
                centre[g] = c / max(np.linalg.norm(c), 1e-12)
    return np.concatenate([[0], label + 1]).astype(int) if n > 1 else np.zeros(n, int)


def _list_index(words: list[bytes]) -> _Index:
    return _Index((w, i) for i, w in enumerate(words))


@dataclass
class Model:
    vocab: Vocabulary
    buckets: Buckets
    classes: int
    near: np.ndarray
    skip: np.ndarray
    pair: np.ndarray
    bias: np.ndarray
    word: np.ndarray
    own: np.ndarray

    def pair_feature(self, history: np.ndarray) -> np.ndarray:
        return ((history.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)).astype(np.int64) % PAIRS

    def word_feature(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        key = (before.astype(np.uint64) << np.uint64(20)) + word.astype(np.uint64) + np.uint64(1)
        return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 17)).astype(np.int64) % WORDS

    def class_log(self, history: np.ndarray) -> np.ndarray:
        """Natural-log class probabilities, a row for each history (near * SKIP + skip)."""
        x = self.bias + self.near[history // SKIP] + self.skip[history % SKIP] + self.pair[self.pair_feature(history)]
        x = x - x.max(axis=1, keepdims=True)
        return x - np.log(np.exp(x).sum(axis=1, keepdims=True))

    def word_log(self, before: np.ndarray) -> np.ndarray:
        """Natural-log probabilities of frequent words in their classes, a row for each class before."""
        n = self.vocab.frequent
        words = np.arange(n)
        group = self.buckets.group[:n]
        x = self.own[None, :] + self.word[self.word_feature(before[:, None], words[None, :])]
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(np.concatenate([[-1], group[order]])))
        top = np.maximum.reduceat(x[:, order], starts, axis=1)
        rank = np.empty(n, int)
        rank[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        x = x - top[:, rank]
        total = np.add.reduceat(np.exp(x[:, order]), starts, axis=1)
        return x - np.log(total[:, rank])


def _blank(vocab: Vocabulary, group: np.ndarray) -> Model:
    n = vocab.frequent
    groups = int(group.max()) + 1 if n else 1
    classes = groups + ENDINGS
    full = np.concatenate([group, groups + np.arange(ENDINGS), [classes]])
    zero = lambda *s: np.zeros(s, np.float32)
    counts = vocab.counts[:n] + SMOOTH
    mass = np.concatenate([np.bincount(group, counts, groups), vocab.mass])
    return Model(
        vocab, buckets(n, full), classes, zero(NEAR, classes), zero(SKIP, classes), zero(PAIRS, classes), np.log(mass / mass.sum()).astype(np.float32), zero(WORDS), np.log(counts).astype(np.float32)
    )


def events(rows: DataFrame, model: Model) -> DataFrame:
    """Counts of (history, class) and of (class before, frequent word) in all rows."""
    n, classes = model.vocab.frequent, model.classes
    shared = rows.sparkSession.sparkContext.broadcast((_list_index(model.vocab.words[:n]), model.buckets))

    def run(batches):
        index, b = shared.value
        tallies = _Tally(0), _Tally(1)
        for _, flat, _, _ in _batches_of_places(batches, index, 2):
            code = b.code(flat)
            at = np.flatnonzero(flat != START)
            history = b.near[code[at - 1]] * SKIP + b.skip[code[at - 2]]
            tallies[0].add(history * classes + b.group[code[at]])
            at = at[(flat[at] >= 0)]
            tallies[1].add(b.group[code[at - 1]] * n + flat[at])
            for t in tallies:
                if t.held > MERGE:
                    t.merge()
        for t in tallies:
            yield from t.rows()

    return _summed(rows, run, "events")


BLOCK = 1 << 14


def train(rows: DataFrame, updates: int = UPDATES) -> Model:
    """Model of the rows' texts (null: empty); of no rows, a uniform one."""
    counts = count_words(rows)
    return fit(rows, vocabulary(counts), updates)


def fit(rows: DataFrame, vocab: Vocabulary, updates: int = UPDATES) -> Model:
    model = _blank(vocab, word_groups(rows, vocab))
    if not vocab.tokens:
        return model
    n, classes = vocab.frequent, model.classes
    # One history, and one class before, lies in one partition.
    width = F.when(F.col("kind") == 0, F.lit(classes)).otherwise(F.lit(n))
    seen = events(rows, model).withColumn("h", F.floor(F.col("k") / width))
    seen = saved(seen.repartition("kind", "h"), "event-histories")
    spark = rows.sparkSession
    names = ("near", "skip", "pair", "word")
    sizes = [getattr(model, x).size for x in names]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    speed = np.zeros(edges[-1], np.float32)
    for _ in range(updates):
        shared = spark.sparkContext.broadcast(model)

        def gradients(batches):
            m = shared.value
            got = [b.to_pandas() for b in batches]
            data = pd.concat(got) if got else pd.DataFrame({"kind": [], "k": [], "c": []})
            observed, expected = np.zeros(edges[-1], np.float32), np.zeros(edges[-1], np.float32)
            for kind in (0, 1):
                part = data[data["kind"] == kind]
                if not len(part):
                    continue
                k, c = part["k"].to_numpy(), part["c"].to_numpy().astype(np.float64)
                across = classes if kind == 0 else n
                h, row = np.unique(k // across, return_inverse=True)
                for at in range(0, len(h), 2048):
                    mine = (row >= at) & (row < at + 2048)
                    hs = h[at : at + 2048]
                    o = np.bincount((row[mine] - at) * across + k[mine] % across, c[mine], len(hs) * across).reshape(len(hs), across)
                    if kind == 0:
                        e = o.sum(axis=1, keepdims=True) * np.exp(m.class_log(hs))
                        for x, feature, i in ((m.near, hs // SKIP, 0), (m.skip, hs % SKIP, 1), (m.pair, m.pair_feature(hs), 2)):
                            for total, value in ((observed, o), (expected, e)):
                                view = total[edges[i] : edges[i + 1]].reshape(x.shape)
                                np.add.at(view, feature, value.astype(np.float32))
                    else:
                        group = m.buckets.group[:n]
                        per = np.zeros((len(hs), group.max() + 1))
                        np.add.at(per.T, group, o.T)
                        e = per[:, group] * np.exp(m.word_log(hs))
                        feature = m.word_feature(hs[:, None], np.arange(n)[None, :]).ravel()
                        for total, value in ((observed, o), (expected, e)):
                            total[edges[3] :] += np.bincount(feature, value.ravel(), WORDS).astype(np.float32)
            for block in range(0, edges[-1], BLOCK):
                o, e = observed[block : block + BLOCK], expected[block : block + BLOCK]
                if o.any() or e.any():
                    yield pa.RecordBatch.from_pydict({"block": [block], "o": [o.tobytes()], "e": [e.tobytes()]}, schema=pa.schema([("block", pa.int64()), ("o", pa.binary()), ("e", pa.binary())]))

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            total = [sum(np.frombuffer(x, np.float32).astype(np.float64) for x in frame[c]).astype(np.float32).tobytes() for c in ("o", "e")]
            return pd.DataFrame({"block": [frame["block"].iloc[0]], "o": [total[0]], "e": [total[1]]})

        schema = "block long, o binary, e binary"
        found = seen.select("kind", "k", "c").mapInArrow(gradients, schema).groupBy("block").applyInPandas(add, schema).collect()
        observed, expected = np.zeros(edges[-1], np.float32), np.zeros(edges[-1], np.float32)
        for r in found:
            observed[r.block : r.block + BLOCK] = np.frombuffer(r.o, np.float32)
            expected[r.block : r.block + BLOCK] = np.frombuffer(r.e, np.float32)
        weights = np.concatenate([getattr(model, x).ravel() for x in names])
        # Gradient step, scaled for each feature by its expected count (its curvature).
        step = (observed - expected - DECAY * weights) / (np.maximum(observed, expected) + DECAY)
        speed = 0.5 * speed + RATE * step.astype(np.float32)
        weights = weights + speed
        for i, x in enumerate(names):
            setattr(model, x, weights[edges[i] : edges[i + 1]].reshape(getattr(model, x).shape))
        shared.unpersist()
    return model


@dataclass
class _Scorer:
    """Tables of log10 probabilities for scoring."""

    index: _Index
    buckets: Buckets
    class_log: np.ndarray
    word_log: np.ndarray
    before: np.ndarray
    ending: np.ndarray  # class by ending of listed words
    log_count: np.ndarray
    log_mass: np.ndarray
    groups: int
    log_count_none: float = float(np.log10(SMOOTH))  # of a word that training has not met


def _scorer(model: Model) -> _Scorer:
    v = model.vocab
    n = v.frequent
    history = np.arange(NEAR * SKIP)
    chosen = np.concatenate([model.class_log(history[i : i + 4096]) for i in range(0, len(history), 4096)]) / _LOG10
    words = model.word_log(np.arange(model.classes + 1)) / _LOG10
    own = np.array([0 if i < n else ending(w) for i, w in enumerate(v.words)])
    return _Scorer(
        _list_index(v.words), model.buckets, chosen.astype(np.float32), words.astype(np.float32), np.arange(model.classes + 1), own, np.log10(v.counts + SMOOTH), np.log10(v.mass), model.classes - ENDINGS
    )


PARTIAL = "rid long, doc_id {kind}, n_tokens long, n_known long, base double, model double, others array<struct<word:binary, tf:long>>"


def score(docs: DataFrame, model: Model, counts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``rid, doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``counts`` is the ``(word, c)`` table the model's vocabulary came from.  A
    null text is one end token.  Repeated rows and null or repeated ids are
    scored each; an empty table gives no rows.
    """
    v = model.vocab
    n = v.frequent
    tables = docs.sparkSession.sparkContext.broadcast(_scorer(model))
    whole = float(np.log10(v.tokens + SMOOTH * (v.distinct + 1)))
    rows = keyed(docs, doc_id, text)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        s = tables.value
        b = s.buckets
        for part, flat, doc, words in _batches_of_places(batches, s.index, 2):
            # Listed words beyond the frequent ones count as their ending class.
            listed = (flat >= n) & (flat != START)
            places = np.where(listed, -1 - s.ending[np.where(listed, flat, 0)], flat)
            code = b.code(places)
            at = np.flatnonzero(flat != START)
            history = b.near[code[at - 1]] * SKIP + b.skip[code[at - 2]]
            group = b.group[code[at]]
            logs = s.class_log[history, group].astype(np.float64)
            word = flat[at]
            own = (word >= 0) & (word < n)
            logs[own] += s.word_log[b.group[code[at[own] - 1]], word[own]]
            logs[~own] -= s.log_mass[group[~own] - s.groups]
            base = np.full(len(at), -whole)
            inside = word >= 0
            base[inside] += s.log_count[word[inside]]
            more = inside & ~own
            logs[more] += s.log_count[word[more]]
            size = part.num_rows
            met = inside & (s.log_count[np.where(inside, word, 0)] > s.log_count_none)
            sums = [np.bincount(doc[at], x, size) for x in (np.ones(len(at)), met.astype(float), base, logs)]
            others = []
            negative = flat < 0
            ends = np.cumsum(np.bincount(doc, minlength=size))
            for w, end in zip(words, ends):
                rare = np.flatnonzero(negative[end - 1 - len(w) : end - 1])
                others.append([{"word": k, "tf": c} for k, c in Counter(w[i] for i in rare).items()])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("rid"),
                    part.column("doc_id"),
                    pa.array(sums[0].astype(np.int64)),
                    pa.array(sums[1].astype(np.int64)),
                    pa.array(sums[2]),
                    pa.array(sums[3]),
                    pa.array(others, pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())]))),
                ],
                names=["rid", "doc_id", "n_tokens", "n_known", "base", "model", "others"],
            )

    partial = saved(rows.mapInArrow(run, PARTIAL.format(kind=kind)), "scores")
    # Words outside the list are rare, so no join key is hot.
    rare = partial.select("rid", F.explode("others").alias("o")).select("rid", "o.word", "o.tf")
    c = F.coalesce("c", F.lit(0))
    rest = rare.join(counts, "word", "left").groupBy("rid").agg(
        F.sum(F.col("tf") * F.log10(c + SMOOTH)).alias("_logs"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("_known")
    )
    logs = F.coalesce("_logs", F.lit(0.0))
    return partial.join(rest, "rid", "left").select(
        "rid",
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )


def train_and_score(docs: DataFrame, frequent: int = FREQUENT, known: int = KNOWN) -> DataFrame:
    """Learn from the rows that are not held out and score all."""
    rows = docs.where(~held_out()).select("text")
    counts = count_words(rows)
    return score(docs, fit(rows, vocabulary(counts, frequent, known)), counts)


@query("op4_maxent_scoring")
def op4(spark, sf_dir):
    """Log10 probability of every document, learned from those that are not held out."""
    scored = train_and_score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
