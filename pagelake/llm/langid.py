"""Operator 10, language identification by hierarchical discrimination.

Languages are grouped into families by how alike their byte n-gram profiles
are.  A text is first given a family (one linear SVM a family, against the
rest), then the languages of that family are told apart by linear SVMs on each
pair of them.

The SVMs are fitted on a bounded sample: at most ``per_language`` labelled rows
of each language, those with the smallest hash of the id, so the sample is the
same at every layout.  The sample's feature vectors are computed in Spark and
are all that reaches the driver.  Prediction reads every whole text in a
partition-local pass, without a shuffle.

The SVMs only tell the learned languages apart.  Whether a text is in any of
them is a second question: how much likelier its n-grams are under the best
language's mean profile than by chance, against what that language's own rows
reach, and how much of the text is letters at all (``Model.belongs``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.llm.common import quoted, table, unused
from pagelake.llm.registry import query

DIMENSIONS = 4096
ORDERS = (2, 3, 4)  # bytes of an n-gram
PER_LANGUAGE = 400
PIECE_BYTES = 1 << 21  # bytes of text whose n-grams are held at once
UNKNOWN = "und"
OTHER_SHARE = 0.02  # of a language's n-grams, those its sample does not show
OTHER_LEVEL, OTHER_SLOPE = 0.25, 20.0  # share of a language's usual evidence that a text needs, and how sharply
LEAST_EVIDENCE = 0.3  # a profile that its own rows fit by less (too few of them) rejects nothing given its language

# A-Z to lower case; other ASCII that is no letter to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
_SPACES = bytes(range(9, 14)) + bytes(range(28, 33))
_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
_MAYBE_LETTER = re.compile(r"[^\W\d_]")  # also number characters that are no digits
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOCAL_DOCS = 128
_TASKS = 64  # scan tasks whose best rows are merged in a step


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def _count(raw: bytes, counts: np.ndarray) -> None:
    """Add the hashed n-grams of ``raw`` to ``counts``, a piece at a time."""
    longest = max(ORDERS)
    shift = np.uint64(64 - int(np.log2(counts.size)))
    for at in range(0, len(raw), PIECE_BYTES):
        b = np.frombuffer(raw[at : at + PIECE_BYTES + longest - 1], np.uint8).astype(np.uint64)
        last = at + PIECE_BYTES >= len(raw)
        for n in ORDERS:
            m = len(b) - n + 1 if last else min(PIECE_BYTES, len(b) - n + 1)
            if m <= 0:
                continue
            code = np.full(m, n, np.uint64)
            for i in range(n):
                code = (code << np.uint64(8)) | b[i : i + m]
            counts += np.bincount(((code * _MIX) >> shift).astype(np.int64), minlength=counts.size)


def features(texts: list[str]) -> np.ndarray:
    """One unit-length row a text: square roots of hashed n-gram counts."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in zip(out, texts):
        counts = np.zeros(DIMENSIONS, np.int64)
        # Runs of spaces (digits, marks, line breaks) count as one.
        _count(b" " + b" ".join(text.encode().translate(_FOLD).split()) + b" ", counts)
        row[:] = np.sqrt(counts)
        size = np.linalg.norm(row)
        if size:
            row /= size
    return out


def amounts(texts: list[str]) -> np.ndarray:
    """Number of n-grams and share of letters in the visible bytes, a row for each text."""
    out = np.zeros((len(texts), 2))
    for row, text in zip(out, texts):
        raw = text.encode()
        size = 2 + sum(map(len, words := raw.translate(_FOLD).split())) + max(0, len(words) - 1)
        row[:] = sum(max(0, size - n + 1) for n in ORDERS), len(raw.translate(None, _NO_LETTERS)) / max(1, len(raw.translate(None, _SPACES)))
    return out


def profile(x: np.ndarray) -> np.ndarray:
    """Log of how much likelier each hashed n-gram is in the rows than by chance."""
    share = (x.astype(np.float64) ** 2).mean(axis=0)
    return np.log((1 - OTHER_SHARE) * share * x.shape[1] / max(share.sum(), 1e-12) + OTHER_SHARE)


def usual_evidence(x: np.ndarray) -> float:
    """Median evidence of a language's rows, each under the profile of the other half."""
    halves = (x[::2], x[1::2]) if len(x) > 1 else (x, x)
    return float(np.median(np.concatenate([(a.astype(np.float64) ** 2) @ profile(b) for a, b in (halves, halves[::-1])])))


def fit_svm(x: np.ndarray, positive: np.ndarray, strength: float = 1e-4, steps: int = 120) -> np.ndarray:
    """Weights and bias of a linear SVM (squared hinge loss, balanced classes).

    Accelerated full-batch gradient descent from zero: no randomness.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    weight = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    ahead = w.copy()
    rate = 1.0 / (4.0 + strength)  # the rows are unit vectors plus a bias: curvature at most 4
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        step = ahead + rate * (2 * (x.T @ (weight * y * slack)) - strength * ahead)
        ahead, w = step + (t / (t + 3)) * (step - w), step
    return w


@dataclass
class Model:
    """Families as lists of languages, and the SVMs of both levels."""

    families: list[list[str]]
    family_svms: np.ndarray  # one row a family (one family: none)
    pair_svms: dict[tuple[str, str], np.ndarray]
    profiles: np.ndarray  # one row a language
    usual: np.ndarray  # evidence that a language's own rows have

    def belongs(self, x: np.ndarray, amount: np.ndarray, named: list[str]) -> np.ndarray:
        """Chance in 0..1 that a text is in a learned language, however many there are.

        A short text is given the slack of its few n-grams.
        """
        if not len(self.profiles):
            return np.zeros(len(x))
        langs = sorted(lang for family in self.families for lang in family)
        sure = self.usual >= LEAST_EVIDENCE
        own = np.array([[lang == name for lang in langs] for name in named])
        ratio = np.where(sure, (x.astype(np.float64) ** 2) @ self.profiles.T / np.where(sure, self.usual, 1), own)
        found = (ratio.max(axis=1) + 1 / np.sqrt(np.maximum(1, amount[:, 0]))) * amount[:, 1]
        return 1 / (1 + np.exp(-np.clip(OTHER_SLOPE * (found - OTHER_LEVEL), -30, 30)))

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score in 0..1 of each text.

        Half of the score is the chance that the text is in a learned language,
        the other half the same times the choice among them; so a text in none
        is near 0, and one that fits several keeps half.
        """
        x = features(texts)
        found = self.predict(x)
        known = self.belongs(x, amounts(texts), [lang for lang, _ in found])
        return [(lang, float(b * (1 + s) / 2)) for (lang, s), b in zip(found, known)]

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """Language of each row and how clearly it wins, in 0..1 (product of both levels)."""
        if not self.families:
            return [(UNKNOWN, 0.0)] * len(x)
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        chance = np.ones((len(x), 1))
        if len(self.families) > 1:
            e = np.exp(np.clip(3 * (x @ self.family_svms.T), -30, 30))
            chance = e / e.sum(axis=1, keepdims=True)
        best = chance.argmax(axis=1)
        margins = {pair: x @ w for pair, w in self.pair_svms.items()}
        out = []
        for i, f in enumerate(best):
            langs = self.families[f]
            if len(langs) == 1:
                out.append((langs[0], float(chance[i, f])))
                continue
            votes = {lang: [0, 0.0] for lang in langs}
            for a in range(len(langs)):
                for b in range(a + 1, len(langs)):
                    m = float(margins[langs[a], langs[b]][i])
                    votes[langs[a] if m >= 0 else langs[b]][0] += 1
                    votes[langs[a]][1] += m
                    votes[langs[b]][1] -= m
            top = max(langs, key=lambda lang: (votes[lang][0], votes[lang][1]))
            inner = 1 / (1 + np.exp(-3 * np.clip(votes[top][1] / (len(langs) - 1), -10, 10)))
            out.append((top, float(chance[i, f] * inner)))
        return out


def families_of(langs: list[str], x: np.ndarray, labels: list[str]) -> list[list[str]]:
    """About sqrt(languages) families: the two closest mean profiles merge until then."""
    labels_ = np.array(labels)
    groups = [[lang] for lang in langs]
    mean = {lang: x[labels_ == lang].mean(axis=0) for lang in langs}

    def closeness(a, b):
        return float(np.mean([mean[p] @ mean[q] / (np.linalg.norm(mean[p]) * np.linalg.norm(mean[q]) + 1e-9) for p in a for q in b]))

    while len(groups) > int(np.ceil(np.sqrt(len(langs)))):
        pairs = [(closeness(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = max(pairs, key=lambda p: (p[0], -p[1], -p[2]))
        groups[i] = sorted(groups[i] + groups.pop(j))
    return groups


def fit(x: np.ndarray, labels: list[str]) -> Model:
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((0, DIMENSIONS + 1), np.float32), {}, np.zeros((0, DIMENSIONS)), np.zeros(0))
    labels_ = np.array(labels)
    families = families_of(langs, x, labels)
    member = np.isin
    svms = np.array([fit_svm(x, member(labels_, fam)) for fam in families]) if len(families) > 1 else np.zeros((0, x.shape[1] + 1))
    pairs = {}
    for fam in families:
        for i, a in enumerate(fam):
            for b in fam[i + 1 :]:
                both = member(labels_, [a, b])
                pairs[a, b] = fit_svm(x[both], labels_[both] == a)
    own = [x[labels_ == lang] for lang in langs]
    return Model(families, svms, pairs, np.array([profile(rows) for rows in own]), np.array([usual_evidence(rows) for rows in own]))


def held_out(doc_id="doc_id"):
    """Rows that training never sees: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on at most ``per_language`` labelled rows of each language.

    Rows with a null text, label or id, or without a letter, are not used.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # The ids alone are ranked; Spark keeps ``per_language`` rows a task before the shuffle.
    key = F.struct(F.xxhash64(F.col("doc_id")).alias("h"), F.col("doc_id"))
    # In two steps, so that no task gets the best rows of all tasks at once.
    ids = rows.select("doc_id", "lang", key.alias("k"), F.floor(F.spark_partition_id() / _TASKS).alias("_part"))
    for by in (["lang", "_part"], ["lang"]):
        first = F.row_number().over(W.partitionBy(*by).orderBy("k"))
        ids = ids.withColumn("_r", first).where(F.col("_r") <= per_language).drop("_r")
    chosen = ids.select("doc_id", "lang")

    def run(batches):
        for batch in batches:
            texts, langs, ids = (batch.column(c).to_pylist() for c in ("text", "lang", "doc_id"))
            use = [i for i, t in enumerate(texts) if has_letter(t)]
            for at in range(0, len(use), _LOCAL_DOCS):
                part = use[at : at + _LOCAL_DOCS]
                x = features([texts[i] for i in part])
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": [ids[i] for i in part], "lang": [langs[i] for i in part], "x": [r.astype(np.float16).tobytes() for r in x]},
                    schema=pa.schema([("doc_id", batch.schema.field("doc_id").type), ("lang", pa.string()), ("x", pa.binary())]),
                )

    kind = dict(docs.dtypes)["doc_id"]
    # At most per_language ids a language: a proven bound for the broadcast.
    sample = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").mapInArrow(run, f"doc_id {kind}, lang string, x binary")
    # A repeated id can bring several rows; those beyond the bound go, by id.
    found = sample.select("doc_id", "lang", "x").collect()
    found.sort(key=lambda r: (r.lang, r.doc_id, bytes(r.x)))
    taken: dict[str, int] = {}
    use = []
    for r in found:
        taken[r.lang] = taken.get(r.lang, 0) + 1
        if taken[r.lang] <= per_language:
            use.append(r)
    if not use:
        return fit(np.zeros((0, DIMENSIONS), np.float32), [])
    x = np.array([np.frombuffer(r.x, np.float16).astype(np.float32) for r in use])
    return fit(x, [r.lang for r in use])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` from the text alone.

    ``und`` with score 0 where the text is null or has no letter (an empty
    text too), or nothing was learned.  All other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        lang = [UNKNOWN] * len(texts)
        score = [0.0] * len(texts)
        use = [i for i, t in enumerate(texts) if t is not None and has_letter(t)]
        for at in range(0, len(use), _LOCAL_DOCS):
            part = use[at : at + _LOCAL_DOCS]
            for i, (name, s) in zip(part, shared.value.score([texts.iloc[i] for i in part])):
                lang[i], score[i] = name, s
        return pd.DataFrame({"lang_pred": lang, "score": score})

    others = [F.col(quoted(c)) for c in docs.columns if c not in ("lang_pred", "score")]
    (found,) = unused(docs, "_found")
    return docs.select(*others, predicted(F.col(quoted(text))).alias(found)).select(*others, f"{found}.lang_pred", f"{found}.score")


@query("op10_language_id")
def op10(spark, sf_dir):
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
