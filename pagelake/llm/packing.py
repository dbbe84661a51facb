"""Operator 1, sequence packing by cutting-stock column generation.

Documents are tokenised and cut into full sequences and one remainder each.
The remainders' length histogram (at most ``SEQUENCE`` numbers, whatever the
input size) is a cutting-stock problem: a linear program over patterns, each
pattern a multiset of length classes that fills one sequence.  New patterns are
priced by a knapsack dynamic program over the dual values.  The program's
solution is rounded down and given to documents by rank: the n-th document of a
length class has a known pattern, sequence and place, found by a search in a
table of pattern runs.  What rounding leaves out, and lengths that no pattern
fills well, are laid end to end and cut at full sequences.

Scale: texts are read once and never shuffled; what is sorted and grouped are
rows of numbers (a piece's running checksums among them, so that it can be cut
again without its text).  The driver holds the histogram and the patterns only:
where a rank stands in the line follows from the histogram.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.llm.common import keyed, table, tidy
from pagelake.llm.registry import query
from pagelake.operators.numbering import global_rank, saved

SEQUENCE = 4096
GRID = 8  # tokens of a length class
MAX_GAP = 48  # tokens a pattern may leave free in the mean
RESIDUAL_MISSES = 40  # patterns in a row that fill too little before the rest is laid end to end
MAX_ROUNDS = 1500  # pricing rounds; stopping early costs padding, never a document
MARK = 16  # ids between the places where a piece may be cut again
TOLERANCE = 0.005
END_ID = 2
CACHE = 60_000  # words of a generation of a worker's cache; twice as many parts
MARKS = b".,;:!?\"()[]{}*#$%&|"
PART = 20_000  # words looked up at once
_END = np.array([END_ID], "<u4").tobytes()

PIECES = "rid long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, marks array<long>"
#: Letters whose lower case is one letter and which compose with none of each other: ASCII,
#: Latin-1, Latin Extended-A, Cyrillic, kana, Han and Hangul syllables.  A run of them is one pre-token.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u0400-\u045f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]+")
PROBES = ("the", "Packing", "a", "\u00c9tude", "\u0441\u043b\u043e\u0432\u043e", "\u8a9e", "qzxjw")
_tokenizers: dict = {}


def _byte_characters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(rest)}


_BYTES = _byte_characters()


def letter_ids(model, letters: str) -> list[int]:
    """Ids of a run of ``LETTERS`` straight from the vocabulary's model, normalised as the tokenizer would."""
    return [t.id for t in model.tokenize(letters.lower().encode().decode("latin-1").translate(_BYTES))]


def tokenizer(path: str):
    if path not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        _tokenizers[path] = t
    return _tokenizers[path]


class Words:
    """Ids of words (runs between ASCII white space) as little-endian 32-bit bytes.

    The vocabulary's pre-tokens never hold white space and its normalisation
    never reaches across it, so a text's ids are its words' ids in a row.
    Letters and marks are different pre-tokens too, so a word of letters with
    ASCII marks behind has the ids of both parts, and ASCII letters those of
    their lower case.  A worker tokenises each part once; of two generations of
    ``CACHE`` entries the older one goes, so memory is bounded.  A part of
    ``LETTERS`` alone is one pre-token and goes straight to the vocabulary's
    model; the others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.path = path
        self.words: dict[bytes, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        self.old_parts: dict[bytes, bytes] = {}
        t = tokenizer(path)
        # Only where the vocabulary normalises and cuts as ``letter_ids`` takes it to.
        plain = all(letter_ids(t.model, p) == t.encode(p, add_special_tokens=False).ids for p in PROBES)
        self.model = t.model if plain else None

    def _letters(self, core: bytes) -> bytes | None:
        """Ids of a part of ``LETTERS`` (ASCII ones in lower case); None if it holds something else."""
        if core.isalpha():  # ASCII letters are their own byte characters
            return array("I", [t.id for t in self.model.tokenize(core.decode())]).tobytes()
        text = core.decode()
        return array("I", letter_ids(self.model, text)).tobytes() if LETTERS.fullmatch(text) else None

    def _tokenised(self, parts: list[bytes]) -> None:
        """Have the ids of all ``parts`` in ``self.parts``."""
        held = self.parts
        t = tokenizer(self.path)
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            found = t.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)
            for p, e in zip(some, found):
                held[p] = array("I", e.ids).tobytes()

    def meet(self, words: set[bytes]) -> None:
        """Have the ids of all ``words`` in ``self.words``."""
        if len(self.words) + len(words) > CACHE:
            self.old_words, self.words = self.words, {}
        if len(self.parts) + 2 * len(words) > 2 * CACHE:
            self.old_parts, self.parts = self.parts, {}
        held, old, parts, old_parts = self.words, self.old_words, self.parts, self.old_parts
        new = words.difference(held)
        again = [w for w in new if w in old]
        held.update(zip(again, map(old.__getitem__, again)))
        new.difference_update(again)
        direct = self.model is not None
        cut, todo = [], set()
        for w in new:
            core = w.rstrip(MARKS)
            marks = w[len(core) :] if len(core) < len(w) else b""
            if core.isalpha():
                core = core.lower()
            elif core.isascii() or not unicodedata.normalize("NFC", core.decode()).lower().isalpha():
                # No letters alone, or letters that the vocabulary's normalisation
                # leaves with a combining mark, which goes with the marks behind.
                core, marks = w, b""
            ids = parts.get(core) or old_parts.get(core) or (self._letters(core) if direct else None)
            if ids:
                parts[core] = ids
                if not marks:
                    held[w] = ids
                    continue
                behind = parts.get(marks) or old_parts.get(marks)
                if behind:
                    parts[marks] = behind
                    held[w] = ids + behind
                    continue
            else:
                todo.add(core)
            if marks and marks not in parts:
                todo.add(marks)
            cut.append((w, core, marks))
        self._tokenised(list(todo))
        for w, core, marks in cut:
            held[w] = parts[core] + parts[marks] if marks else parts[core]


_words: dict = {}


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each text, then ``END_ID``, as little-endian unsigned 32-bit numbers."""
    if path not in _words:
        _words[path] = Words(path)
    known = _words[path]
    out: list[bytes] = []
    held: list[list[bytes]] = []  # words of texts that are looked up together
    size = 0

    def flush():
        nonlocal held, size
        known.meet(set().union(*held))
        look = known.words.__getitem__
        out.extend(b"".join(map(look, words)) + _END for words in held)
        held, size = [], 0

    for text in texts:
        words = (text or "").encode().split()
        if len(words) > PART:  # a very long text, a part at a time
            flush()
            ids = []
            for at in range(0, len(words), PART):
                part = words[at : at + PART]
                known.meet(set(part))
                ids.append(b"".join(map(known.words.__getitem__, part)))
            out.append(b"".join([*ids, _END]))
            continue
        held.append(words)
        size += len(words)
        if size > PART:
            flush()
    flush()
    return out


def token_ids(texts: list[str | None], path: str) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u4") for b in token_bytes(texts, path)]


def running_checksums(ids: bytes, every: int = MARK) -> list[int]:
    """crc32 of the first ``every`` ids, the first two times as many, and so on, short of all."""
    out, crc, step = [], 0, 4 * every
    for at in range(0, len(ids) - step, step):
        crc = zlib.crc32(ids[at : at + step], crc)
        out.append(crc)
    return out


def _zero_operators() -> list[list[int]]:
    """For each power of two of zero bytes, what they make of each bit of a crc32."""
    polynomial = 0xEDB88320  # fixed value: crc32, bits reversed
    times = lambda m, v: _xor(m[i] for i in range(32) if v >> i & 1)
    one = [polynomial] + [1 << i for i in range(31)]  # a zero bit
    for _ in range(3):
        one = [times(one, c) for c in one]
    out = [one]
    for _ in range(30):
        out.append([times(out[-1], c) for c in out[-1]])
    return out


def _xor(values) -> int:
    total = 0
    for v in values:
        total ^= v
    return total


_ZEROS: list = []


def checksum_between(first: int, both: int, size: int) -> int:
    """crc32 of the last ``size`` bytes of a text, from that of what is before and of all."""
    if not _ZEROS:
        _ZEROS.extend(_zero_operators())
    k = 0
    while size:
        if size & 1:
            m = _ZEROS[k]
            first = _xor(m[i] for i in range(32) if first >> i & 1)
        size >>= 1
        k += 1
    return first ^ both


def pieces(rows: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """Full pieces and the remainder of each row of ``keyed``, with running checksums."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            rids, ids, texts = (batch.column(c).to_pylist() for c in ("rid", "doc_id", "text"))
            out = []
            for rid, doc_id, ids_ in zip(rids, ids, token_bytes(texts, path)):
                n = len(ids_) // 4
                for start in range(0, n, sequence):
                    part = ids_[4 * start : 4 * (start + sequence)]
                    size = len(part) // 4
                    out.append((rid, doc_id, start, size, zlib.crc32(part), n, running_checksums(part) if size < sequence else []))
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), batch.schema.field("doc_id").type, *[pa.int64()] * 4, pa.list_(pa.int64())]
            names = ["rid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "marks"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return rows.mapInArrow(tidy(run), PIECES.format(kind=kind))


def knapsack(value: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best multiset of items within ``room``: its value and the count of each item."""
    best = np.zeros(room + 1)
    took = np.full(room + 1, -1)
    order = np.argsort(size)
    size_, value_ = size[order], value[order]
    fits = np.searchsorted(size_, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            gain = best[c - size_[:n]] + value_[:n]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], took[c] = gain[k], k
    count = np.zeros(len(size), int)
    c = room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            count[order[took[c]]] += 1
            c -= size_[took[c]]
    return float(best[room]), count


def solve(size: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, float]]:
    """Cutting-stock linear program by column generation: (pattern, times) pairs.

    Starts from one-class patterns and lets the best-priced pattern into the
    basis until the dual bound (objective over the best price met) says that
    at most a share ``TOLERANCE`` of sequences could be saved.
    """
    m = len(size)
    basis = np.diag(room // size).astype(float)
    inverse = np.diag(1.0 / (room // size))
    times = demand / (room // size)
    bound = 0.0
    for turn in range(MAX_ROUNDS):
        prices = inverse.sum(axis=0)
        value, pattern = knapsack(prices, size, room)
        bound = max(bound, times.sum() / value)
        if times.sum() <= bound * (1 + TOLERANCE):
            break
        direction = inverse @ pattern
        up = direction > 1e-9
        ratios = np.full(m, np.inf)
        ratios[up] = times[up] / direction[up]
        leave = int(ratios.argmin())
        step = ratios[leave]
        times = np.maximum(times - step * direction, 0)
        times[leave] = step
        basis[:, leave] = pattern
        if turn % 200 == 199:  # rounding errors of the updates
            inverse = np.linalg.inv(basis)
            times = np.maximum(inverse @ demand, 0)
        else:
            row = inverse[leave] / direction[leave]
            inverse = inverse - np.outer(direction, row)
            inverse[leave] = row
    return [(basis[:, j].astype(int), float(times[j])) for j in range(m) if times[j] > 0]


def powers(total: int) -> list[int]:
    """The powers of two that add up to ``total``, largest first."""
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


@dataclass
class Plan:
    """Places of all pieces by rank (longest piece first), as a few arrays.

    A *run* is a range of ranks of one class that a pattern takes, ``per`` of
    them in each sequence from ``slot`` on.  Ranks in no pattern (``per`` 0)
    are laid end to end, each rounded up to ``MARK`` ids, and that line is cut
    every ``size`` ids: cuts fall on marks, where checksums are known.
    ``stream`` is where the run starts in the line.
    """

    first: np.ndarray
    per: np.ndarray
    sequence: np.ndarray
    slot: np.ndarray
    stream: np.ndarray
    length_first: np.ndarray  # first rank of each length, that length, rounded up
    length: np.ndarray
    tokens: np.ndarray  # rounded ids of all ranks before it
    line_sequence: int  # first sequence of the line
    line_total: int
    size: int

    def before(self, rank: np.ndarray) -> np.ndarray:
        """Rounded ids of all pieces of lower rank."""
        k = np.searchsorted(self.length_first, rank, side="right") - 1
        return self.tokens[k] + (rank - self.length_first[k]) * self.length[k]

    def place(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and slot of each rank; sequence -1 for those in the line."""
        run = np.searchsorted(self.first, rank, side="right") - 1
        per = np.maximum(self.per[run], 1)
        nth = rank - self.first[run]
        return np.where(self.per[run] > 0, self.sequence[run] + nth // per, -1), self.slot[run] + nth % per

    def parts(self, rank: np.ndarray, length: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
        """Parts (start, length, sequence, slot) of pieces in the line."""
        run = np.searchsorted(self.first, rank, side="right") - 1
        at = self.stream[run] + self.before(rank) - self.before(self.first[run])
        out = []
        for pos, n in zip(at.tolist(), length.tolist()):
            own, start = [], 0
            while start < n:
                k, offset = divmod(pos + start, self.size)
                end = min(n, start + self.size - offset)
                own.append((start, end - start, self.line_sequence + k, offset))
                start = end
            out.append(own)
        return out

    @property
    def last(self) -> int:
        """The line's last sequence, which may hold little."""
        return self.line_sequence + max(0, self.line_total - 1) // self.size


def fullest(size: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """How many of each class, at most ``left``, fill ``room`` best (bounded knapsack, worth is size).

    Classes are met in a fixed shuffled order: large and small ones go alike, so
    neither kind is left over.
    """
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    by = np.full(room + 1, -1)
    bundles: list[tuple[int, int]] = []
    for k in np.random.default_rng(len(size)).permutation(len(size)).tolist():
        rest, n = min(int(left[k]), room // int(size[k])), 1
        while rest > 0 and not reached[room]:
            n = min(n, rest)
            sums = np.flatnonzero(reached[: room + 1 - n * size[k]]) + n * size[k]
            sums = sums[~reached[sums]]
            by[sums] = len(bundles)
            reached[sums] = True
            bundles.append((k, n))
            rest -= n
            n *= 2
    at = int(np.flatnonzero(reached)[-1])
    count = np.zeros(len(size), np.int64)
    while at:
        k, n = bundles[by[at]]
        count[k] += n
        at -= n * int(size[k])
    return count


class _Shelf:
    """Pieces that have no place yet, by length class: ranks ``at`` to ``stop`` of each."""

    def __init__(self, lengths: list[int], histogram: dict[int, int], rank: int, grid: int, rest: list[int]):
        count = np.array([histogram[n] for n in lengths], np.int64)
        self.lengths = np.array(lengths, np.int64)
        self.first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64) if lengths else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(count * self.lengths)]).astype(np.int64)
        self.end = int(count.sum())
        demand: dict[int, int] = {}
        for n in rest:
            demand[-(-n // grid)] = demand.get(-(-n // grid), 0) + histogram[n]
        self.size = np.array(sorted(demand, reverse=True), int)
        self.demand = np.array([demand[c] for c in self.size], float)
        bounds = rank + np.concatenate([[0], np.cumsum(self.demand)]).astype(np.int64)
        self.at, self.stop = bounds[:-1].copy(), bounds[1:]

    def longest(self, rank):
        """Length of the piece of that rank, which no later one exceeds."""
        return self.lengths[np.searchsorted(self.first, np.minimum(rank, self.end - 1), side="right") - 1]

    def tokens(self, rank: np.ndarray) -> np.ndarray:
        """Ids of all pieces of lower rank."""
        rank = np.asarray(rank)
        k = np.searchsorted(self.first, np.minimum(rank, self.end - 1), side="right") - 1
        return self.before[k] + (rank - self.first[k]) * self.lengths[k]

    def filled(self, pattern: np.ndarray, times: int, sequence: int, max_gap: int) -> tuple[np.ndarray, int, bool]:
        """The pattern, its free room given to other classes; how often it is used; whether it leaves little free.

        The first sequence of a pattern gets the longest pieces of each class, so
        what fits it fits all.
        """
        pattern = pattern.copy()
        used = np.flatnonzero(pattern)
        times = int(min([times, *((self.stop - self.at)[used] // pattern[used])]))
        if times < 1:
            return pattern, 0, False
        start = self.tokens(self.at)
        room = sequence - int((self.tokens(self.at + pattern) - start).sum())
        while room > 0:  # the longest that fits, again and again
            spare = (self.stop - self.at) // times - pattern
            longest = self.longest(self.at + pattern)
            fits = np.flatnonzero((spare > 0) & (longest <= room))
            if not fits.size:
                break
            k = int(fits[0])
            pattern[k] += min(int(spare[k]), room // int(longest[k]))
            room = sequence - int((self.tokens(self.at + pattern) - start).sum())
        held = int((self.tokens(self.at + times * pattern) - start).sum())
        return pattern, times, room >= 0 and sequence - held / times <= max_gap


def plan(histogram: dict[int, int], sequence: int = SEQUENCE, grid: int = GRID, max_gap: int = MAX_GAP) -> Plan:
    """Places for all pieces, from the count of pieces of each length.

    The rounded patterns of the linear program come first.  What rounding has
    left out is priced again by the knapsack, a pattern at a time, as long as
    patterns fill sequences.  A pattern's free room goes to whatever still fits;
    one that leaves more than ``max_gap`` tokens free in the mean even so is not
    used.  Pieces that no pattern takes are laid end to end.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    lengths = sorted(histogram, reverse=True)
    room = sequence // grid
    next_sequence = rank = 0
    for n in (n for n in lengths if -(-n // grid) >= room):  # a sequence of their own
        if n < sequence - max_gap:
            break
        runs.append((rank, 1, next_sequence, 0, 0))
        rank += histogram[n]
        next_sequence += histogram[n]
    rest = [n for n in lengths if -(-n // grid) < room or n < sequence - max_gap]
    shelf = _Shelf(lengths, histogram, rank, grid, rest)

    def use(pattern: np.ndarray, times: int) -> bool:
        """Place up to ``times`` sequences; fewer at once leave more to fill each with."""
        nonlocal next_sequence
        step, any_ = times, False
        while step >= 1 and times >= 1:
            made, n, dense = shelf.filled(pattern, min(step, times), sequence, max_gap)
            if not dense:
                step = min(step, max(n, 1)) // 4
                continue
            slot = 0
            for k in np.flatnonzero(made):
                runs.append((int(shelf.at[k]), int(made[k]), next_sequence, slot, 0))
                shelf.at[k] += n * made[k]
                slot += int(made[k])
            next_sequence += n
            times -= n
            any_ = True
        return any_

    solved = solve(shelf.size, shelf.demand, room) if len(shelf.size) else []
    # Patterns of few large pieces first: small ones are left to fill with.
    for pattern, times in sorted(solved, key=lambda p: int(p[0].sum())):
        use(pattern, int(times + 1e-9))
    failed = 0
    while failed < RESIDUAL_MISSES:
        left = (shelf.stop - shelf.at).copy()
        open_ = np.flatnonzero(left > 0)
        if not open_.size or left[open_] @ shelf.size[open_] < room:
            break  # not a sequence's worth
        # Around the longest piece that is left; after a miss, around a shorter one.
        start = open_[min(failed, open_.size - 1)]
        left[start] -= 1
        pattern = np.zeros(len(left), np.int64)
        size = shelf.longest(shelf.at)  # to the token: what is left is too little to lose roundings
        pattern[open_] = fullest(size[open_], left[open_], sequence - int(size[start]))
        pattern[start] += 1
        left[start] += 1
        used = np.flatnonzero(pattern)
        times = int((left[used] // pattern[used]).min())
        failed = 0 if use(pattern, times) else failed + 1
    length = -(-np.array(lengths, np.int64) // MARK) * MARK
    count = np.array([histogram[n] for n in lengths], np.int64)
    tokens = np.concatenate([[0], np.cumsum(count * length)[:-1]]).astype(np.int64)
    made = Plan(*[np.zeros(0, np.int64)] * 5, shelf.first, length, tokens, next_sequence, 0, sequence)
    total = int(count @ length) if len(lengths) else 0
    for k in range(len(shelf.size)):
        lo, hi = int(shelf.at[k]), int(shelf.stop[k])
        if lo < hi:
            runs.append((lo, 0, -1, 0, made.line_total))
            end = total if hi >= count.sum() else int(made.before(np.array([hi]))[0])
            made.line_total += end - int(made.before(np.array([lo]))[0])
    runs.sort()
    made.first, made.per, made.sequence, made.slot, made.stream = (np.array(x, np.int64) for x in (zip(*runs) if runs else [[]] * 5))
    return made


PLACED = ["rid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"]


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE, grid: int = GRID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    A null text is an empty one: its only id is the end id.  Repeated rows and
    repeated or null ids are packed each (``rid`` tells them apart).  Offsets of
    a sequence are gapless from 0; a sequence has at most ``sequence`` ids.  An
    empty table gives no rows.
    """
    rows = keyed(docs, doc_id, text)
    cut = saved(pieces(rows, path, sequence), "pieces")
    order = [F.col("length").desc(), F.col("rid").asc(), F.col("start").asc()]
    ranked = global_rank(cut, order, "rank")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    made = plan(histogram, sequence, grid)
    shared = docs.sparkSession.sparkContext.broadcast(made)

    @F.pandas_udf("sequence_id long, slot long")
    def place(rank: pd.Series) -> pd.DataFrame:
        seq, slot = shared.value.place(rank.to_numpy())
        return pd.DataFrame({"sequence_id": seq, "slot": slot})

    @F.pandas_udf("array<struct<part:long, length:long, sequence_id:long, slot:long, crc:long>>")
    def parts(rank: pd.Series, length: pd.Series, crc: pd.Series, marks: pd.Series) -> pd.Series:
        out = []
        for own, n, whole, known in zip(shared.value.parts(rank.to_numpy(), length.to_numpy()), length, crc, marks):
            found = []
            for a, size, q, k in own:
                before = int(known[a // MARK - 1]) if a else 0
                through = int(whole) if a + size == n else int(known[(a + size) // MARK - 1])
                found.append({"part": a, "length": size, "sequence_id": q, "slot": k, "crc": checksum_between(before, through, 4 * size)})
            out.append(found)
        return pd.Series(out)

    placed = ranked.withColumn("_at", place("rank")).select(*PLACED[:6], "_at.sequence_id", "_at.slot", "rank", "marks")
    whole = placed.where("sequence_id >= 0").select(*PLACED)
    line = placed.where("sequence_id < 0").withColumn("p", F.explode(parts("rank", "length", "ids_crc32", "marks")))
    line = line.select(
        "rid", "doc_id", (F.col("start") + F.col("p.part")).alias("start"), "p.length", F.col("p.crc").alias("ids_crc32"), "doc_tokens", "p.sequence_id", "p.slot"
    )
    line = saved(line, "line")
    end = line.where(F.col("sequence_id") == made.last)
    tail = end.orderBy("slot").collect()  # one sequence at most
    total = sum(r.length for r in tail)
    if tail and total < sequence - MAX_GAP:
        line = line.where(F.col("sequence_id") != made.last).unionByName(_powers_of_two(rows, tail, total, made.last, path))
    # A sequence holds at most ``sequence`` pieces.
    before = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    out = whole.unionByName(line)
    return out.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("slot")


def _powers_of_two(rows: DataFrame, tail: list, total: int, sequence: int, path: str) -> DataFrame:
    """The pieces of the line's last sequence, cut into sequences of powers of two.

    These need no padding.  Only the documents of this one sequence are
    tokenised once more, for the checksums.
    """
    todo = [(r.rid, r.start, r.length) for r in tail]
    places = []
    for length in powers(total):
        slot = 0
        while length:
            rid, start, n = todo.pop(0)
            use = min(n, length)
            places.append((rid, start, use, sequence, slot))
            if n > use:
                todo.insert(0, (rid, start + use, n - use))
            length -= use
            slot += 1
        sequence += 1

    @F.pandas_udf("array<long>")
    def checksums(texts: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
        out = []
        for ids, ss, ns in zip(token_bytes(list(texts), path), starts, lengths):
            out.append([zlib.crc32(ids[4 * s : 4 * (s + n)]) for s, n in zip(ss, ns)] + [len(ids) // 4])
        return pd.Series(out)

    spark = rows.sparkSession
    parts = spark.createDataFrame(places, "rid long, start long, length long, sequence_id long, slot long")
    own = parts.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "slot"))).alias("p"))
    found = rows.join(F.broadcast(own), "rid").withColumn("crc", checksums("text", "p.start", "p.length"))
    flat = found.select("rid", "doc_id", F.element_at("crc", -1).alias("doc_tokens"), F.posexplode("p").alias("_i", "z"), "crc")
    return flat.select("rid", "doc_id", "z.start", "z.length", F.element_at("crc", F.col("_i") + 1).alias("ids_crc32"), "doc_tokens", "z.sequence_id", "z.slot")


@query("op1_cutting_stock_packing")
def op1(spark, sf_dir):
    """All documents packed into sequences of at most 4096 tokens, one row a piece."""
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
