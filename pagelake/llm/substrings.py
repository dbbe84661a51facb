"""Operator 3, substring dedup by De Bruijn compaction.

Every ``window`` consecutive words of a document are an edge of a De Bruijn
graph.  Edges are never shuffled one by one.  A window's *anchor* is its
``seed``-word k-mer of lowest hash; neighbouring windows mostly share their
anchor, and the run of windows that do is one compacted path, about seven
edges long.  Equal windows have equal anchors, so

* paths are shuffled by anchor (one row a path);
* paths of equal content are one nonbranching path of the graph: each later
  occurrence repeats the first, whose coordinates it takes as its source;
* where an anchor has paths of several contents the graph branches, and only
  there, and only for one path of each content, the single edges are compared.

Neighbouring repeated paths whose sources are neighbours too are compacted to
one long span by a join-free pass per document.  Each long span is then
verified: the words at its source coordinates and at its own must have the
same 128-bit digest.  A word goes if a verified span covers it.

Scale: a task batch compares its own paths first, so a passage that a third of
all documents share is shuffled once a batch.  Texts are shuffled twice, by
row, packed with zstd; no document, passage or anchor group is gathered in one
place except a document's own spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.llm.common import keyed, table, tidy
from pagelake.llm.registry import query
from pagelake.operators.numbering import saved

WINDOW = 20
SEED = 8
CHUNK = 1 << 17  # words whose hashes are held at once
CODES = 50_000  # word hashes kept by a worker

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


class _Codes(dict):
    """64-bit hash of a word; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CODES:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word)
        return code


_codes = _Codes()
_tables: dict = {}


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space and \\x09-\\x0D, which is what ``bytes.split`` gives."""
    return (text or "").encode().split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_codes.__getitem__, words), _U, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = max(1 << 12, 1 << int(n).bit_length())
    if size not in _tables:
        up, down = np.full(size, _BASE, _U), np.full(size, pow(_BASE, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _tables[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _tables[size]


class Sums:
    """Hashes of any run of words from prefix sums."""

    def __init__(self, codes: np.ndarray):
        up, self.down = _powers(len(codes) + 1)
        self.prefix = np.zeros(len(codes) + 1, _U)
        np.cumsum(codes * up[: len(codes)], out=self.prefix[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.prefix[stop] - self.prefix[start]) * self.down[start])


def paths(codes: np.ndarray, valid: np.ndarray, window: int, seed: int):
    """Compacted paths of one chunk: (anchor, content, first window, windows).

    ``valid`` marks the starts of windows that lie within one document.
    """
    starts = np.flatnonzero(valid)
    if not len(starts):
        return (np.zeros(0, _U),) * 2 + (np.zeros(0, np.int64),) * 2
    sums = Sums(codes)
    at = np.arange(len(codes) - seed + 1)
    value = sums.of(at, at + seed)
    # Leftmost minimum of each run of (window - seed + 1) k-mers, by doubling.
    span = window - seed + 1
    low, where, have = value, at, 1
    while have * 2 <= span:
        left = low[:-have] <= low[have:]
        low, where = np.where(left, low[:-have], low[have:]), np.where(left, where[:-have], where[have:])
        have *= 2
    if have < span:
        d = span - have
        left = low[:-d] <= low[d:]
        low, where = np.where(left, low[:-d], low[d:]), np.where(left, where[:-d], where[d:])
    place = where[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    lo = starts[first]
    content = sums.of(lo, lo + count + window - 1) ^ count.astype(_U)
    return value[place[first]], content, lo, count


def _chunks(batch, window: int):
    """Word hashes of a batch's documents in chunks: (codes, document of a word, place in it).

    A document longer than a chunk is cut with ``window - 1`` words of overlap.
    """
    codes, doc, place, held = [], [], [], 0
    for i, text in enumerate(batch.column("text")):
        own = hashes(words_of(text.as_py()))
        for at in range(0, max(1, len(own) - window + 1), CHUNK):
            part = own[at : at + CHUNK + window - 1]
            if len(part) < window:
                continue
            if held and held + len(part) > 2 * CHUNK:
                yield np.concatenate(codes), np.concatenate(doc), np.concatenate(place)
                codes, doc, place, held = [], [], [], 0
            codes.append(part)
            doc.append(np.full(len(part), i))
            place.append(np.arange(at, at + len(part)))
            held += len(part)
    if held:
        yield np.concatenate(codes), np.concatenate(doc), np.concatenate(place)


def _doc_order(batch) -> np.ndarray:
    """Place of each row of a batch in the order (doc_id, null first; rid)."""
    ids, rids = batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, rids[i]))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    return rank


PATHS = "repeat boolean, anchor long, content long, doc_id {kind}, rid long, lo long, n long, src_rid long, src_lo long"


def _paths(window: int, seed: int):
    def run(batches):
        for batch in batches:
            found = []
            for codes, doc, place in _chunks(batch, window):
                valid = np.zeros(len(codes), bool)
                last = len(codes) - window + 1
                # Same document and consecutive places: the window does not cross a border.
                valid[:last] = (doc[:last] == doc[window - 1 :]) & (place[window - 1 :] - place[:last] == window - 1)
                anchor, content, lo, n = paths(codes, valid, window, seed)
                found.append((anchor, content, doc[lo], place[lo], n))
            if not found:
                continue
            anchor, content, doc, lo, n = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((lo, _doc_order(batch)[doc], content, anchor))
            anchor, content, doc, lo, n = (x[order] for x in (anchor, content, doc, lo, n))
            fresh = np.ones(len(anchor), bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
            source = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
            rid = batch.column("rid").to_numpy()
            # A repeat within the batch is settled here; any anchor value spreads it.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(~fresh),
                    pa.array(np.where(fresh, anchor, mix(anchor + np.arange(len(anchor)).astype(_U))).view(np.int64)),
                    pa.array(content.view(np.int64)),
                    batch.column("doc_id").take(pa.array(doc)),
                    pa.array(rid[doc]),
                    pa.array(lo),
                    pa.array(n),
                    pa.array(rid[doc[source]], mask=fresh),
                    pa.array(lo[source], mask=fresh),
                ],
                names=["repeat", "anchor", "content", "doc_id", "rid", "lo", "n", "src_rid", "src_lo"],
            )

    return tidy(run)


@tidy
def _pack(batches):
    import zstandard

    tool = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [tool.compress((t.as_py() or "").encode()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(packed, pa.binary())], names=["rid", "doc_id", "packed"])


def _unpack(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def digest(words: list[bytes]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(words))


ANSWERS = "edge boolean, h1 long, h2 long, doc_id {kind}, rid long, lo long, n long, digest binary"


def _answers(window: int):
    """Edges of branching paths and digests of sources, document by document."""

    def run(batches):
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for i in range(batch.num_rows):
                words = _unpack(batch.column("packed")[i].as_py()).split()
                asks = batch.column("asks")[i].as_py()
                rid, doc_id = batch.column("rid")[i].as_py(), batch.column("doc_id")[i].as_py()
                edges = [(a["lo"], a["n"]) for a in asks if a["edge"]]
                spans = [(a["lo"], a["n"]) for a in asks if not a["edge"]]
                size = 0
                h1 = h2 = lo = np.zeros(0, np.int64)
                if edges:
                    codes = hashes(words)
                    lo = np.unique(np.concatenate([np.arange(a, a + n) for a, n in edges]))
                    h1 = Sums(codes).of(lo, lo + window).view(np.int64)
                    h2 = Sums(mix(codes ^ _U(_BASE))).of(lo, lo + window).view(np.int64)
                    size = len(lo)
                total = size + len(spans)
                empty = np.zeros(len(spans), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([True] * size + [False] * len(spans), pa.bool_()),
                        pa.array(np.concatenate([h1, empty])),
                        pa.array(np.concatenate([h2, empty])),
                        pa.array([doc_id] * total, kind),
                        pa.array(np.full(total, rid, np.int64)),
                        pa.array(np.concatenate([lo, np.array([s for s, _ in spans], np.int64)])),
                        pa.array(np.array([1] * size + [n for _, n in spans], np.int64)),
                        pa.array([None] * size + [digest(words[s : s + n + window - 1]) for s, n in spans], pa.binary()),
                    ],
                    names=["edge", "h1", "h2", "doc_id", "rid", "lo", "n", "digest"],
                )

    return tidy(run)


RESULT = "rid long, doc_id {kind}, n_words long, n_removed long, kept binary, kept_sha256 string, spans array<struct<start:long, stop:long>>"


def _remove(window: int, with_text: bool):
    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("n_words", "n_removed", "kept", "kept_sha256", "spans")}
            for i in range(batch.num_rows):
                words = _unpack(batch.column("packed")[i].as_py()).split()
                gone = np.zeros(len(words) + 1, np.int64)
                for s in batch.column("found")[i].as_py() or ():
                    lo, hi = s["lo"], s["lo"] + s["n"] + window - 1
                    if s["digest"] is None or digest(words[lo:hi]) == s["digest"]:
                        gone[lo] += 1
                        gone[hi] -= 1
                gone = (np.cumsum(gone)[:-1] > 0).astype(np.int8)
                kept = b" ".join([w for w, g in zip(words, gone) if not g]) if gone.any() else b" ".join(words)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["kept"].append(kept if with_text else None)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["spans"].append([{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), *[pa.array(v, k) for v, k in zip(out.values(), kinds)]],
                names=["rid", "doc_id", *out],
            )

    return tidy(run)


def repeats(rows: DataFrame, window: int = WINDOW, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """``(packed texts, spans to remove)`` of the rows of ``keyed``.

    Spans are ``(rid, lo, n, digest)``: n windows from word ``lo`` on, and the
    digest of the source's words (null where single edges were compared).
    """
    kind = dict(rows.dtypes)["doc_id"]
    packed = rows.mapInArrow(_pack, f"rid long, doc_id {kind}, packed binary")
    made = rows.mapInArrow(_paths(window, seed), PATHS.format(kind=kind))

    # Nonbranching: the first of each (anchor, content) is the source of the others.
    order = [F.col("doc_id").asc_nulls_first(), F.col("rid"), F.col("lo")]
    same = W.partitionBy("anchor", "content").orderBy(*order)
    first = F.first(F.struct("rid", "lo")).over(same)
    around = W.partitionBy("anchor")
    ranked = made.select(
        "*",
        first.alias("_src"),
        F.row_number().over(same).alias("_nth"),
        (F.min("content").over(around) != F.max("content").over(around)).alias("_branch"),
    )
    repeat = F.col("repeat") | (F.col("_nth") > 1)
    status = saved(
        ranked.where(repeat | F.col("_branch")).select(
            repeat.alias("repeat"),
            "doc_id",
            "rid",
            "lo",
            "n",
            F.when(F.col("repeat"), F.col("src_rid")).otherwise(F.col("_src.rid")).alias("src_rid"),
            F.when(F.col("repeat"), F.col("src_lo")).otherwise(F.col("_src.lo")).alias("src_lo"),
        ),
        "paths",
    )

    # Compaction: neighbouring repeats with neighbouring sources are one span.
    line = W.partitionBy("rid").orderBy("lo")
    ends = F.lag(F.col("lo") + F.col("n")).over(line)
    new = ~(
        ends.eqNullSafe(F.col("lo"))
        & F.lag("src_rid").over(line).eqNullSafe(F.col("src_rid"))
        & F.lag(F.col("src_lo") + F.col("n")).over(line).eqNullSafe(F.col("src_lo"))
    )
    runs = status.where("repeat").withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(line))
    runs = runs.groupBy("rid", "_run").agg(
        F.min("lo").alias("lo"), F.sum("n").alias("n"), F.min_by("src_rid", "lo").alias("src_rid"), F.min_by("src_lo", "lo").alias("src_lo")
    )
    runs = saved(runs.drop("_run"), "spans")

    # Ask the documents themselves: single edges at branches, digests at sources.
    asks = status.where("NOT repeat").select("rid", F.lit(True).alias("edge"), "lo", "n")
    asks = asks.unionByName(runs.select(F.col("src_rid").alias("rid"), F.lit(False).alias("edge"), F.col("src_lo").alias("lo"), "n").distinct())
    asks = asks.groupBy("rid").agg(F.collect_list(F.struct("edge", "lo", "n")).alias("asks"))
    answers = saved(packed.join(asks, "rid").mapInArrow(_answers(window), ANSWERS.format(kind=kind)), "answers")

    edges = answers.where("edge").select("h1", "h2", "doc_id", "rid", "lo")
    nth = F.row_number().over(W.partitionBy("h1", "h2").orderBy(*order))
    single = edges.withColumn("_nth", nth).where("_nth > 1").select("rid", "lo", F.lit(1).cast("long").alias("n"), F.lit(None).cast("binary").alias("digest"))
    digests = answers.where("NOT edge").select(F.col("rid").alias("src_rid"), F.col("lo").alias("src_lo"), "n", "digest")
    spans = runs.join(digests, ["src_rid", "src_lo", "n"]).select("rid", "lo", "n", "digest")
    return packed, spans.unionByName(single)


def dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """Each row of ``docs`` without the words of repeated windows.

    Returns ``rid, doc_id, n_words, n_removed, kept (bytes), kept_sha256,
    spans`` (removed word ranges).  A window counts as repeated if it also
    starts earlier: at a smaller ``doc_id`` (null first, then scan order), or
    earlier in the same document.  Null and empty texts have no words; a
    document shorter than a window keeps all; repeated rows lose their text to
    the first of them.  An empty table gives no rows.
    """
    rows = keyed(docs, doc_id, text)
    packed, spans = repeats(rows, window, seed)
    found = spans.groupBy("rid").agg(F.collect_list(F.struct("lo", "n", "digest")).alias("found"))
    kind = dict(rows.dtypes)["doc_id"]
    return packed.join(found, "rid", "left").mapInArrow(_remove(window, with_text), RESULT.format(kind=kind))


@query("op3_debruijn_dedup")
def op3(spark, sf_dir):
    """Words of all documents that are left after removing repeated 20-word windows."""
    out = dedup(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")
