"""Operator 8, near-duplicate detection by order MinHash.

A document's k-mers are its runs of ``SHINGLE`` words (A-Z lower-cased), each
labelled with its occurrence number so that repeats count.  Each of ``TABLES``
sketches takes the ``SAMPLED`` k-mers of lowest hash and keeps them in text
order, so documents agree in a sketch only if they share those k-mers *and*
their order: it estimates edit similarity, not set similarity.  Documents that
agree in a sketch are candidates.

A candidate pair is verified by banded alignment: the longest common
subsequence of the two word sequences, searched only as far from the diagonal
as similarity 0.8 allows, gives the k-mers that both have in the same order;
their share among all k-mers of both must be ``SIMILARITY`` or more.

Scale: texts of equal words are one node.  In a bucket each node is paired with
one hub, not with all others; linked groups then count as one component.  What
no hub has linked is compared in blocks: two blocks of a bucket are one row, and
a matrix product gives the k-mers that their documents share in any order.  In
a round each component takes, of its pairs with other components that share
enough, the likest; these are aligned, those that hold are merged and those that
fail are kept out of later rounds, which go on until no pair is left.  So no
link between components is left out, and a round aligns no more pairs than there
are components (``SLOTS``, ``SLOTS`` squared, ... times as many in later rounds,
which have what failed before).  Components are labels moved by joins; no links reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import keyed, only_rows, table, tidy
from pagelake.llm.registry import query
from pagelake.llm.substrings import Sums, hashes, mix
from pagelake.operators.numbering import saved

SHINGLE = 5
SIMILARITY = 0.8
TABLES = 16
SAMPLED = 3
BLOCK_KMERS = 250_000  # k-mers of a block of documents that are compared at once
BLOCK_DOCS = 1000  # and its documents
SLOTS = 16  # pairs that a component takes in a round, per pair of the round before
COLUMNS = 4096  # distinct k-mers of two blocks that are compared at once
BITMAPS = 8192  # bitmaps of 4 KiB that are brought to the rows at once
CHUNK = 1 << 19

_U = np.uint64
_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def kmers(codes: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the k-mers of one document; a shorter one is one k-mer."""
    n = len(codes)
    if not n:
        return np.zeros(0, _U)
    width = min(n, shingle)
    at = np.arange(n - width + 1)
    return Sums(codes).of(at, at + width)


def labelled(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """k-mer hashes with their occurrence number in the document mixed in."""
    key = values ^ mix(doc.astype(_U))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.ones(len(ranked), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    at = np.arange(len(ranked))
    nth = np.empty(len(ranked), np.int64)
    nth[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return mix(values + nth.astype(_U) * _U(0xD6E8FEB86659FD93))


def sketches(values: np.ndarray, sizes: np.ndarray, tables: int = TABLES, sampled: int = SAMPLED) -> np.ndarray:
    """One row of ``tables`` keys a document; ``values`` are labelled k-mers, ``sizes`` > 0."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = (np.arange(len(values)) - starts[doc]).astype(_U)
    high = _U(0xFFFFFFFF00000000)
    top = _U(0xFFFFFFFFFFFFFFFF)
    out = np.empty((len(sizes), tables), _U)
    for t in range(tables):
        # High half: order of the sketch; low half: place in the text.
        drawn = (mix(values ^ mix(np.array([t + 1], _U) * _U(0xA24BAED4963EE407))) & high) | place
        picks = []
        for _ in range(sampled):
            low = np.minimum.reduceat(drawn, starts)
            at = (low & ~high).astype(np.int64)
            none = low == top
            picks.append(np.where(none, -1, at))
            drawn[(starts + np.where(none, 0, at))[~none]] = top
        order = np.sort(np.array(picks), axis=0)
        key = np.full(len(sizes), t + 1, _U)
        for at in order:
            key = mix(key * _U(31) + np.where(at < 0, _U(0), values[starts + np.maximum(at, 0)]))
        out[:, t] = key
    return out


SKETCH = "rid long, doc_id {kind}, words binary, n long, keys array<long>"


def _sketch(shingle: int, tables: int, sampled: int):
    import xxhash

    def flush(held, out):
        sizes = np.array([len(k) for _, k in held])
        values = labelled(np.concatenate([k for _, k in held]), np.repeat(np.arange(len(sizes)), sizes))
        for (word_key, _), keys in zip(held, sketches(values, sizes, tables, sampled).view(np.int64)):
            out[word_key] = keys

    def run(batches):
        for batch in batches:
            named, size, held, have, known = [], {}, [], 0, {}
            for text in batch.column("text"):
                words = words_of(text.as_py())
                key = xxhash.xxh3_128_digest(b" ".join(words))
                named.append(key)
                if key in size:
                    continue  # a copy within the batch
                own = kmers(hashes(words), shingle)
                size[key] = len(own)
                if len(own):
                    held.append((key, own))
                    have += len(own)
                    if have > CHUNK:
                        flush(held, known)
                        held, have = [], 0
            if held:
                flush(held, known)
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid"),
                    batch.column("doc_id"),
                    pa.array(named, pa.binary()),
                    pa.array([size[k] for k in named], pa.int64()),
                    pa.array([known.get(k, none) for k in named], pa.list_(pa.int64())),
                ],
                names=["rid", "doc_id", "words", "n", "keys"],
            )

    return tidy(run)


def common_in_order(a: list, b: list, limit: int) -> list[tuple[int, int, int]] | None:
    """Matching runs (start in a, start in b, length) of an alignment of ``a`` and ``b``.

    Furthest-reaching paths by number of insertions and deletions; no path
    leaves the band of ``limit`` diagonals.  None if more edits are needed.
    """
    n, m = len(a), len(b)
    reach = {1: 0}
    trail = []
    for d in range(limit + 1):
        trail.append(dict(reach))
        for k in range(-d, d + 1, 2):
            if k < -m or k > n:
                continue
            if k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)):
                x = reach.get(k + 1, 0)
            else:
                x = reach[k - 1] + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            reach[k] = x
            if x >= n and y >= m:
                return _runs_back(trail, d, n, m)
    return None


def _runs_back(trail: list[dict], d: int, x: int, y: int) -> list[tuple[int, int, int]]:
    runs = []
    for step in range(d, -1, -1):
        reach, k = trail[step], x - y
        if step == 0:
            start_x = 0
        elif k == -step or (k != step and reach.get(k - 1, -1) < reach.get(k + 1, -1)):
            before = k + 1
            start_x = reach.get(before, 0)
        else:
            before = k - 1
            start_x = reach[before] + 1
        if x > start_x:
            runs.append((start_x, start_x - k, x - start_x))
        if step:
            px = reach.get(before, 0)
            x, y = px, px - before
    return runs[::-1]


def _shared(a: list, b: list, limit: int) -> list[tuple[int, int, int]] | None:
    """``common_in_order`` after the common start and end are taken off."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    mid = common_in_order(a[head : len(a) - tail], b[head : len(b) - tail], limit)
    if mid is None:
        return None
    runs = [(0, 0, head)] + [(x + head, y + head, n) for x, y, n in mid] + [(len(a) - tail, len(b) - tail, tail)]
    joined: list[tuple[int, int, int]] = []
    for x, y, n in runs:
        if not n:
            continue
        if joined and joined[-1][0] + joined[-1][2] == x and joined[-1][1] + joined[-1][2] == y:
            joined[-1] = (joined[-1][0], joined[-1][1], joined[-1][2] + n)
        else:
            joined.append((x, y, n))
    return joined


def similarity(a: np.ndarray, b: np.ndarray, shingle: int = SHINGLE, least: float = SIMILARITY) -> float:
    """Share of k-mers that two documents (word hashes) have in the same order.

    0 if it is below ``least``, without the full alignment.  Else the share in
    the words' shortest edit path, or where that falls short the greatest one:
    a value of ``least`` or more, given exactly if there is one.
    """
    ka, kb = kmers(a, shingle), kmers(b, shingle)
    total = len(ka) + len(kb)
    if not len(ka) or not len(kb) or min(len(ka), len(kb)) < least * max(len(ka), len(kb)):
        return 0.0
    need = least * total / (1 + least)  # common k-mers
    va, ca = np.unique(ka, return_counts=True)
    vb, cb = np.unique(kb, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if np.minimum(ca[ia], cb[ib]).sum() < need - 1e-9:
        return 0.0  # even in any order too few
    # An unmatched word costs at least one k-mer: the band.
    limit = int(total - 2 * need + 1e-9) + 1
    common = 0
    if min(len(a), len(b)) >= shingle:
        runs = _shared(a.tolist(), b.tolist(), limit)
        common = sum(max(0, n - shingle + 1) for _, _, n in runs or ())
    if common < need - 1e-9:  # the words may align in a way that keeps fewer k-mers
        runs = _shared(ka.tolist(), kb.tolist(), limit)
        common = sum(n for _, _, n in runs or ())
    share = common / (total - common)
    return share if share >= least - 1e-12 else 0.0


def components(links: DataFrame) -> DataFrame:
    """``(v, label)`` for each end of ``links(a, b)``: the smallest node it is connected to.

    Each round takes the least label of the labels around, in one shuffle; rounds
    grow with the logarithm of a component's extent.  Hot nodes are summed
    map-side and every round is a written table.
    """
    links = saved(links.select("a", "b"), "edges")
    edges = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = saved(edges.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("v"), F.least("a", "_m").alias("label")), "labels")
    while True:
        above = labels.select(F.col("v").alias("_v"), F.col("label").alias("_l"))
        jump = labels.join(above, F.col("label") == F.col("_v")).select("v", F.col("_l").alias("label"), F.col("label").alias("old"))
        around = edges.join(jump, edges["b"] == jump["v"]).select(F.col("a").alias("v"), "label", F.lit(None).cast("long").alias("old"))
        new = saved(jump.unionByName(around).groupBy("v").agg(F.min("label").alias("label"), F.max("old").alias("old")), "labels")
        if new.where("label <> old").isEmpty():
            return new.select("v", "label")
        labels = new.select("v", "label")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar, with the similarity.

    The text of ``a`` (often a hub) is brought to each pair, then the pairs to
    ``b``: Spark may split the pairs of a hot hub, none is gathered.
    """
    import zstandard

    @F.pandas_udf("double")
    def align(left: pd.Series, right: pd.Series) -> pd.Series:
        unpack = zstandard.ZstdDecompressor().decompress
        read = lambda p: hashes(unpack(p).split())
        return pd.Series([similarity(read(x), read(y), shingle, least) for x, y in zip(left, right)], dtype="float64")

    left = texts.select(F.col("rid").alias("a"), F.col("packed").alias("left"))
    right = texts.select(F.col("rid").alias("b"), F.col("packed").alias("right"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", align("left", "right").alias("similarity"))
    return saved(scored.where(F.col("similarity") >= least), "links")


def _signatures(shingle: int):
    """Labelled k-mers of packed texts, halved to 32 bits, and how many of them coincide with another."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out, lost = [], []
            for packed in batch.column("packed"):
                own = kmers(hashes(unpack(packed.as_py()).split()), shingle)
                halved = (labelled(own, np.zeros(len(own), np.int64)) >> _U(32)).astype("<u4")
                out.append(halved.tobytes())
                lost.append(len(halved) - len(np.unique(halved)))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(out, pa.binary()), pa.array(lost, pa.int64())], names=["node", "kmers", "lost"])

    return tidy(run)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of each left and right set, by matrix products."""
    both = [np.concatenate(x) if x else np.zeros(0, "<u4") for x in (left, right)]
    common = np.intersect1d(*both)
    total = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for sets, flat in zip((left, right), both):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(common, flat)
        keep = at < len(common)
        keep[keep] = common[at[keep]] == flat[keep]
        order = np.argsort(at[keep], kind="stable")
        sides.append((at[keep][order], row[keep][order]))
    for lo in range(0, len(common), COLUMNS):
        parts = []
        for sets, (col, row) in zip((left, right), sides):
            i, j = np.searchsorted(col, [lo, lo + COLUMNS])
            m = np.zeros((len(sets), min(COLUMNS, len(common) - lo)), np.float32)
            m[row[i:j], col[i:j] - lo] = 1
            parts.append(m)
        total += parts[0] @ parts[1].T
    return total


def _best_pairs(least: float, slots: int):
    """Of the pairs of different components in two blocks whose texts share enough k-mers in any order: the likest.

    One for each component and each of ``slots`` slots, which pairs are dealt to by hash.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                sides = [batch.column(c)[i].as_py() for c in ("left", "right")]
                sets = [[np.frombuffer(m["kmers"], "<u4") for m in side] for side in sides]
                node, label, n, lost = ([np.array([m[c] for m in side], np.int64) for side in sides] for c in ("node", "label", "n", "lost"))
                common = shared_counts(*sets)
                total = n[0][:, None] + n[1][None, :]
                # K-mers of one set whose halved hashes coincide count once; a pair has lost no
                # more of its common ones than the set with fewer of them has.
                enough = common + np.minimum(lost[0][:, None], lost[1][None, :]) >= least / (1 + least) * total - 1e-9
                enough &= label[0][:, None] != label[1][None, :]
                for side, other, grid in ((0, 1, enough), (1, 0, enough.T)):
                    for at, m in enumerate(sides[side]):
                        if m["refused"]:
                            grid[at] &= ~np.isin(node[other], m["refused"])
                x, y = np.nonzero(enough)
                a, b = np.minimum(node[0][x], node[1][y]), np.maximum(node[0][x], node[1][y])
                share = common[x, y].astype(np.float64) / total[x, y]
                slot = (mix(mix(a.astype(_U)) ^ b.astype(_U)) % _U(slots)).astype(np.int64)
                for own in (label[0][x], label[1][y]):
                    order = np.lexsort((b, a, share, slot, own))
                    last = np.ones(len(order), bool)
                    last[:-1] = (own[order][1:] != own[order][:-1]) | (slot[order][1:] != slot[order][:-1])
                    best = order[last]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v[best]) for v in (own, slot, share, a, b)], names=["label", "slot", "share", "a", "b"]
                    )

    return tidy(run)


def signed(inside: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Signatures of the nodes that share a bucket with another component."""
    spread = inside.groupBy("t", "key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo <> _hi")
    open_nodes = inside.join(spread, ["t", "key"]).select(F.col("node").alias("rid")).distinct()
    signatures = texts.join(open_nodes, "rid", "left_semi").mapInArrow(_signatures(shingle), "node long, kmers binary, lost long")
    return saved(signatures, "signatures")


def across_components(inside: DataFrame, signatures: DataFrame, refused: DataFrame | None, least: float, slots: int = 1) -> DataFrame:
    """Candidate pairs (label, a, b) between components that share a bucket: the likest of each component ``label`` and slot.

    ``inside`` has (t, key, node, n, label).  Buckets of one component are left
    out, and so are the pairs ``refused(a, b)``.  A bucket is dealt by hash into
    blocks of about ``BLOCK_KMERS`` k-mers or ``BLOCK_DOCS`` documents, and each
    two of its blocks are one row.  A component without a row has no such pair.
    """
    parts = F.ceil(F.greatest(F.sum("n") / BLOCK_KMERS, F.count(F.lit(1)) / BLOCK_DOCS))
    spread = inside.groupBy("t", "key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), parts.alias("_blocks"))
    members = inside.join(spread.where("_lo <> _hi"), ["t", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")))
    known = signatures
    if refused is None:
        known = known.withColumn("refused", F.lit(None).cast("array<long>"))
    else:
        known = known.join(refused.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("refused")), "node", "left")
    docs = F.collect_list(F.struct("node", "n", "label", "kmers", "lost", "refused")).alias("docs")
    blocks = saved(members.join(known, "node").groupBy("t", "key", "block").agg(docs), "blocks")
    left = blocks.select("t", "key", F.col("block").alias("x"), F.col("docs").alias("left"))
    right = blocks.select("t", "key", F.col("block").alias("y"), F.col("docs").alias("right"))
    # Both sides come straight from a written table, so Spark may split a hot bucket.
    rows = left.join(right, ["t", "key"]).where("x <= y").select("left", "right")
    found = rows.mapInArrow(_best_pairs(least, slots), "label long, slot long, share double, a long, b long")
    best = found.groupBy("label", "slot").agg(F.max(F.struct("share", "a", "b")).alias("_best"))
    return saved(best.select("label", "_best.a", "_best.b"), "likest")


@tidy
def _pack(batches):
    import zstandard

    tool = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [tool.compress(b" ".join(words_of(t.as_py()))) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(packed, pa.binary())], names=["rid", "packed"])


def chosen(rows: DataFrame, rids: DataFrame) -> DataFrame:
    """The ``rows`` whose ``rid`` is in ``rids(rid)``, without a shuffle of their texts.

    The row keys travel as bitmaps, one of 4 KiB for each 32,768 rows of a scan
    partition, and every row looks up its own bit.  More than ``BITMAPS`` of them
    would weigh on the driver; both sides are then dealt by row key.
    """
    bucket, place = F.bitmap_bucket_number("rid"), F.bitmap_bit_position("rid")
    # Dealt by bucket first: a bucket's bits are set in one task, no half-empty bitmaps are shuffled.
    bits = rids.select(bucket.alias("_bucket"), place.alias("_place")).repartition("_bucket")
    bits = saved(bits.groupBy("_bucket").agg(F.bitmap_construct_agg("_place").alias("_bits")), "chosen")
    if bits.count() > BITMAPS:
        return rows.join(rids, "rid", "left_semi")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3).cast("int") + 1, 1)), 16, 10).cast("int")
    found = rows.join(F.broadcast(bits), bucket == F.col("_bucket")).where(F.getbit(byte, place % 8) == 1)
    return found.select(*rows.columns)


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    least: float = SIMILARITY,
    tables: int = TABLES,
    sampled: int = SAMPLED,
    doc_id: str = "doc_id",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """``(classes, links)`` of all documents.

    ``classes`` has one row a document: rid, doc_id, class_id (the smallest
    doc_id of its class), class_size, kept (one row of each class: that of the
    smallest doc_id, null last, then scan order).  ``links`` are the verified
    pairs (a, b, similarity) of class representatives, by rid, that connect the
    classes.

    Documents of the same words are always of one class; one without words
    (null, empty, white space) is alone.  Repeated rows are documents of their
    own; null ids never name a class unless all of it is null.
    """
    rows = keyed(docs, doc_id, text)
    kind = dict(rows.dtypes)["doc_id"]
    sketch = saved(rows.mapInArrow(_sketch(shingle, tables, sampled), SKETCH.format(kind=kind)), "sketches")

    # Nodes: distinct word sequences, named by their smallest rid.
    nodes = sketch.where("n > 0").groupBy("words").agg(F.min("rid").alias("node"), F.min_by("keys", "rid").alias("keys"), F.min_by("n", "rid").alias("n"))
    nodes = saved(nodes, "nodes")
    entries = nodes.select("node", "n", F.posexplode("keys").alias("t", "key"))
    shared = saved(entries.groupBy("t", "key").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("t", "key"), "buckets")
    members = saved(entries.join(shared, ["t", "key"]), "members")
    wanted = members.select(F.col("node").alias("rid")).distinct()
    texts = saved(chosen(rows, wanted).mapInArrow(_pack, "rid long, packed binary"), "texts")

    # The hub of a bucket is its smallest node.
    hubs = members.groupBy("t", "key").agg(F.min(F.struct("node", "n")).alias("hub"))
    pairs = members.join(hubs, ["t", "key"]).where(F.col("node") != F.col("hub.node"))
    # k-mer counts further apart than this cannot be similar enough.
    pairs = pairs.where(F.least("n", "hub.n") >= least * F.greatest("n", "hub.n"))
    pairs = pairs.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
    links = labels = refused = signatures = None
    turn = 0
    while True:
        pairs = saved(pairs, "pairs")
        if turn and pairs.isEmpty():
            break
        found = _verified(pairs, texts, shingle, least)
        # Components so far are stars around their labels: no link is walked twice.
        edges = found.select("a", "b")
        labels = components(edges if labels is None else edges.unionByName(labels.select(F.col("label").alias("a"), F.col("v").alias("b"))))
        links = found if links is None else links.unionByName(found)
        inside = members.join(labels, members["node"] == labels["v"], "left").select(*members.columns, F.coalesce("label", "node").alias("label"))
        if signatures is None:
            signatures = signed(inside, texts, shingle)
        else:
            failed = pairs.join(found, ["a", "b"], "left_anti")
            refused = failed if refused is None else refused.unionByName(failed)
        likest = across_components(inside, signatures, refused, least, SLOTS**turn)
        # Only components that had a pair to take can have one after they are merged.
        members = saved(inside.join(likest.select("label").distinct(), "label", "left_semi").select(members.columns), "members")
        pairs = likest.select("a", "b").distinct()
        turn += 1

    known = sketch.select("rid", "doc_id", "words", "n")
    named = known.where("n > 0").join(nodes.select("words", "node"), "words").select("rid", "doc_id", "node")
    alone = known.where("n = 0").select("rid", "doc_id", F.col("rid").alias("node"))
    named = named.join(labels, named["node"] == labels["v"], "left").select("rid", "doc_id", F.coalesce("label", "node").alias("node"))
    placed = saved(named.unionByName(alone), "placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("rid"))).alias("first")
    classes = saved(placed.groupBy("node").agg(first, F.count(F.lit(1)).alias("class_size")), "classes")
    out = placed.join(classes, "node").select(
        "rid", "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("rid") == F.col("first.rid")).alias("kept")
    )
    return out, links


def survivors(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, all columns of ``docs``."""
    classes, _ = near_duplicates(docs, **options)
    return only_rows(docs, classes.where("kept").select("rid"))


@query("op8_order_minhash")
def op8(spark, sf_dir):
    """Class of near duplicates of every document."""
    classes, _ = near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "class_size", "kept")
