import itertools
import zlib
from collections import Counter

from pyspark.sql import functions as F

from pagelake.llm import hilbert

from .helpers import empty, frame, rows


def curve(spark, n, bits):
    grid = list(itertools.product(range(1 << bits), repeat=n))
    names = [f"x{i}" for i in range(n)]
    df = spark.createDataFrame(grid, ", ".join(f"{c} int" for c in names))
    out = df.select(*names, hilbert.hilbert_index([F.col(c) for c in names], bits).alias("h")).collect()
    return sorted((r.h, tuple(r[c] for c in names)) for r in out)


def test_curve_visits_every_cell_in_unit_steps(spark):
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        walk = curve(spark, n, bits)
        assert [h for h, _ in walk] == list(range(1 << (n * bits)))
        for (_, a), (_, b) in zip(walk, walk[1:]):
            assert sum(abs(x - y) for x, y in zip(a, b)) == 1


def test_shards_even_and_gapless(spark):
    data = [(i, f"t{i % 5}", "en" if i % 3 else None, "hot" if i % 3 else f"s{i % 7}", 1, None, None) for i in range(1003)]
    out = hilbert.shard_documents(frame(spark, data), 40).collect()
    assert len(out) == 1003
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(40):
        mine = sorted((r.slot, r.curve) for r in out if r.shard == s)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert [m[1] for m in mine] == sorted(m[1] for m in mine)
    runs = sorted((r.shard, r.slot, r.curve) for r in out)
    assert [r[2] for r in runs] == sorted(r[2] for r in runs)


def test_awkward_rows(spark):
    df = frame(spark)
    out = hilbert.shard_documents(df, 4).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in out) == want
    few = hilbert.shard_documents(df.limit(3), 40).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert hilbert.shard_documents(empty(spark)).count() == 0
    assert hilbert.shard_documents(df.select("doc_id", "text")).count() == len(rows())


def test_written_files_prune(spark, tmp_path):
    hilbert.write_shards(frame(spark), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows())
    # The rows have a column named shard: the folders take another name.
    assert {r.shard_ for r in back.select("shard_").distinct().collect()} == {0, 1, 2, 3}


def test_files_to_read_for_one_value(spark, tmp_path):
    """By minimum and maximum of each file: a source, a language or a size needs few of the shards."""
    data = [(i, "w " * (i * 7919 % 2000), ["de", "en", "es", "fr", None][i * 31 % 5], f"src{i * 17 % 20}", None, None, None) for i in range(4000)]
    hilbert.write_shards(frame(spark, data).drop("shard"), str(tmp_path / "out"), 40)
    files = spark.read.parquet(str(tmp_path / "out")).groupBy("shard").agg(
        *[f(c).alias(f"{c}_{n}") for c in ("source", "lang") for n, f in (("lo", F.min), ("hi", F.max))]
    ).collect()
    assert len(files) == 40
    read = lambda c, v: sum(r[f"{c}_lo"] is not None and r[f"{c}_lo"] <= v <= r[f"{c}_hi"] for r in files)
    assert sum(read("source", f"src{i}") for i in range(20)) / 20 <= 14
    assert sum(read("lang", v) for v in ("de", "en", "es", "fr")) / 4 <= 20
