"""Operator 11, embedding whitening by QDWH spectral divide-and-conquer.

The covariance of the distinct quantised vectors is summed in Spark, a partial
product a task.  Its eigenvectors come from polar decompositions: the
orthogonal polar factor U of the shifted matrix V - sI is its sign, so (U + I)/2
projects on the components above s.  The two invariant subspaces are split again
in the same way until single components are left (or subspaces in which all
components are equal).  Polar factors are found by the dynamically weighted
Halley iteration, QR steps first and Cholesky steps once it is well conditioned.

Scale: vectors are read in four passes, and only the distinct ones are shuffled
and written, in the narrowest integers that hold them.  The driver sees sums and
products of the dimensions, never rows: its work depends on the dimension only.
What is broadcast is the mean and a dimension-by-components matrix.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from pagelake.llm.common import table, tidy
from pagelake.llm.registry import query
from pagelake.operators.numbering import saved

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
LARGEST = float(1 << 62)  # an entry beyond it has no long
BLOCK = 1 << 12  # vectors whose products are summed at once

_EPS = np.finfo(float).eps


# --------------------------------------------------------------------------
# Spectral divide-and-conquer
# --------------------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix (QDWH)."""
    x = a / np.linalg.norm(a)
    n, low = x.shape[0], _EPS
    for _ in range(20):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        u = root + np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root)) / 2
        v = (u - 1) ** 2 / 4
        w = u + v - 1
        if w > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(w) * x, np.eye(n)]))
            new = (v / w) * x + (u - v / w) / np.sqrt(w) * (q[:n] @ q[n:].T)
        else:
            c = np.linalg.cholesky(np.eye(n) + w * (x.T @ x))
            half = np.linalg.solve(c, x.T)
            new = (v / w) * x + (u - v / w) * np.linalg.solve(c.T, half).T
        low = min(1.0, low * (u + v * low**2) / (1 + w * low**2))
        step = np.linalg.norm(new - x)
        x = new
        if step <= np.cbrt(5 * _EPS) and abs(1 - low) <= 10 * _EPS:
            break
    return x


def _halves(a: np.ndarray):
    """Orthonormal bases of the invariant subspaces above and below a shift; None if all components are equal."""
    n = a.shape[0]
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    # The mean lies between the extremes, the median splits more evenly.  A shift
    # that hits a component gives no projector; the next one is a little off.
    for shift in (np.median(np.diag(a)), mean, *(mean + spread * t for t in (0.05, -0.05, 0.17, -0.17, 0.41, -0.41, 0.71, -0.71))):
        sign = polar(a - shift * np.eye(n))
        sign = (sign + sign.T) / 2
        above = int(round((n + np.trace(sign)) / 2))
        if not 0 < above < n or np.linalg.norm(sign @ sign - np.eye(n)) > 1e-10 * n:
            continue
        projector = (sign + np.eye(n)) / 2
        start = projector @ np.random.default_rng(n).standard_normal((n, above))
        basis, _ = np.linalg.qr(start)
        basis, _ = np.linalg.qr(projector @ basis, mode="complete")
        return basis[:, :above], basis[:, above:]
    return None


def spectrum(a: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    values, vectors, left = [], [], min(top, a.shape[0])
    floor = _EPS * np.linalg.norm(a)
    parts = [(a, np.eye(a.shape[0]))]  # matrix in a subspace, the subspace; the highest last
    while left > 0 and parts:
        m, basis = parts.pop()
        n = m.shape[0]
        halves = None
        if n > 1 and np.linalg.norm(m - np.trace(m) / n * np.eye(n)) > floor * n:
            halves = _halves(m)
        if halves is None:
            take = min(left, n)
            values += np.diag(m)[:take].tolist()
            vectors += [basis[:, i] for i in range(take)]
            left -= take
            continue
        for half in reversed(halves):
            inner = half.T @ m @ half
            parts.append(((inner + inner.T) / 2, basis @ half))
    if not vectors:
        return np.zeros(0), np.zeros((a.shape[0], 0))
    vectors = np.linalg.qr(np.column_stack(vectors))[0]
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    # One sign for all: the largest entry of a component is positive.
    flip = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])])
    return values, vectors * flip


# --------------------------------------------------------------------------
# Vectors
# --------------------------------------------------------------------------


def _clean(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``(rows, lists)``: numbers of the rows whose vector is whole, and these vectors."""
    rows = np.flatnonzero(np.asarray(column.is_valid()))
    lists = column.take(pa.array(rows))
    sizes = np.asarray(pc.list_value_length(lists), np.int64)
    entries = np.asarray(pc.fill_null(pc.list_flatten(lists), float("nan")), float)
    bad = ~(np.abs(entries) * SCALE < LARGEST)  # also what is not finite
    holds = np.bincount(np.repeat(np.arange(rows.size), sizes)[bad], minlength=rows.size) > 0
    keep = np.flatnonzero(~holds)
    return rows[keep], lists.take(pa.array(keep))


def _quantised(lists: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the vectors of that dimension, and ``x - OFFSET`` of each as a row of longs."""
    at = np.flatnonzero(np.asarray(pc.list_value_length(lists), np.int64) == dimension)
    entries = np.asarray(pc.list_flatten(lists.take(pa.array(at))), float)
    return at, np.floor(entries * SCALE).astype(np.int64).reshape(at.size, dimension)


def _packed(y: np.ndarray) -> list[bytes]:
    """Each row in the narrowest integers that hold it, so that equal rows have equal bytes."""
    out = [b""] * len(y)
    most = np.maximum(y.max(axis=1), -y.min(axis=1) - 1)
    done = np.zeros(len(y), bool)
    for kind in (np.int8, np.int16, np.int32, np.int64):
        fits = np.flatnonzero(~done & (most <= np.iinfo(kind).max))
        narrow = y[fits].astype(kind)
        for i, row in zip(fits.tolist(), narrow):
            out[i] = row.tobytes()
        done[fits] = True
    return out


def _unpacked(column: pa.Array, dimension: int):
    """Blocks of rows of longs."""
    rows: list[np.ndarray] = []
    for value in column:
        raw = value.as_buffer()
        rows.append(np.frombuffer(raw, f"i{raw.size // dimension}"))
        if len(rows) == BLOCK:
            yield np.array(rows, np.int64)
            rows = []
    if rows:
        yield np.array(rows, np.int64)


def _lengths(batches):
    counts: dict[int, int] = {}
    for batch in batches:
        _, lists = _clean(batch.column(0))
        for size, n in zip(*np.unique(np.asarray(pc.list_value_length(lists), np.int64), return_counts=True)):
            counts[int(size)] = counts.get(int(size), 0) + int(n)
    yield pa.RecordBatch.from_pydict({"size": pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})


def _fit_rows(dimension: int):
    def run(batches):
        for batch in batches:
            _, lists = _clean(batch.column(0))
            _, y = _quantised(lists, dimension)
            yield pa.RecordBatch.from_pydict({"y": pa.array(_packed(y) if len(y) else [], pa.binary())})

    return tidy(run)


def _sums(dimension: int):
    def run(batches):
        n, total = 0, np.zeros(dimension, np.int64)
        for batch in batches:
            for y in _unpacked(batch.column(0), dimension):
                n += len(y)
                total += y.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dimension), pa.int64()), "n": pa.array([n] * dimension, pa.int64()), "s": pa.array(total)})

    return tidy(run)


def _products(dimension: int, mean: np.ndarray, matrix: np.ndarray | None = None):
    """Upper triangle of the sum of z z', z the centred vector (times ``matrix``), as (i, j, v)."""

    def run(batches):
        size = dimension if matrix is None else matrix.shape[1]
        total = np.zeros((size, size))
        for batch in batches:
            for y in _unpacked(batch.column(0), dimension):
                z = y - mean
                z = z if matrix is None else z @ matrix
                total += z.T @ z
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "v": pa.array(total[i, j])})

    return tidy(run)


def _covariance(fit: DataFrame, n: int, size: int, run) -> np.ndarray:
    """The sum of all tasks' products over n; ``size`` x ``size`` numbers reach the driver."""
    out = np.zeros((size, size))
    for row in fit.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[row.i, row.j] = out[row.j, row.i] = row.v / n
    return out


@dataclass(frozen=True)
class Whitener:
    """What whitening needs to know of the fit list; ``matrix`` maps a centred vector to its components."""

    dimension: int
    n: int
    sums: np.ndarray  # of x - OFFSET, exact
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def train(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> Whitener | None:
    """Fit on the distinct quantised vectors; None if there are none or all are one."""
    vectors = rows.select(F.col(f"`{vector}`").cast("array<double>").alias("v"))
    sizes = vectors.mapInArrow(_lengths, "size long, n long").groupBy("size").agg(F.sum("n").alias("n"))
    common = sizes.where("size > 0").orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not common:
        return None
    dimension = common[0]["size"]
    fit = saved(vectors.mapInArrow(_fit_rows(dimension), "y binary").distinct(), "whitening-fit")
    told = fit.mapInArrow(_sums(dimension), "i long, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    n, sums = told[0]["n"], np.array([r["s"] for r in told], np.int64)
    mean = np.array([float(Fraction(int(s), n)) for s in sums])
    covariance = _covariance(fit, n, dimension, _products(dimension, mean))
    trace = float(np.trace(covariance))
    values, parts = spectrum(covariance, components)
    # A component without variance cannot be whitened.
    real = values > max(values.max(initial=0) * _EPS * dimension, 0)
    values, parts = values[real], parts[:, real]
    if not values.size:
        return None
    matrix = parts / np.sqrt(values)
    white = _covariance(fit, n, values.size, _products(dimension, mean, matrix))
    error = float(np.abs(white - np.eye(values.size)).max())
    return Whitener(dimension, n, sums, mean, values, parts, values / trace, error)


def _whitened(model: Whitener, schema: pa.Schema):
    k = model.values.size

    def run(batches):
        matrix = model.matrix
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                rows, lists = _clean(some.column(1))
                own, y = _quantised(lists, model.dimension)
                if not own.size:
                    continue
                ids = some.column(0).take(pa.array(np.repeat(rows[own], k)))
                # 64-bit wrap-around is harmless: all terms are squares, so if the sum fits, its terms do.
                away = ((model.n * y - model.sums) ** 2).sum(axis=1)
                white = (y - model.mean) @ matrix
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), own.size)),
                        pa.array(np.full(own.size * k, model.n)),
                        pa.array(np.repeat(away, k)),
                        pa.array(white.ravel()),
                        pa.array(np.tile(model.explained, own.size)),
                        pa.array(np.full(own.size * k, model.identity_error)),
                    ],
                    schema=schema,
                )

    return tidy(run)


def whiten(rows: DataFrame, model: Whitener | None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector and component: ``(vec_id, component, n, deviation, whitened, explained, identity_error)``.

    Vectors that are null, empty, hold a null, a number that is not finite or one
    whose quantised value is no long, or are not of the table's usual dimension (the
    most frequent one, the larger in a tie) are left out.  Ids may be null or
    repeated; equal vectors count once in the fit and each have their rows here.
    Components that have no variance are not numbered, so a table with fewer than
    two distinct vectors, or none, gives no rows.  Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    given = rows.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    schema = StructType(
        [
            given.schema["vec_id"],
            StructField("component", IntegerType()),
            StructField("n", LongType()),
            StructField("deviation", LongType()),
            StructField("whitened", DoubleType()),
            StructField("explained", DoubleType()),
            StructField("identity_error", DoubleType()),
        ]
    )
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    return given.mapInArrow(_whitened(model, to_arrow_schema(schema)), schema)


@query("op11_qdwh_whitening")
def op11(spark, sf_dir):
    """All embeddings on the first 16 components."""
    rows = table(spark, sf_dir, "embeddings")
    return whiten(rows, train(rows))
