"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance matrix is never formed: the fit only ever asks for V Q, the covariance times a narrow block, which every
task sums as Xᵀ(XQ) over its centred rows and Spark adds up. A block of a few more columns than wanted components is
filtered by a Chebyshev polynomial of V that stays small on the unwanted part of the spectrum and grows fast above it,
is made orthonormal by QR and turned to eigenvectors by Rayleigh-Ritz. This goes on until the residuals of all wanted
pairs are as small as double precision allows. The unwanted part runs from a lower bound of the whole spectrum, found
from two steps of block Lanczos, to the smallest Ritz value of the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.session import stage

# Fixed values of the contract: an entry c becomes floor(1024 * c) + 100000.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
SPARE = 16  # columns of the block beyond the wanted components
DEGREE = 8
CERTIFIED, STALLED = 1e-13, 1e-10  # residuals against the largest eigenvalue
ROUNDS = 400
LARGEST = float(1 << 52)  # of |1024 * c|: whole numbers beyond are no longer exact
CELLS = 1 << 20  # numbers held as one matrix


@dataclass(frozen=True)
class Whitening:
    """Fitted numbers. ``axes`` has one unit eigenvector per column, by falling eigenvalue."""

    dims: int
    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    passes: int

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part and remaining fraction of the means: x less the first is exact."""
        return _centre(self.sums, self.n)

    @property
    def scaled(self) -> np.ndarray:
        return self.axes / np.sqrt(self.values)


def _centre(sums, n):
    return np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])


def _matrix(column, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, values) of the lists that have ``dims`` finite entries of usable size."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    starts = column.offsets.to_numpy()
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(starts) == dims))
    entries = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a NULL entry is a NaN
    values = entries[starts[rows][:, None] + np.arange(dims)]
    with np.errstate(invalid="ignore"):
        fine = (np.isfinite(values) & (np.abs(values) * SCALE <= LARGEST)).all(1)
    return rows[fine], values[fine]


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """Stage table (id, x) of the fit list, and its dimension.

    Left out are vectors that are NULL, empty, hold NULL, NaN or infinite entries or entries beyond 2^42 (whose whole
    numbers are not exact as doubles), and those whose length is not the commonest one (of equally common ones the
    smaller). Ids may be NULL or repeat: every row counts.
    """
    slim = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    lengths = slim.select(F.size("v").alias("d")).where("d > 0").groupBy("d").count()
    commonest = lengths.orderBy(F.desc("count"), "d").first()
    dims = commonest["d"] if commonest else 0
    fields = T.StructType([T.StructField("id", rows.schema[id_col].dataType), T.StructField("x", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            step = max(1, CELLS // max(dims, 1))
            for at in range(0, batch.num_rows if dims else 0, step):
                piece = batch.slice(at, step)
                kept, values = _matrix(piece.column(1), dims)
                x = np.floor(values * SCALE).astype(np.int64) + SHIFT
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * dims, pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(kept)), lists], names=["id", "x"])

    return stage(slim.mapInArrow(run, fields), "whole"), dims


def _blocks(batches, dims: int, column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the stage table, each with its whole numbers as a matrix of bounded size."""
    for batch in batches:
        step = max(1, CELLS // dims)
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            yield piece, piece.column(piece.schema.get_field_index(column)).flatten().to_numpy().reshape(-1, dims)


def _sums(vectors: DataFrame, dims: int) -> tuple[int, tuple[int, ...]]:
    """Rows and exact sum of every dimension."""
    def run(batches):
        n, total = 0, [0] * dims
        for _, x in _blocks(batches, dims):
            high, low = x >> 26, x & ((1 << 26) - 1)
            n += len(x)
            total = [t + (int(h) << 26) + int(w) for t, h, w in zip(total, high.sum(0), low.sum(0))]
        yield pa.RecordBatch.from_arrays([
            pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()),
            pa.array(total, pa.decimal128(38, 0)),
        ], names=["d", "n", "s"])

    found = vectors.select("x").mapInArrow(run, "d int, n bigint, s decimal(38,0)")
    rows = sorted(found.groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())
    return (rows[0]["n"], tuple(int(r["s"]) for r in rows)) if rows else (0, (0,) * dims)


def _added(vectors: DataFrame, dims: int, shape: tuple[int, int], product) -> np.ndarray:
    """Sum over all rows of ``product`` (a matrix of ``shape`` for each block of centred rows).

    A task sends one row per cell of its sum; Spark adds them up, so the driver gets one matrix whatever the number of
    tasks.
    """
    def run(batches):
        total = np.zeros(shape)
        for _, x in _blocks(batches, dims):
            total += product(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.reshape(-1))], names=["cell", "s"])

    cells = vectors.select("x").mapInArrow(run, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).toArrow()
    found = np.zeros(shape[0] * shape[1])
    found[cells["cell"].to_numpy()] = cells["s"].to_numpy()
    return found.reshape(shape)


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS, spare: int = SPARE, degree: int = DEGREE,
        seed: int = 13) -> Whitening | None:
    """Leading eigenvectors of the covariance (divisor n) of a ``whole_vectors`` table.

    Eigenvalues that rounding cannot tell from zero have no component, so equal or few vectors give fewer than asked;
    None if there are no vectors, or only equal ones. Raises if the residuals do not come down.
    """
    n, sums = _sums(vectors, dims) if dims else (0, ())
    if not n:
        return None
    whole, part = _centre(sums, n)
    passes = 0

    def times(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def product(x):
            centred = (x - whole) - part
            return centred.T @ (centred @ block)

        return _added(vectors, dims, block.shape, product) / n

    trace = float(_added(vectors, dims, (dims, 1), lambda x: np.square((x - whole) - part).sum(0)[:, None]).sum()) / n
    if not trace:
        return None
    width = min(dims, components + spare)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, width)))[0]
    image = times(block)
    low = _lower_bound(block, image, times) if width < dims else 0.0
    last = np.inf
    for _ in range(ROUNDS):
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        wanted = min(components, width)
        residual = float(np.linalg.norm(image - block * values, axis=0)[:wanted].max() / values[0])
        if residual <= CERTIFIED or width == dims or (residual <= STALLED and residual > last / 2):
            break
        last = residual
        low = min(low, values[-1])
        block = np.linalg.qr(_filtered(block, image, times, low, values[-1], values[0], degree))[0]
        image = times(block)
    else:
        raise RuntimeError(f"{ROUNDS} rounds left a residual of {residual:.1e}")
    wanted = int((values[:wanted] > 16 * dims * np.finfo(float).eps * values[0]).sum())
    axes = block[:, :wanted]
    signs = np.sign(axes[np.abs(axes).argmax(0), range(wanted)])
    return Whitening(dims, n, sums, axes * signs, values[:wanted], trace, residual, passes)


def _lower_bound(block: np.ndarray, image: np.ndarray, times) -> float:
    """The smallest Ritz value of two block Lanczos steps less its residual, not below zero."""
    more, _ = np.linalg.qr(image - block @ (block.T @ image))
    more, _ = np.linalg.qr(more - block @ (block.T @ more))
    both, image = np.hstack([block, more]), np.hstack([image, times(more)])
    small = both.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    residual = np.linalg.norm(image @ turn[:, 0] - both @ turn[:, 0] * values[0])
    return max(0.0, float(values[0] - residual))


def _filtered(block, image, times, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """Chebyshev polynomial of the covariance, small on [low, high], applied to the block and scaled to one at ``top``.

    ``image`` is the covariance times the block; each further degree is one pass over the rows.
    """
    half = max((high - low) / 2, np.finfo(float).eps * top)
    middle = (high + low) / 2
    first = half / max(top - middle, half)
    ratio = first
    before, now = block, (image - middle * block) * (first / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - ratio)
        before, now = now, (times(now) - middle * now) * (2 * following / half) - (ratio * following) * before
        ratio = following
    return now


def whitened(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened): every vector's exact sum of (n * x - S)^2 and its whitened coordinates."""
    whole, part = model.centre
    scaled, n, dims = model.scaled, model.n, model.dims
    remainder = np.array([s % n for s in model.sums], np.int64)
    fields = T.StructType([
        vectors.schema["id"], T.StructField("deviation", T.DecimalType(38, 0)),
        T.StructField("whitened", T.ArrayType(T.DoubleType())),
    ])

    def run(batches):
        for piece, x in _blocks(batches, dims):
            off = x - whole
            coordinates = (off - part) @ scaled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * scaled.shape[1], pa.int32()), pa.array(coordinates.reshape(-1)))
            yield pa.RecordBatch.from_arrays([piece.column(0), _deviations(off, n, remainder), lists], names=fields.names)

    return vectors.select("id", "x").mapInArrow(run, fields)


def _deviations(off: np.ndarray, n: int, remainder: np.ndarray) -> pa.Array:
    """Exact sums of squares of n * off - remainder, in 64 bits where they fit, else in Python's integers."""
    most = (int(np.abs(off).max(initial=0)) + 1) * n
    if off.shape[1] * most**2 < 1 << 63:
        return pa.array(np.square(off * n - remainder).sum(1)).cast(pa.decimal128(38, 0))
    exact = (np.square(off.astype(object) * n - remainder.astype(object))).sum(1)
    return pa.array(list(exact), pa.decimal128(38, 0))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows less the identity; one pass."""
    whole, part = model.centre
    scaled, k = model.scaled, len(model.values)

    def product(x):
        rows = ((x - whole) - part) @ scaled
        return np.vstack([rows.T @ rows, rows.sum(0)])

    total = _added(vectors, model.dims, (k + 1, k), product) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error) of every vector that ``whole_vectors`` keeps.

    ``whitened`` and ``explained`` (share of the trace) hold one number per component. ``deviation`` is exact up to 38
    digits. Without vectors, or with equal ones only, no component exists and the arrays are empty. Repeated rows and
    NULL ids are rows as any other; further columns of ``rows`` are not read.
    """
    vectors, dims = whole_vectors(rows, id_col, vec_col)
    model = fit(vectors, dims, components)
    if model is None:
        n = vectors.count()
        found = vectors.select("id", F.lit(0).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
        shares, error = [], None
    else:
        n, shares, error = model.n, (model.values / model.trace).tolist(), identity_error(vectors, model)
        found = whitened(vectors, model)
    return found.select(
        F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*[F.lit(s) for s in shares]).cast("array<double>").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def long_rows(found: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row per vector and component of a ``whiten`` table. A deviation beyond 64 bits is NULL here."""
    cells = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "cell")
    return found.select(id_col, "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "identity_error", cells).select(
        id_col, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("cell.whitened").alias("whitened"), F.col("cell.explained").alias("explained"), "identity_error",
    )
