"""K-means customer segments.

The first centres are drawn by a hash of the key and the sums of every step are of fixed-point integers, so the segments
depend on the rows alone, not on their order, files or partitions. Tasks hold ``k`` sums per feature; what reaches the
driver are centres.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.prep import fit_segment_features
from ebbtide.session import release, stage

# Segment count and its range, seed and iteration limits.
SEGMENTS = 3
SEGMENT_RANGE = (2, 10)
MIN_FEATURES = 2
SEED = 42
MAX_ITER = 300
TOL = 1e-4

UNIT = 2.0 ** 24  # steps of a value
CELLS = "draw long, slots array<int>, units array<long>"


@dataclass(frozen=True)
class Summary:
    """Rows per cluster and the sum of their squared distances from its centre."""

    clusterSizes: list[int]
    trainingCost: float


@dataclass(frozen=True)
class Segmentation:
    """Fitted centres. There are fewer than were asked for if the rows have fewer different vectors."""

    centers: np.ndarray
    summary: Summary

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centers)

    def transform(self, df: DataFrame, column: str = "cluster") -> DataFrame:
        """``df`` with the number of the centre nearest to its ``features``; of equally near ones the first."""
        centers = self.centers

        @F.pandas_udf("int")
        def nearest(slots: pd.Series, values: pd.Series) -> pd.Series:
            return pd.Series(_nearest(centers, *_flat(slots, values))[0].astype(np.int32))

        parts = F.unwrap_udt("features")
        return df.withColumn(column, nearest(parts["indices"], parts["values"]))


def _flat(slots, values) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, and (row, slot, value) of their cells; a dense vector has no slots and lists all values."""
    sizes = np.array([len(v) for v in values], np.int64)
    listed = [np.arange(len(v)) if s is None else s for s, v in zip(slots, values)]
    slot, value = (np.concatenate([np.zeros(0), *x]) for x in (listed, values))
    return len(sizes), np.repeat(np.arange(len(sizes)), sizes), slot.astype(np.int64), value.astype(np.float64)


def _nearest(centers: np.ndarray, n: int, row, slot, value) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centre and the squared distance from it."""
    own = np.bincount(row, value * value, n)
    far = np.stack([own - 2 * np.bincount(row, value * c[slot], n) + c @ c for c in centers], axis=1)
    at = far.argmin(axis=1)
    return at, np.maximum(far[np.arange(n), at], 0.0)


def _cells(batch: pa.RecordBatch):
    slots, units = batch.column(1), batch.column(2)
    row = np.repeat(np.arange(batch.num_rows), slots.value_lengths().to_numpy())
    return batch.num_rows, row, slots.flatten().to_numpy().astype(np.int64), units.flatten().to_numpy() / UNIT


def _uniform(draw: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """Numbers in (0, 1) hashed from the keys' hashes."""
    with np.errstate(over="ignore"):
        x = draw.astype(np.uint64) + np.uint64((seed * 1_000_003 + turn + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)  # the finaliser of splitmix64
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((x ^ (x >> np.uint64(31))) >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0 ** 52


def first_centers(rows: DataFrame, size: int, k: int, seed: int) -> np.ndarray:
    """Rows drawn one after another with a chance in proportion to the squared distance from those drawn before.

    Each round is a race: a row's time is exponential with its weight as rate, its random number a hash of its key, and
    the least time wins. A task sends its winner only. Rounds end when every row is at a centre.
    """
    centers = np.zeros((0, size))
    for turn in range(k):

        def race(batches, turn=turn, centers=centers):
            best = None
            for batch in batches:
                n, *cells = _cells(batch)
                weight = _nearest(centers, n, *cells)[1] if len(centers) else np.ones(n)
                weight = np.where(weight > 1 / UNIT, weight, 0.0)  # what rounding leaves of a centre's own rows
                with np.errstate(divide="ignore"):
                    time = -np.log(_uniform(batch.column(0).to_numpy(), seed, turn)) / weight
                for i in np.flatnonzero(time == time.min(initial=np.inf)).tolist() if np.isfinite(time).any() else ():
                    found = (float(time[i]), batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                    best = found if best is None else min(best, found)
            if best is not None:
                names = ["time", "slots", "units"]
                kinds = pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(best, kinds)], names=names)

        runners = rows.mapInArrow(race, "time double, slots array<int>, units array<long>")
        won = runners.agg(F.min(F.struct("time", "slots", "units")).alias("won")).first()["won"]
        if won is None:
            break
        center = np.zeros(size)
        center[won["slots"]] = np.array(won["units"]) / UNIT
        centers = np.vstack([centers, center])
    return centers


def _step(rows: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums of the rows nearest to each centre, their numbers, and the cost of the centres as they are."""
    k, size = centers.shape

    def add(batches):
        sums, counts, cost = np.zeros(k * size, np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            n, row, slot, value = _cells(batch)
            at, far = _nearest(centers, n, row, slot, value)
            np.add.at(sums, at[row] * size + slot, batch.column(2).flatten().to_numpy())
            counts += np.bincount(at, minlength=k)
            cost += int(np.rint(far * UNIT).sum())
        held = np.concatenate([sums, counts, [cost]])
        place = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(held[place])], names=["place", "total"])

    # a row per centre and feature: as many numbers as the centres have
    whole = F.sum(F.col("total").cast("decimal(38,0)"))  # a task's sums fit a long, the cost of all rows may not
    held = np.zeros(k * size + k + 1)
    for place, total in rows.mapInArrow(add, "place long, total long").groupBy("place").agg(whole).collect():
        held[place] = float(total)
    return held[: k * size].reshape(k, size) / UNIT, held[k * size: -1].astype(np.int64), float(held[-1] / UNIT)


def fit_centers(encoded: DataFrame, key: str, size: int, k: int, seed: int = SEED) -> Segmentation:
    """K-means over the ``features`` of (key, features) rows. A centre that no row is nearest to stays where it is."""
    parts = F.unwrap_udt("features")
    units = F.transform(parts["values"], lambda v: F.round(v * UNIT).cast("long"))
    rows = stage(encoded.select(F.xxhash64(key).alias("draw"), parts["indices"].alias("slots"), units.alias("units")).to(
        encoded.sparkSession.createDataFrame([], CELLS).schema), "cells")
    centers = first_centers(rows, size, k, seed)
    if not len(centers):
        raise ValueError("no rows to segment")
    for _ in range(MAX_ITER):
        sums, counts, _ = _step(rows, centers)
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
        shift = np.sqrt(((moved - centers) ** 2).sum(axis=1).max())
        centers = moved
        if shift <= TOL:
            break
    _, counts, cost = _step(rows, centers)
    release(rows)
    return Segmentation(centers, Summary(counts.tolist(), cost))


def kmeans_segments(df: DataFrame, key: str, features: list[str], k: int = SEGMENTS, seed: int = SEED) -> DataFrame:
    """Input rows plus ``segment`` ("Segment 1".."Segment k"), numbered by size, then by centroid.

    The same rows give the same segments, however they are ordered and partitioned.
    """
    return fit_segments(df, key, features, k, seed)[0]


def segment_order(model: Segmentation) -> list[int]:
    """Clusters by size, then centroid: the first is Segment 1."""
    sizes = model.summary.clusterSizes
    centers = [tuple(np.round(c, 9)) for c in model.clusterCenters()]
    return sorted(range(len(centers)), key=lambda i: (-sizes[i], centers[i]))


def fit_segments(df: DataFrame, key: str, features: list[str], k: int = SEGMENTS,
                 seed: int = SEED) -> tuple[DataFrame, Segmentation]:
    if len(features) < MIN_FEATURES:
        raise ValueError(f"segmentation needs at least {MIN_FEATURES} features")
    if not SEGMENT_RANGE[0] <= k <= SEGMENT_RANGE[1]:
        raise ValueError(f"segments must be between {SEGMENT_RANGE[0]} and {SEGMENT_RANGE[1]}")
    spec = fit_segment_features(df, features)
    pipeline = spec.pipeline(df)
    encoded = pipeline.transform(df.select(key, *[f for f in features if f != key])).select(key, "features")
    model = fit_centers(encoded, key, spec.size, k, seed)
    order = segment_order(model)
    number = F.array(*[F.lit(order.index(i) + 1) for i in range(len(order))])
    assigned = pipeline.transform(df)
    column = "cluster"
    while column in assigned.columns:
        column += "_"
    named = F.concat(F.lit("Segment "), F.get(number, F.col(column)).cast("string"))
    return model.transform(assigned, column).select(*df.columns, named.alias("segment")), model
