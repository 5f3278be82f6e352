"""Best-fit packing by patterns of document lengths.

Only the histogram of piece lengths (as many numbers as a sequence has tokens) reaches the driver. Patterns of one to
three lengths that fill a sequence exactly are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded within what is there; what is left over is packed pattern by pattern, the
largest fitting length first. A plan is a list of patterns with counts, of a size that does not depend on the number of
documents. Pieces find their places by their rank among equal lengths, which is counted per task and then offset.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ebbtide.llm import tokens
from ebbtide.llm.common import map_rows
from ebbtide.session import stage

SIZE = 1024
STEPS = 400


def exact_patterns(size: int) -> np.ndarray:
    """All (a, b, c) with a >= b >= c >= 0 and a + b + c = size; 0 stands for no document."""
    found = []
    for c in range(size // 3 + 1):
        b = np.arange(c, (size - c) // 2 + 1)
        b = b[(b > 0) | (c == 0)]
        found.append(np.stack([size - c - b, b, np.full_like(b, c)], 1))
    return np.concatenate(found)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients; the matrix is the patterns themselves."""
    n, goal = len(histogram), histogram.astype(float)
    goal[0] = 0.0

    def cover(x):
        total = np.bincount(patterns.ravel(), np.repeat(x, patterns.shape[1]), n)
        total[0] = 0.0
        return total

    def pull(r):
        return r[patterns].sum(1)

    probe = np.ones(len(patterns))
    for _ in range(30):  # largest eigenvalue, for the step width
        probe = pull(cover(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - pull(cover(y) - goal) / norm)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


@dataclass(frozen=True)
class Plan:
    """Places of all pieces: ranks from ``key - (length << 40)`` on of a length go to ``sequence``, ``sequence + 1``..."""

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = (length.astype(np.int64) << 40) + rank
        at = np.searchsorted(self.key, wanted, side="right") - 1
        return self.sequence[at] + (wanted - self.key[at]), self.offset[at]


def make_plan(histogram: np.ndarray, size: int = SIZE) -> Plan:
    """``histogram[l]`` pieces have length l. Every piece gets one place; no pattern holds more than ``size`` tokens."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    chosen: list[tuple[int, list[int]]] = []
    patterns = exact_patterns(size)
    patterns = patterns[((patterns == 0) | (left[patterns] > 0)).all(1)]
    if len(patterns):
        counts = np.rint(fit_counts(patterns, left)).astype(np.int64)
        for j in np.argsort(-counts, kind="stable"):
            if counts[j] <= 0:
                break
            lengths, times = np.unique(patterns[j][patterns[j] > 0], return_counts=True)
            n = min(int(counts[j]), int((left[lengths] // times).min()))
            if n > 0:
                left[lengths] -= n * times
                chosen.append((n, patterns[j][patterns[j] > 0].tolist()))
    chosen += list(_leftovers(left, size))
    taken: dict[int, int] = {}
    key, sequence, offset, first = [], [], [], 0
    for n, lengths in chosen:
        at = 0
        for length in lengths:
            key.append((length << 40) + taken.get(length, 0))
            sequence.append(first)
            offset.append(at)
            taken[length] = taken.get(length, 0) + n
            at += length
        first += n
    order = np.argsort(np.array(key, np.int64))
    return Plan(np.array(key, np.int64)[order], np.array(sequence, np.int64)[order], np.array(offset, np.int64)[order], first)


def _leftovers(left: np.ndarray, size: int):
    """Patterns of best fits, each repeated until one of its lengths runs out."""
    while left.any():
        space, lengths, there = size, [], left.copy()
        while space > 0:
            fitting = np.flatnonzero(there[: space + 1])
            if not len(fitting):
                break
            best = int(fitting[-1])
            times = min(int(there[best]), space // best)
            lengths += [best] * times
            there[best] -= times
            space -= best * times
        used, times = np.unique(lengths, return_counts=True)
        n = int((left[used] // times).min())
        left[used] -= n * times
        yield n, lengths


def token_pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """Stage table (id, piece, start, length, ids_crc32, part, rank[, ids]) of all documents' token pieces.

    ``rank`` counts the pieces of a length within the task that made them, ``part``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length int, ids_crc32 long, part int, rank long"
    schema += ", ids array<int>" if with_ids else ""

    def cut(slices):
        part, seen = TaskContext.get().partitionId(), {}
        for rows in slices:
            out = {name: [] for name in ("id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids")}
            for doc, text in zip(rows["id"], rows["text"]):
                for i, (start, ids) in enumerate(tokens.pieces(tokens.token_ids(text, vocabulary), size)):
                    n = len(ids)
                    rank = seen[n] = seen.get(n, -1) + 1
                    for name, value in (("id", doc), ("piece", i), ("start", start), ("length", n),
                                        ("ids_crc32", tokens.crc(ids)), ("part", part), ("rank", rank)):
                        out[name].append(value)
                    if with_ids:
                        out["ids"].append(ids.astype(np.int32))
            yield out

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return stage(map_rows(rows, cut, schema), "pieces")


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset[, ids]).

    A document is its token ids and the end id 2; NULL and empty texts are just the end id, and a repeated row is
    packed again. A document of more than ``size`` ids is cut, the first piece being the shorter one. An empty table
    gives an empty one; other columns are not read. Equal lengths are interchangeable and take places in any order.
    """
    rows = token_pieces(docs, vocabulary, size, id_col, text_col, with_ids)
    counts = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per task
    counts = stage(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "lengths")
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        histogram[r["length"]] = r["n"]
    plan = make_plan(histogram, size)
    kind = docs.schema[id_col].dataType.simpleString()

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            names = batch.schema.names
            column = {n: batch.column(i) for i, n in enumerate(names)}
            sequence, offset = plan.place(
                column["length"].to_numpy(), column["rank"].to_numpy() + column["before"].to_numpy()
            )
            keep = [column[n] for n in kept]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[*kept, "sequence_id", "offset"],
            )

    kept = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = f"id {kind}, piece int, start long, length int, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    placed = rows.join(counts.select("length", "part", "before"), ["length", "part"]).select(*kept, "rank", "before")
    found = placed.mapInArrow(place, schema + ", sequence_id long, offset long")
    return found.withColumn("length", F.col("length").cast("long")).withColumnRenamed("id", id_col)
