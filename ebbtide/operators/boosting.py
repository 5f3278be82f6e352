"""Second-order boosted trees for a 0/1 label.

Every level of a tree is one aggregation: tasks add up gradients and curvatures of the logistic loss per (node, slot,
bin), running over the bins, so their sums are the left sides of all cuts, and one best cut per node reaches the driver.
Bins are between sketched quantiles of a number; a category is present or absent, so a row costs the cells it holds and
a column may have as many categories as it likes. Sums are of fixed-point integers: the same rows give the same trees,
whatever their order and partitioning. Rows are staged in blocks of one Arrow batch, a column's numbers as bytes: a pass
per level hands them to numpy as they are.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import SparseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.operators.prep import FeatureSpec
from ebbtide.session import release, stage

UNIT = 2.0 ** 24  # steps of a gradient or curvature in fixed point: sums hold 2^39 rows
RESTAGE = 10  # trees after which the rows' margins are written anew
ACCURACY = 10_000  # a sketched quantile is off by one rank in so many at most
HELD = 1 << 20  # sums of categories that a task holds at most
LEAST_GAIN = 1e-6  # below it a gain is rounding


@dataclass(frozen=True)
class SecondOrderParams:
    """Defaults of the learner. ``l1`` and ``l2`` penalise leaf weights; a split needs more than
    ``min_gain``, and ``min_curvature`` on either side."""

    trees: int = 100
    depth: int = 3
    rate: float = 0.1
    row_share: float = 0.8
    column_share: float = 0.8
    min_gain: float = 0.0
    l1: float = 0.0
    l2: float = 1.0
    min_curvature: float = 1.0
    seed: int = 42
    bins: int = 256


@dataclass(frozen=True)
class Node:
    """Children of node i are 2 i (``value <= cut``) and 2 i + 1; a leaf has neither slot nor gain."""

    tree: int
    node: int
    slot: int | None
    bin: int | None
    cut: float | None
    gain: float | None
    gradient: float
    curvature: float
    rows: int
    value: float


NODES = ("tree int, node int, slot int, bin int, cut double, gain double, gradient double, curvature double, "
         "rows long, value double")


@dataclass(frozen=True)
class BoostedTrees:
    """The fitted trees and the margin they start from. Its size is set by the parameters, not by the rows."""

    nodes: list[Node]
    base: float
    size: int
    params: SecondOrderParams

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([astuple(n) for n in self.nodes], NODES)

    @property
    def featureImportances(self) -> SparseVector:
        """Mean gain of a slot's splits, as shares that sum to one."""
        gains: dict[int, list[float]] = {}
        for n in self.nodes:
            if n.slot is not None:
                gains.setdefault(n.slot, []).append(n.gain)
        means = {slot: float(np.mean(found)) for slot, found in gains.items()}
        whole = sum(means.values())
        return SparseVector(self.size, {slot: mean / whole for slot, mean in means.items()})

    def margin(self, features: Column) -> Column:
        """Log odds of a sparse or dense vector column."""
        nodes, base = self.nodes, self.base

        @F.pandas_udf("double")
        def walk(indices: pd.Series, values: pd.Series) -> pd.Series:
            sizes = np.array([len(v) for v in values], np.int64)
            # a dense vector has no indices: its values are in slot order
            slots = [np.arange(len(v)) if i is None else i for i, v in zip(indices, values)]
            cells = (np.repeat(np.arange(len(sizes)), sizes), _joined(slots, np.int64), _joined(values, np.float64))
            return pd.Series(base + _leaf_values(nodes, len(sizes), *cells, "cut"))

        parts = F.unwrap_udt(features)
        return walk(parts["indices"], parts["values"])

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability``, a vector of both classes' shares, as the library's other classifiers give it."""
        p = 1 / (1 + F.exp(-self.margin(F.col("features"))))
        return df.withColumn("probability", array_to_vector(F.array(1 - p, p)))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        whole = [(self.base, self.size, *astuple(self.params))]
        names = ["base", "size", *[f.name for f in fields(self.params)]]
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame(whole, names).coalesce(1).write.mode("overwrite").parquet(f"{path}/params")

    @classmethod
    def load(cls, path: str) -> BoostedTrees:
        spark = SparkSession.active()
        numbers = spark.read.parquet(f"{path}/params").first().asDict()
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect()
        base, size = numbers.pop("base"), numbers.pop("size")
        return cls([Node(**r.asDict()) for r in nodes], base, size, SecondOrderParams(**numbers))


def _joined(parts, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts]).astype(kind)


def _reached(nodes: list[Node], n: int, row, slot, value, by: str) -> dict[int, np.ndarray]:
    """Node of each of ``n`` rows per tree, from the rows' cells; a slot without a cell holds zero. ``by`` names what a
    cell is compared with: ``cut``, or ``bin`` for cells that are bins already."""
    splits = [x for x in nodes if x.slot is not None]
    used = np.unique(np.array([x.slot for x in splits], np.int64))
    held = np.zeros((len(used), n))
    if len(used):
        place = np.minimum(np.searchsorted(used, slot), len(used) - 1)
        hit = used[place] == slot
        held[place[hit], row[hit]] = value[hit]
    at = {x.tree: np.ones(n, np.int64) for x in nodes}
    for x in sorted(splits, key=lambda x: (x.tree, x.node)):
        here = at[x.tree] == x.node
        right = held[np.searchsorted(used, x.slot)] > getattr(x, by)
        at[x.tree] = np.where(here, 2 * x.node + right, at[x.tree])
    return at


def _leaf_values(nodes: list[Node], n: int, row, slot, value, by: str) -> np.ndarray:
    total, worth = np.zeros(n), {}
    for x in nodes:
        worth.setdefault(x.tree, {})[x.node] = x.value
    for tree, at in sorted(_reached(nodes, n, row, slot, value, by).items()):
        values = np.zeros(max(worth[tree]) + 1)
        values[list(worth[tree])] = list(worth[tree].values())
        total += values[at]
    return total


def numeric_cuts(train: DataFrame, spec: FeatureSpec, bins: int) -> list[np.ndarray]:
    """Upper ends of each number's bins, from one sketch per column; the last is the column's maximum."""
    if not spec.numeric:
        return []
    shares = [i / bins for i in range(1, bins + 1)]
    values = F.unwrap_udt("features")["values"]  # the encoder puts all numbers first
    found = train.agg(*[F.percentile_approx(F.get(values, F.lit(i)), shares, ACCURACY).alias(str(i)) for i in range(len(spec.numeric))])
    return [np.unique(np.array(ends or [0.0])) for ends in found.first()]


KINDS = {"y": np.float64, "margin": np.float64, "draw": np.int64, "codes": np.int32, "sizes": np.int32, "slots": np.int32}
BLOCKS = ", ".join(f"{c} binary" for c in KINDS)


def _block(columns) -> pa.RecordBatch:
    """A row of the columns' bytes."""
    parts = [pa.array([np.ascontiguousarray(c, k).tobytes()], pa.binary()) for c, k in zip(columns, KINDS.values())]
    return pa.RecordBatch.from_arrays(parts, names=list(KINDS))


def _opened(batches):
    """The columns of every block, in the order of ``KINDS``."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield [np.frombuffer(batch.column(j)[i].as_buffer(), k) for j, k in enumerate(KINDS.values())]


def _binned(train: DataFrame, label: str, key: str, cuts: list[np.ndarray], base: float) -> DataFrame:
    """Blocks of rows: label, margin, a hash of the key, a bin per number, and how many and which categories a row has."""
    m = len(cuts)

    def code(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y, draw = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            numbers = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, m)
            codes = np.empty(numbers.shape, np.int32)
            for i, ends in enumerate(cuts):
                codes[:, i] = np.minimum(np.searchsorted(ends, numbers[:, i]), len(ends) - 1)
            slots = batch.column(3)
            yield _block([y, np.full(len(y), base), draw, codes, slots.value_lengths().to_numpy(), slots.flatten().to_numpy()])

    parts = F.unwrap_udt("features")
    rows = train.select(
        F.col(label).cast("double").alias("y"), F.xxhash64(F.col(key)).alias("draw"),
        F.slice(parts["values"], 1, m).alias("numbers") if m else F.array().cast("array<double>").alias("numbers"),
        F.filter(parts["indices"], lambda i: i >= m).alias("slots"))
    return rows.mapInArrow(code, BLOCKS)


def _drawn(share: float, seed: int, tree: int, keys: np.ndarray) -> np.ndarray:
    """True for a share of the keys, each by its own hash, so rows and slots are drawn alike wherever they lie."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)  # the finaliser of splitmix64
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(11) < np.uint64(round(share * 2 ** 53))


def _cells(n: int, m: int, codes: np.ndarray, sizes: np.ndarray, slots: np.ndarray):
    """(row, slot, bin) of all cells of a block: those of numbers first, row by row, then those of categories."""
    every = np.arange(n)
    row = np.concatenate([np.repeat(every, m), np.repeat(every, sizes)])
    slot = np.concatenate([np.tile(np.arange(m), n), slots])
    return row, slot, np.concatenate([codes, np.ones(len(slots), np.int32)])


def _advance(rows: DataFrame, nodes: list[Node], m: int) -> DataFrame:
    """The rows with the trees of ``nodes`` added to their margins."""

    def add(batches):
        for y, margin, draw, *held in _opened(batches):
            yield _block([y, margin + _leaf_values(nodes, len(y), *_cells(len(y), m, *held), "bin"), draw, *held])

    return rows.mapInArrow(add, BLOCKS)


def _gradients(block, past: list[Node], tree: int, m: int, p: SecondOrderParams):
    """Cells of a block, and gradient, curvature and count of its rows in fixed point; rows not drawn have zeros."""
    y, margin, draw, *held = block
    cells = _cells(len(y), m, *held)
    share = 1 / (1 + np.exp(-(margin + _leaf_values(past, len(y), *cells, "bin"))))
    chosen = _drawn(p.row_share, p.seed, tree, draw)
    return cells, [np.rint((share - y) * UNIT) * chosen, np.rint(share * (1 - share) * UNIT) * chosen, chosen * 1.0]


def _root(rows: DataFrame, past: list[Node], tree: int, m: int, p: SecondOrderParams) -> tuple[int, int, int]:
    """Sums over all rows a tree sees; a row per task is added up."""

    def add(batches):
        held = np.zeros(3, np.int64)
        for block in _opened(batches):
            held += np.array([a.sum() for a in _gradients(block, past, tree, m, p)[1]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in held], names=["g", "h", "n"])

    return tuple(rows.mapInArrow(add, "g long, h long, n long").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in "ghn"]).first())


def _histograms(rows: DataFrame, past: list[Node], grown: dict[int, Node], totals: dict[int, tuple], tree: int,
                cuts: list[np.ndarray], size: int, p: SecondOrderParams) -> DataFrame:
    """(node, slot, bin, g, h, n, gt, ht, nt): partial sums over the drawn rows that reach a node of ``totals``, for the
    slots that the tree draws, beside the node's own sums. A number's sums are of its bins up to and with ``bin``, so
    adding up the tasks' rows gives the left side of every cut; a category's are of the rows that have it.

    A task holds the sums of all numbers, which the number of columns bounds, and those of categories too if all of a
    level's fit in ``HELD`` places; else it sends them per block.
    Slot ``tree % size`` is always drawn, so no tree is without.
    """
    m, wanted = len(cuts), np.array(sorted(totals), np.int64)
    width = max([len(c) for c in cuts], default=1)
    place_of = np.full(2 ** (p.depth + 1), -1, np.int64)
    place_of[wanted] = np.arange(len(wanted))
    whole = np.array([totals[i] for i in wanted.tolist()], np.int64)
    cutting = np.arange(width) < np.array([len(c) - 1 for c in cuts], np.int64)[:, None]  # a column's last bin is no cut

    def packed(place, slot, code, sums):
        parts = [wanted[place].astype(np.int32), slot.astype(np.int32), code.astype(np.int32), *sums.astype(np.int64), *whole[place].T]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["node", "slot", "bin", "g", "h", "n", "gt", "ht", "nt"])

    def add(batches):
        held = np.zeros((3, len(wanted) * m * width))  # whole numbers below 2^53: exact
        few = len(wanted) * size <= HELD
        present = np.zeros((3, len(wanted) * size if few else 0))
        numbers = np.flatnonzero(_drawn(p.column_share, ~p.seed, tree, np.arange(m)) | (np.arange(m) == tree % size))
        for block in _opened(batches):
            (row, slot, code), amounts = _gradients(block, past, tree, m, p)
            n = len(block[0])
            at = _reached(list(grown.values()), n, row, slot, code, "bin").get(tree)
            here = place_of[at] if at is not None else np.full(n, place_of[1])
            used = (here >= 0) & (amounts[2] > 0)
            place, sums = here[used], [a[used] for a in amounts]
            codes = code[: n * m].reshape(n, m)[used]
            for i in numbers.tolist():
                dense = place * (m * width) + i * width + codes[:, i]
                for k, amount in enumerate(sums):
                    held[k] += np.bincount(dense, amount, held.shape[1])
            row, slot = row[n * m :], slot[n * m :]
            of_tree = used[row] & (_drawn(p.column_share, ~p.seed, tree, slot) | (slot == tree % size))
            row, slot = row[of_tree], slot[of_tree]
            pair = here[row] * size + slot
            if few:
                for k, amount in enumerate(amounts):
                    present[k] += np.bincount(pair, amount[row], present.shape[1])
            elif len(pair):
                found, pair = np.unique(pair, return_inverse=True)
                sums = np.stack([np.bincount(pair, a[row], len(found)) for a in amounts])
                yield packed(found // size, found % size, np.zeros(len(found)), sums)
        found = np.flatnonzero(present[2])
        if len(found):
            yield packed(found // size, found % size, np.zeros(len(found)), present[:, found])
        upto = held.reshape(3, len(wanted), m, width).cumsum(axis=3)
        place, slot, code = np.nonzero((upto[2] > 0) & cutting)
        yield packed(place, slot, code, upto[:, place, slot, code])

    return rows.mapInArrow(add, "node int, slot int, bin int, g long, h long, n long, gt long, ht long, nt long")


def best_cuts(partial: DataFrame, m: int, p: SecondOrderParams) -> DataFrame:
    """(node, best): the allowed cut of most gain with the sums left of it; among equals the first slot, then bin.

    Slots from ``m`` on are categories: bin 0 is absence, left, and their sums are those of the right side. As text, for
    hundreds of levels are planned in a row.
    """
    def score(g, h):
        pull = f"(sign({g}) * greatest(abs({g}) - {p.l1!r}D, 0D))"
        return f"coalesce(try_divide({pull} * {pull}, {h} + {p.l2!r}D), 0D)"

    def left(c):
        return f"(IF(slot >= {m}, max({c}t) - sum({c}), sum({c})))"

    sides = partial.groupBy("node", "slot", "bin").agg(*[F.expr(x) for x in (
        f"{left('g')} AS gl", f"{left('h')} AS hl", f"{left('n')} AS nl", f"max(nt) - {left('n')} AS nr",
        f"{left('g')} / {UNIT}D AS lg", f"{left('h')} / {UNIT}D AS lh", f"(max(gt) - {left('g')}) / {UNIT}D AS rg",
        f"(max(ht) - {left('h')}) / {UNIT}D AS rh", f"max(gt) / {UNIT}D AS pg", f"max(ht) / {UNIT}D AS ph")])
    offers = sides.where(f"nl > 0 AND nr > 0 AND least(lh, rh) >= {p.min_curvature!r}D").selectExpr("node", f"""struct(
        {score('lg', 'lh')} + {score('rg', 'rh')} - {score('pg', 'ph')} AS gain, -slot AS slot, -bin AS bin, gl, hl, nl) AS offer""")
    return offers.where(f"offer.gain > {max(p.min_gain, LEAST_GAIN)!r}D").groupBy("node").agg(F.expr("max(offer) AS best"))


def leaf_value(gradient: float, curvature: float, p: SecondOrderParams) -> float:
    """The step that lowers the penalised loss most to second order, times the rate."""
    pull = np.sign(gradient) * max(abs(gradient) - p.l1, 0.0)
    return float(-p.rate * pull / (curvature + p.l2)) if curvature + p.l2 > 0 else 0.0


def _grow(rows: DataFrame, past: list[Node], tree: int, cuts: list[np.ndarray], size: int, p: SecondOrderParams) -> list[Node]:
    """One tree, level by level; the sums of a level's nodes are known from their parents' cuts."""
    grown: dict[int, Node] = {}
    totals = {1: _root(rows, past, tree, len(cuts), p)}

    def leaves():
        for i, (g, h, n) in totals.items():
            grown[i] = Node(tree, i, None, None, None, None, g / UNIT, h / UNIT, n, leaf_value(g / UNIT, h / UNIT, p))

    leaves()
    for _ in range(p.depth):
        partial = _histograms(rows, past, grown, totals, tree, cuts, size, p)
        level, totals = totals, {}
        for node, best in best_cuts(partial, len(cuts), p).collect():  # a row per node
            slot, code, left = -best["slot"], -best["bin"], (best["gl"], best["hl"], best["nl"])
            cut = float(cuts[slot][code]) if slot < len(cuts) else 0.0
            grown[node] = replace(grown[node], slot=slot, bin=code, cut=cut, gain=best["gain"])
            totals[2 * node] = left
            totals[2 * node + 1] = tuple(a - b for a, b in zip(level[node], left))
        leaves()
        if not totals:
            break
    return [grown[i] for i in sorted(grown)]


def fit_trees(train: DataFrame, key: str, label: str, spec: FeatureSpec, params: SecondOrderParams = SecondOrderParams()) -> BoostedTrees:
    """Trees fitted to (key, label, features) rows of the encoder, starting from the log odds of the label's share.

    Each tree sees the rows and slots that a hash of their key, the seed and the tree's number draws. Rows without a
    label are left out; a table without any labelled row is refused.
    """
    rows = train.where(F.col(label).isNotNull())
    n, ones = rows.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("double"))).first()
    if not n:
        raise ValueError("no labelled rows to learn from")
    share = min(max(ones / n, 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    cuts = numeric_cuts(rows, spec, params.bins)
    held = stage(_binned(rows, label, key, cuts, base), "binned")
    nodes: list[Node] = []
    past: list[Node] = []
    for tree in range(params.trees):
        past += _grow(held, past, tree, cuts, spec.size, params)
        if (tree + 1) % RESTAGE == 0 or tree + 1 == params.trees:
            nodes += past
            if tree + 1 < params.trees:
                moved = stage(_advance(held, past, len(cuts)), "binned")
                release(held)
                held = moved
            past = []
    release(held)
    return BoostedTrees(nodes, base, spec.size, params)
