"""Near-duplicate vectors by lattice hashing.

Every distinct vector is projected onto a few blocks of eight random directions in each of several tables; each block
is decoded to the nearest point of the E8 lattice, and the points together name the vector's cell. A vector visits its
own cell and, as a probe, those neighbouring cells that it lies nearest to. All members of a cell are compared by
matrix products, a pair being linked if its cosine reaches the threshold. The number of tables follows from the chance
that a pair at the threshold meets in none, which is measured once by simulation: projections of unit vectors do not
depend on the data. A cell too large for one task is cut into blocks, and every two blocks meet in a task of their own,
so no cell is capped. Links are never written as pairs: a comparison sends, for each member, the number of its links
and the smallest member it is connected with there.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.llm.near_dedup import components, mixed
from ebbtide.session import stage

SIMILAR = 0.93
SCALES = (0.35, 0.4, 0.5, 0.6)  # lattice units per unit of a projected difference
PROBES = (1, 2, 3)  # neighbouring cells visited
MISS = 1e-4
CELL = 256  # wanted size of cells of unrelated vectors
BLOCK = 4096  # members of a cell that one side of a comparison holds
TRIALS = 10_000


@cache
def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to neighbouring points."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            step = np.zeros(8)
            step[i], step[j] = s, t
            found.append(step)
    found += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest whole points whose coordinates have an even sum: the coordinate rounded worst goes the other way."""
    near = np.round(x)
    rest = x - near
    worst = np.abs(rest).argmax(-1)[..., None]
    step = np.where(np.take_along_axis(rest, worst, -1) >= 0, 1.0, -1.0) * (near.sum(-1, keepdims=True) % 2 != 0)
    np.put_along_axis(near, worst, np.take_along_axis(near, worst, -1) + step, -1)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """E8 points nearest to ``x`` (last axis of eight): of the even whole points or of those moved by a half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    closer = np.square(x - whole).sum(-1) <= np.square(x - half).sum(-1)
    return np.where(closer[..., None], whole, half)


def _cells(projected: np.ndarray, probes: int) -> np.ndarray:
    """Keys of the own cell and of the nearest neighbouring ones; projected: (rows, blocks, 8)."""
    rows, blocks = projected.shape[:2]
    home = nearest(projected)
    moved = ((projected - home) @ _shortest().T).reshape(rows, -1)  # the larger, the nearer is that neighbour
    keys = [_key(home)]
    if probes:
        best = np.argpartition(-moved, probes - 1, 1)[:, :probes]
        for at in best.T:
            cell = home.copy()
            cell[np.arange(rows), at // 240] += _shortest()[at % 240]
            keys.append(_key(cell))
    return np.stack(keys, 1)


def _key(points: np.ndarray) -> np.ndarray:
    doubled = np.round(2 * points).astype(np.int64).view(np.uint64).reshape(len(points), -1)
    key = np.zeros(len(points), np.uint64)
    for column in doubled.T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


@dataclass(frozen=True)
class Lattice:
    """``tables`` of ``blocks`` projections to eight directions; ``meet`` is the chance of one table at the threshold."""

    blocks: int
    tables: int
    meet: float
    probes: int
    scale: float
    seed: int = 12

    def keys(self, units: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + probes) cell keys of unit vectors; keys of different groups differ."""
        dims = units.shape[1]
        found = []
        for t in range(self.tables):
            rng = np.random.default_rng([self.seed, t, dims])
            spread = rng.normal(size=(dims, 8 * self.blocks)) * self.scale
            moved = units @ spread + rng.uniform(-4, 4, 8 * self.blocks)
            cells = _cells(moved.reshape(len(units), self.blocks, 8), self.probes)
            found.append(mixed(mixed(cells ^ groups[:, None]) + np.uint64(t + 1)))
        return np.stack(found, 1)


def _meeting(cosine: float, blocks: int, probes: int, scale: float) -> float:
    """Simulated chance that two unit vectors of that cosine meet in a table."""
    rng = np.random.default_rng(8)
    x, other = (rng.normal(size=(TRIALS, blocks, 8)) * scale for _ in range(2))
    y = cosine * x + math.sqrt(1 - cosine**2) * other
    shift = rng.uniform(-4, 4, (TRIALS, blocks, 8))
    a, b = _cells(x + shift, probes), _cells(y + shift, probes)
    return float((a[:, :, None] == b[:, None, :]).any((1, 2)).mean())


@cache
def lattice(most: int, similar: float = SIMILAR, miss: float = MISS) -> Lattice:
    """The scheme with the fewest visits of a vector: as many blocks as bring ``most`` unrelated vectors of a group down
    to cells of about ``CELL``, and as many tables as keep the chance that a pair at the threshold meets in none below
    ``miss``."""
    found = []
    for scale, probes in itertools.product(SCALES, PROBES):
        apart = max(_meeting(0.0, 1, probes, scale), 1 / TRIALS)
        blocks = max(1, math.ceil(math.log(max(most, 1) / CELL) / -math.log(apart)))
        meet = _meeting(similar, blocks, probes, scale)
        tables = max(1, math.ceil(math.log(miss) / math.log1p(-min(max(meet, 1e-6), 1 - 1e-9))))
        found.append(Lattice(blocks, tables, meet, probes, scale))
    return min(found, key=lambda x: (x.tables * (1 + x.probes), x.blocks, x.scale))


# --- steps on tables ----------------------------------------------------------------------------------


def _vectors(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Stage table (id, node, grp, unit) of all rows; node, a digest of label and vector, is NULL for unlinkable rows."""
    label = F.col(label_col)
    slim = rows.select(F.col(id_col).alias("id"), F.when(label.isNotNull(), F.xxhash64(label)).alias("grp"),
                       label.cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                ids, groups, labels, lists = piece.columns
                nodes, units = [], []
                for i, (known, group, label) in enumerate(zip(ids.is_valid().to_pylist(), groups.to_pylist(), labels.to_pylist())):
                    unit = None if not known or group is None else _unit(lists[i])
                    units.append(unit)
                    if unit is None:
                        nodes.append(None)
                    else:  # equal labels and equal vectors, minus zero being zero
                        content = (np.asarray(lists[i].values, np.float64) + 0.0).tobytes() + b"|" + label.encode("utf-8", "surrogatepass")
                        nodes.append(hashlib.blake2b(content, digest_size=16).digest())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(nodes, pa.binary()), groups, pa.array(units, pa.list_(pa.float64()))], names=["id", "node", "grp", "unit"])

    return stage(slim.mapInArrow(run, f"id {kind}, node binary, grp bigint, unit array<double>"), "vectors")


def _unit(cell) -> np.ndarray | None:
    """The vector at length one; None for NULL, empty and zero vectors and those with NULL or non-finite entries."""
    if not cell.is_valid or not len(cell.values):
        return None
    values = cell.values.to_numpy(zero_copy_only=False).astype(np.float64)
    if not np.isfinite(values).all() or not values.any():
        return None
    values = values / np.abs(values).max()  # squares of very large or small entries stay in range
    return values / math.sqrt(values @ values)


def _keyed(distinct: DataFrame, scheme: Lattice) -> DataFrame:
    """Stage table (node, n, grp, unit, keys): ``keys`` holds own cell and probes of each table in turn."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                units = piece.column(3).to_pylist()
                groups = piece.column(2).to_numpy().view(np.uint64)
                keys = np.empty((len(units), scheme.tables * (1 + scheme.probes)), np.uint64)
                for dims in {len(u) for u in units}:
                    rows = [i for i, u in enumerate(units) if len(u) == dims]
                    mine = mixed(groups[rows] + np.uint64(dims))
                    keys[rows] = scheme.keys(np.array([units[i] for i in rows]), mine).reshape(len(rows), -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1) * keys.shape[1], pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*piece.columns, lists], names=["node", "n", "grp", "unit", "keys"])

    return stage(distinct.mapInArrow(run, "node binary, n bigint, grp bigint, unit array<double>, keys array<bigint>"), "keyed")


def _links(keyed: DataFrame, scheme: Lattice, similar: float) -> DataFrame:
    """Stage table (node, root, links): per comparison, a member's linked rows and its smallest connected member."""
    visits = keyed.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    crowds = stage(visits.groupBy("key").count().where("count > 1"), "crowds")  # alone in a cell: nothing to compare
    worth = visits.join(crowds, "key").groupBy("node").agg(F.collect_list(F.struct("key", "count")).alias("worth"))  # at most all visits
    members = keyed.join(worth, "node").select("node", "n", "grp", "unit", "keys", F.inline("worth"))
    blocks = F.ceil(F.col("count") / BLOCK)
    own = F.pmod(F.xxhash64("node"), blocks)
    met = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda other: F.struct(F.least(own, other).alias("low"), F.greatest(own, other).alias("high")))
    dealt = members.select("key", own.alias("own"), F.inline(met), "node", "n", "grp", "unit", "keys")
    dealt = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return stage(dealt.mapInArrow(_comparer(scheme, similar), "node binary, root binary, links bigint"), "links")


class _Cell:
    """Members of one comparison, as columns in pieces."""

    def __init__(self):
        self.pieces = []

    def add(self, piece):
        self.pieces.append(piece)

    def table(self):
        return pa.Table.from_batches(self.pieces).combine_chunks()


def _comparer(scheme: Lattice, similar: float):
    visits, width = 1 + scheme.probes, scheme.tables * (1 + scheme.probes)

    def run(batches):
        open_, cell = None, None
        for batch in batches:
            marks = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "low", "high")]
            change = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], 0)) + 1
            for start, end in itertools.pairwise([0, *change.tolist(), batch.num_rows] if batch.num_rows else []):
                mark = tuple(int(m[start]) for m in marks)
                if mark != open_:
                    if cell is not None:
                        yield from compared(open_, cell.table())
                    open_, cell = mark, _Cell()
                cell.add(batch.slice(start, end - start))
        if cell is not None:
            yield from compared(open_, cell.table())

    def compared(mark, rows):
        key, low, high = mark
        if len(rows) < 2:
            return
        lists = rows["unit"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        node, n, own, group = (rows[c].to_numpy() for c in ("node", "n", "own", "grp"))
        keys = rows["keys"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        found = []
        for dims in np.unique(sizes):  # one length, but for cells whose keys collide
            mine = np.flatnonzero(sizes == dims)
            entries = lists.values.to_numpy()
            units = entries[lists.offsets.to_numpy()[mine][:, None] + np.arange(dims)]
            left = np.flatnonzero(own[mine] == low)
            right = left if low == high else np.flatnonzero(own[mine] == high)
            for at in range(0, len(left), 512):
                some = left[at : at + 512]
                i, j = np.nonzero(units[some] @ units[right].T >= similar)
                i, j = mine[some[i]], mine[right[j]]
                once = (i < j) if low == high else np.ones(len(i), bool)
                i, j = i[once], j[once]
                fine = (group[i] == group[j]) & (_first_meeting(keys[i], keys[j], visits) == key)
                found.append((i[fine], j[fine]))
        i, j = (np.concatenate(x) for x in zip(*found))
        if not len(i):
            return
        links = np.bincount(i, n[j], len(rows)).astype(np.int64) + np.bincount(j, n[i], len(rows)).astype(np.int64)
        linked = np.flatnonzero(links)
        order = np.argsort(np.argsort(node))  # nodes by rank: the root of a connected part is its smallest node
        label = order.copy()
        while True:
            before = label.copy()
            np.minimum.at(label, i, label[j])
            np.minimum.at(label, j, label[i])
            if (before == label).all():
                break
        by_rank = np.argsort(node)
        yield pa.RecordBatch.from_arrays([
            pa.array(node[linked], pa.binary()), pa.array(node[by_rank[label[linked]]], pa.binary()), pa.array(links[linked]),
        ], names=["node", "root", "links"])

    return run


def _first_meeting(a: np.ndarray, b: np.ndarray, visits: int) -> np.ndarray:
    """The one cell in which a pair counts: the smallest key that both visit in the first table with such a key."""
    most = np.iinfo(np.int64).max
    found = np.full(len(a), most)
    for at in range(0, a.shape[1], visits):
        x, y = a[:, at : at + visits], b[:, at : at + visits]
        key = np.where((x[:, :, None] == y[:, None, :]).any(2), x, most).min(1)
        found = np.where(found == most, key, found)
    return found


def near_vectors(rows: DataFrame, similar: float = SIMILAR, miss: float = MISS, id_col: str = "vec_id",
                 vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Rows are linked when their labels are equal and their vectors, of one length, have a cosine of at least
    ``similar``. NULL and zero vectors, vectors with NULL or non-finite entries, and rows without label or id are linked
    with nothing. Equal vectors are found before hashing; a repeated row counts as another vector. ``component_id`` is
    the smallest id reachable, ``kept`` says that it is the row's own (a NULL id has a NULL component and is kept). An
    empty table gives an empty one; other columns are not read.
    """
    vectors = _vectors(rows, id_col, vec_col, label_col)
    # of equal vectors any copy serves: they have one unit vector
    distinct = vectors.where("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.first("grp").alias("grp"), F.first("unit").alias("unit"), F.min("id").alias("least"))
    distinct = stage(distinct, "distinct")
    most = distinct.groupBy("grp").count().agg(F.max("count")).first()[0]
    scheme = lattice(most or 0, similar, miss)
    found = _links(_keyed(distinct.select("node", "n", "grp", "unit"), scheme), scheme, similar)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    facts = distinct.select("node", "n", "least").join(links, "node", "left").join(joined, "node", "left")
    facts = facts.withColumn("component", F.coalesce("component", "node"))
    names = facts.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = facts.join(names, "component").select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    final = vectors.select("id", "node").join(facts, "node", "left")
    return final.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )
