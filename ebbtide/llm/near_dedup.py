"""Near-duplicates of word shingles by min-max hashing.

Each document is its set of hashed shingles. Of every permutation both the minimum and the maximum are kept: two
signature values for one hash evaluation, each agreeing with the Jaccard similarity as its probability. Bands of
signature values become bucket keys; the number of bands follows from the threshold and the chance of a miss that is
allowed. Equal sets are one representative from the start. Inside a bucket every member is held against the bucket's
smallest one, on full sets, and confirmed links are joined to components. Members of a bucket that are then still in
different components are held against each other if the rarest shingles of their full sets let them have a partner
in another component, so every pair that shares a bucket is either confirmed, refuted, or already connected. No bucket
is cut and no member is left out. Before full sets are compared, one bit per minimum and
maximum of further permutations estimates the similarity; a pair goes on unless its estimate lies so far below the
threshold that chance explains it less than once in millions.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ebbtide.llm.common import map_rows
from ebbtide.session import release, stage

WORDS, SIMILAR = 5, 80
ROWS = 7
MISS = 1e-6
SKETCH_WORDS = 32  # 64 bits each, from half as many permutations
SPREAD = 5.5  # standard deviations below the expected agreement that a pair at the threshold may have
CELLS = 1 << 18  # hashes held at a time


@dataclass(frozen=True)
class Banding:
    """``bands`` of ``rows`` values from ``bands * rows / 2`` permutations."""

    multiply: np.ndarray
    add: np.ndarray
    rows: int
    bands: int

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """One bucket key per band of a non-empty set."""
        signature = min_max(shingles, self.multiply, self.add).reshape(self.rows, self.bands)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for value in signature:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + value)
        return key.view(np.int64)


def banding(similar: int, rows: int = ROWS, miss: float = MISS, seed: int = 17) -> Banding:
    """As many bands as keep the chance that a pair at the threshold shares none below ``miss``."""
    bands = math.ceil(math.log(miss) / math.log1p(-((similar / 100) ** rows)))
    half = (bands * rows + 1) // 2
    bands = 2 * half // rows
    while bands * rows % 2 or (1 - (similar / 100) ** rows) ** bands > miss:
        bands += 1
    rng = np.random.default_rng(seed)
    n = bands * rows // 2
    return Banding(rng.integers(0, 2**64, n, np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, np.uint64), rows, bands)


def min_max(shingles: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of a non-empty set under each permutation; long sets are hashed in blocks."""
    low, high = np.full(len(add), np.uint64(2**64 - 1)), np.zeros(len(add), np.uint64)
    block = max(1, CELLS // len(add))
    for at in range(0, len(shingles), block):
        hashed = np.multiply.outer(multiply, shingles[at : at + block]) + add[:, None]
        np.minimum(low, hashed.min(1), out=low)
        np.maximum(high, hashed.max(1), out=high)
    return mixed(np.concatenate([low, high]))


def sketch(shingles: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The lowest bits of ``min_max`` in 64-bit words."""
    bits = (min_max(shingles, multiply, add) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def _sketch_fits(x: str, y: str, similar: int) -> Column:
    """Bits agree with probability (1 + similarity) / 2."""
    bits, share = 64 * SKETCH_WORDS, (1 + similar / 100) / 2
    least = bits * share - SPREAD * math.sqrt(bits * share * (1 - share))
    differ = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(SKETCH_WORDS)), F.lit(0))
    return differ <= math.floor(bits - least)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; A-Z lower-cased, words are what ASCII white space leaves.

    A text of fewer words is one shingle; NULL, empty and blank texts have none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    width = min(words, len(found))
    n = len(found) - width + 1
    total = np.full(n, np.uint64(width))
    for i in range(width):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashed[i : i + n])
    return np.unique(total)


def _sketches(rows: DataFrame, words: int, scheme: Banding) -> DataFrame:
    """Stage table (id, n, set_key, bands) of every document; no bands for empty sets."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(slices):
        for part in slices:
            out = {"id": part["id"], "n": [], "set_key": [], "bands": []}
            for text in part["text"]:
                shingles = shingle_set(text, words)
                out["n"].append(len(shingles))
                out["set_key"].append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                out["bands"].append(scheme.keys(shingles) if len(shingles) else [])
            yield out

    return stage(map_rows(rows, run, f"id {kind}, n long, set_key binary, bands array<long>"), "sketches")


def _sets(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """Stage table (id, sketch, shingles) of the wanted ids, which have non-empty sets."""
    kind = rows.schema["id"].dataType.simpleString()
    rng = np.random.default_rng(23)
    multiply, add = (rng.integers(0, 2**64, 32 * SKETCH_WORDS, np.uint64) for _ in range(2))
    multiply |= np.uint64(1)

    def run(slices):
        for part in slices:
            out = {"id": [], "sketch": [], "shingles": []}
            for node, text in zip(part["id"], part["text"]):
                shingles = shingle_set(text, words)
                if len(shingles):
                    out["id"].append(node)
                    out["sketch"].append(sketch(shingles, multiply, add))
                    out["shingles"].append(shingles.view(np.int64))
            yield out

    schema = f"id {kind}, sketch array<long>, shingles array<long>"
    return stage(map_rows(rows.join(wanted, "id", "left_semi"), run, schema), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """(a, b) of the pairs whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    either = F.size("sa") + F.size("sb") - both
    return pairs.join(right, "b").join(left, "a").where(100 * both >= similar * either).select("a", "b")


def _size_fits(n: Column, m: Column, similar: int) -> Column:
    return 100 * F.least(n, m) >= similar * F.greatest(n, m)


def _in_mixed(placed: DataFrame) -> DataFrame:
    """(key, id, component) of ``placed`` (id, component, keys) in the buckets that hold more than one component."""
    members = placed.select(F.explode("keys").alias("key"), "id", "component")
    mixed_keys = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return members.join(mixed_keys.where("lo <> hi").select("key"), "key", "left_semi")


def _reachable(open_: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """(id, larger, smaller) of the rows of ``open_`` (id, component) that can have a partner in another component.

    Shingles are put in one order: those of a single component, which no wanted pair shares, then rare before frequent.
    Sets with an overlap of o share one of the first |set| - o + 1 in that order, and o is at least similar / 100 of the
    larger set and, seen from the smaller, 2 * similar / (100 + similar) of it. So the larger text of a pair shares a
    shingle of its longer prefix with another component's shorter prefix, and the smaller one the other way round.
    Texts of one template whose own parts are larger than that reach nobody, however many they are. No pairs are formed.
    """
    chosen = open_.join(sets, "id").select("id", "component", "shingles", F.size("shingles").alias("n"))
    chosen = stage(chosen.withColumn("row", F.monotonically_increasing_id()), "chosen")  # an id may have several rows
    places = chosen.select("row", "id", "component", "n", F.explode("shingles").alias("shingle"))
    spread = (
        places.groupBy("shingle")
        .agg(F.count(F.lit(1)).alias("held"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo <> hi").select("shingle", "held")
    )
    own = W.partitionBy("row")
    ranked = places.join(spread, "shingle").select(
        "id", "component", "n", "shingle", F.row_number().over(own.orderBy("held", "shingle")).alias("place"),
        F.count(F.lit(1)).over(own).alias("common"))
    # the n - common shingles of a single component come first and need no row
    longer = F.col("common") - F.ceil(similar * F.col("n") / 100) + 1
    shorter = F.col("common") - F.ceil(2 * similar * F.col("n") / (100 + similar)) + 1
    ranked = ranked.where(F.col("place") <= longer)
    ranked = stage(ranked.select("id", "component", "shingle", (F.col("place") <= shorter).alias("short")), "prefixes")
    short = F.when(F.col("short"), F.col("component"))
    met = ranked.groupBy("shingle").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(short).alias("short_lo"), F.max(short).alias("short_hi"))
    larger = F.coalesce((F.col("short_lo") != F.col("component")) | (F.col("short_hi") != F.col("component")), F.lit(False))
    smaller = F.col("short") & (F.col("lo") != F.col("hi"))
    found = ranked.join(met, "shingle").groupBy("id").agg(F.max(larger).alias("larger"), F.max(smaller).alias("smaller"))
    return found.where("larger or smaller")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of linked nodes (links: a, b); the component is its smallest node.

    Every round each node takes the smallest label around it and then its label's label, until nothing changes.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        hop = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = stage(hop.join(jump, "component", "left").select(
            "node", "old", F.least("component", "next").alias("component")), "labels")
        settled = new.where("component <> old").isEmpty()
        release(labels)
        labels = new.select("node", "component")
        if settled:
            release(both)
            return labels


def near_classes(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR, id_col: str = "doc_id",
                 text_col: str = "text", rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Two documents are linked when 100 * |intersection| >= similar * |union| of their sets of ``words``-word shingles;
    a component has its smallest id as name, and that document is kept. NULL, empty and blank texts have no shingles
    and are alone. Repeated rows of one id and text are in one component and each says the same; rows of one id with
    different texts are each classed by their own text. A NULL id is never linked, its
    component is NULL and it is kept. An empty table gives an empty one. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketches = _sketches(texts, words, banding(similar, rows, miss))
    named = sketches.where("n > 0 and id is not null")
    classes = stage(named.groupBy("set_key").agg(F.min("id").alias("rep")), "classes")
    same = classes.withColumnRenamed("rep", "id")
    reps = named.join(same, ["set_key", "id"], "left_semi")
    members = reps.select("id", F.explode("bands").alias("key"))
    crowded = members.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    crowded = crowded.where("first <> last").select("key", F.col("first").alias("pivot"))
    shared = stage(members.join(crowded, "key"), "buckets")
    sets = _sets(texts, shared.select("id").distinct(), words)
    outline = sets.select("id", "sketch", F.size("shingles").alias("size"))
    stars = shared.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.join(outline.select(F.col("id").alias("b"), F.col("sketch").alias("y"), F.col("size").alias("m")), "b")
    stars = stars.join(outline.select(F.col("id").alias("a"), F.col("sketch").alias("x"), F.col("size").alias("n")), "a")
    stars = stars.where(_size_fits(F.col("n"), F.col("m"), similar) & _sketch_fits("x", "y", similar)).select("a", "b")
    links = stage(_confirmed(stars, sets, similar), "confirmed")
    found = components(links)

    # Members of one bucket in different components; pairs with the pivot were checked. Tables by id hold a text's
    # buckets as one array, so joining them makes one row per text, not one per text and bucket.
    within = shared.where("id <> pivot").groupBy("id").agg(F.collect_set("key").alias("keys"))
    placed = within.join(found.withColumnRenamed("node", "id"), "id", "left")
    placed = stage(placed.withColumn("component", F.coalesce("component", "id")), "placed")
    reach = stage(_reachable(_in_mixed(placed).select("id", "component").distinct(), sets, similar), "reachable")
    reached = placed.join(reach, "id")
    # every pair once, in the first bucket that both are in; an id has as many buckets as there are bands
    own = _in_mixed(reached).groupBy("id").agg(F.collect_list("key").alias("keys"))
    open_ = stage(reached.drop("keys").join(own, "id").join(outline, "id"), "open")
    open_ = open_.select(F.explode("keys").alias("key"), "id", "component", "larger", "smaller", "size", "sketch", "keys")
    x = open_.toDF("key", "a", "ca", "la", "sa", "n", "x", "p")
    y = open_.toDF("key", "b", "cb", "lb", "sb", "m", "y", "q")
    roles = (F.col("la") & F.col("sb") & (F.col("n") >= F.col("m"))) | (F.col("lb") & F.col("sa") & (F.col("m") >= F.col("n")))
    # the planner takes unfolded rows for as small as the folded ones and would broadcast them
    pairs = x.join(y.hint("merge"), "key").where(
        (F.col("ca") < F.col("cb")) & roles & _size_fits(F.col("n"), F.col("m"), similar)
        & _sketch_fits("x", "y", similar) & (F.array_min(F.array_intersect("p", "q")) == F.col("key")))
    pairs = pairs.select("a", "b").distinct()
    more = stage(_confirmed(pairs, sets, similar), "confirmed")
    if not more.isEmpty():
        found = components(links.union(more))

    names = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("component"))
    final = sketches.join(names, "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return final.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def drop_near(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR, id_col: str = "doc_id",
              text_col: str = "text", rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """Rows of ``docs`` whose document is kept; an id goes if none of its rows is kept. Odd cases as in ``near_classes``."""
    classes = near_classes(docs, words, similar, id_col, text_col, rows, miss)
    dropped = classes.groupBy(F.col(id_col).alias("_dropped")).agg(F.max("kept").alias("kept")).where(~F.col("kept"))
    return docs.join(dropped, docs[id_col] == dropped["_dropped"], "left_anti")
