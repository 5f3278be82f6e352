"""Feature preparation: imputation, scaling, one-hot encoding and the train/test split.

Fitting collects a few numbers per column. The categories, of which a column may have as many as the table has rows,
stay in a stage table that gives each its place in the feature vector; encoding joins that table. Only the categories of
columns with a handful of them are literals in the plan, which then is a plain projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions import roles
from ebbtide.functions.hashing import unit_hash, wide_hash
from ebbtide.functions.ranking import running_total
from ebbtide.functions.shaping import long_numbers, long_texts, number_cells, present, text_cells
from ebbtide.operators.profile import cell_counts, top_values
from ebbtide.operators.quantiles import column_quantiles
from ebbtide.session import stage

# Share of rows held out.
TEST_SIZE = 0.25

LITERALS = 64  # categories of a column that may stand in a plan; columns with more are joined


def feature_projection(df: DataFrame, key: str, features: list[str], label: str) -> DataFrame:
    return df.select(key, *features, label)


# --- fitted numbers ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Moments:
    """Present and missing rows, mean and population standard deviation of a column."""

    present: int
    missing: int
    mean: float | None
    std: float | None

    def filled(self, value: float) -> tuple[float, float]:
        """Mean and deviation once every missing cell holds ``value``."""
        n, m = self.present, self.missing
        if not m:
            return self.mean, self.std
        mean = (n * self.mean + m * value) / (n + m)
        square = n * (self.std**2 + (self.mean - mean) ** 2) + m * (value - mean) ** 2
        return mean, math.sqrt(square / (n + m))


def moments(df: DataFrame, columns: list[str]) -> dict[str, Moments]:
    """One pass over the table for all columns."""
    if not columns:
        return {}
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, x in enumerate(number_cells(df, columns)):
        aggregates += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = df.agg(*aggregates).first()
    return {
        c: Moments(row[f"n{i}"], row["n"] - row[f"n{i}"], row[f"a{i}"], row[f"s{i}"]) for i, c in enumerate(columns)
    }


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    if not columns:
        return {}
    return {r["column"]: r["value"] for r in column_quantiles(df, columns, [0.5]).collect()}


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value per column, ties to the smallest."""
    if not columns:
        return {}
    return {r["column"]: r["value"] for r in top_values(df, columns, 1).collect()}


def category_counts(slots: DataFrame) -> dict[str, dict[str, int]]:
    """Rows per category of each text column of a slot table, for whoever wants them on the driver."""
    found: dict[str, dict[str, int]] = {}
    for r in slots.where(F.col("value").isNotNull()).orderBy("slot").collect():
        found.setdefault(r["column"], {})[r["value"]] = r["n"]
    return found


def _slots(df: DataFrame, numeric: dict[str, int], texts: list[str], weight: Column) -> DataFrame:
    """Stage table (column, value, n, weight, slot) for number columns with their present rows, and text columns."""
    cells = [F.struct(F.lit(c).alias("column"), F.lit(None).cast("string").alias("value"), F.lit(n).cast("long").alias("n"))
             for c, n in numeric.items()]
    rows = df.sparkSession.range(1).select(F.inline(F.array(*cells).cast("array<struct<column:string,value:string,n:bigint>>")))
    if texts:
        found = cell_counts(df, texts).where(F.col("value").isNotNull())
        rows = rows.unionByName(found.select("column", "value", F.col("n").cast("long").alias("n")))
    place = F.array_position(F.array(*[F.lit(c) for c in [*numeric, *texts]]).cast("array<string>"), F.col("column"))
    ranked = running_total(rows.withColumn("_place", place), [], ["_place", "value"], F.lit(1).cast("long"), "slot")
    return stage(ranked.select("column", "value", "n", F.when(F.col("value").isNotNull(), weight).alias("weight"), "slot"), "slots")


def feature_slots(df: DataFrame, exclude=()) -> DataFrame:
    """(column, value, n, slot): the features that ``fit_features`` makes of ``df``, in vector order, as a stage table.

    A number column has one row with a NULL value, a text column one per category; ``n`` counts the rows that hold it.
    Nothing but one count per number column reaches the driver.
    """
    numeric, texts = _feature_columns(df, exclude)
    stats = moments(df, numeric)
    counted = {c: stats[c].present for c in numeric if stats[c].present}
    return _slots(df, counted, texts, F.lit(1.0)).drop("weight")


# --- table operators --------------------------------------------------------------------------------


def _filled(df: DataFrame, fill: dict) -> DataFrame:
    cells = []
    for c in df.columns:
        if c not in fill:
            cells.append(F.col(c))
        elif isinstance(fill[c], str):
            cells.append(F.coalesce(F.col(c), F.lit(fill[c])).alias(c))
        else:
            cells.append(F.coalesce(present(df, c).cast("double"), F.lit(float(fill[c]))).alias(c))
    return df.select(*cells)


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    return _filled(df, medians(df, columns))


def impute_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    return _filled(df, modes(df, columns))


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    return _filled(df, {c: m.mean for c, m in moments(df, columns).items() if m.present})


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0, a missing value stays missing."""
    stats = moments(df, columns)
    cells = []
    for c in df.columns:
        if c in stats and stats[c].present:
            scaled = (present(df, c).cast("double") - stats[c].mean) / (stats[c].std or 1.0)
            cells.append(scaled.alias(c))
        else:
            cells.append(F.col(c))
    return df.select(*cells)


def onehot(df: DataFrame, key: str, columns: list[str], categories: dict[str, list[str]] | None = None,
           fill_mode: bool = True) -> DataFrame:
    """(key, feature, value) with the non-zero cells of the one-hot matrix, ``feature`` being column_category.

    With ``categories`` given, other values have no row, which is an all-zero code. ``fill_mode=False``
    is the dummy coding used for segments, where a missing category is all zero too.
    """
    fill = modes(df, columns) if fill_mode else {}
    cells = long_texts(_filled(df, fill), columns, [key]).where(F.col("value").isNotNull())
    if categories is not None:
        known = F.lit(False)
        for c, values in categories.items():
            known = known | ((F.col("column") == c) & F.col("value").isin(list(values)))
        cells = cells.where(known)
    return cells.select(key, F.concat_ws("_", "column", "value").alias("feature"), F.lit(1.0).alias("value"))


def dummies_segment(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(key, feature, value): numbers with missing ones replaced by the mean, texts as dummies."""
    texts = [f for f in features if isinstance(df.schema[f].dataType, T.StringType)]
    numbers = [f for f in features if f not in texts]
    cells = long_numbers(impute_mean(df, numbers), numbers, [key]).select(key, F.col("column").alias("feature"), "value")
    if texts:
        cells = cells.unionByName(onehot(df, key, texts, fill_mode=False))
    return cells


# --- split ------------------------------------------------------------------------------------------


def hash_split(df: DataFrame, key: str, test_size: float = TEST_SIZE, salt: str = "-42") -> DataFrame:
    """Add ``split`` from a hash of the key: no shuffle, same answer on every run; class shares hold in expectation."""
    return df.withColumn("split", F.when(unit_hash(F.col(key), salt) < test_size, "test").otherwise("train"))


def stratified_split(df: DataFrame, key: str, label: str, test_size: float = TEST_SIZE, salt: str = "-42") -> DataFrame:
    """Add ``split`` with exact class quotas: ceil(test_size * rows) test rows, shared out by largest remainders.

    Within a class the rows with the smallest key hashes, then keys, are the test rows. Ranks come from ranges of
    (class, hash, key), so no class is ever in one task and ties need nothing special. Rows without a label have no
    split.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])  # so that no column of the table can clash
    hashed = df.select(row.alias("row"), wide_hash(F.col(key), salt).alias("_h"), F.col(label).cast("string").alias("_class"), F.col(key).alias("_key"))
    narrow = hashed.where(F.col("_class").isNotNull()).select("_class", "_h", "_key")
    ranked = stage(running_total(narrow, ["_class"], ["_h", "_key"], F.lit(1).cast("long"), "_rank"), "ranked")
    last = ranked.join(_quotas(ranked, test_size), "_class").where(F.col("_rank") == F.col("quota") - 1)
    last = last.select("_class", F.col("_h").alias("_cut"), F.col("_key").alias("_last"))
    placed = hashed.join(last, "_class", "left")
    first = (F.col("_h") < F.col("_cut")) | ((F.col("_h") == F.col("_cut")) & (F.col("_key") <= F.col("_last")))
    split = F.when(F.col("_class").isNotNull(), F.when(first, "test").otherwise("train"))
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns], split.alias("split"))


def _quotas(ranked: DataFrame, test_size: float) -> DataFrame:
    """(_class, quota): the floor of every class's share; the biggest fractions get the rest, ties to the smaller class."""
    sizes = stage(ranked.groupBy("_class").agg(F.count(F.lit(1)).alias("size")), "sizes")
    total = sizes.agg(F.sum("size")).scalar()
    wanted = F.ceil(test_size * total)
    exact = wanted * F.col("size") / total
    shares = stage(sizes.select("_class", F.floor(exact).alias("low"), (F.floor(exact) - exact).alias("_rest"), wanted.alias("wanted")), "shares")
    given = shares.agg(F.sum("low")).scalar()
    placed = running_total(shares, [], ["_rest", "_class"], F.lit(1).cast("long"), "_place")
    extra = (F.col("_place") < F.col("wanted") - given).cast("long")
    return placed.select("_class", (F.col("low") + extra).alias("quota"))


def split_integrity(whole: DataFrame, train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """One row: sizes, keys in both parts, in neither, or in a part only. One shuffle on the key decides all."""
    parts = [
        frame.select(key, F.lit(w).alias("w"), F.lit(a).alias("a"), F.lit(b).alias("b"))
        for frame, w, a, b in ((whole, 1, 0, 0), (train, 0, 1, 0), (test, 0, 0, 1))
    ]
    seen = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(key).agg(
        F.sum("w").alias("w"), F.sum("a").alias("a"), F.sum("b").alias("b")
    )
    checks = seen.agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("n_input"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("n_train"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("n_test"),
        F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("in_both"),
        F.count_if((F.col("w") > 0) & (F.col("a") + F.col("b") == 0)).alias("in_neither"),
        F.count_if((F.col("w") == 0)).alias("not_in_input"),
    )
    return checks.withColumn(
        "passed", (F.col("in_both") == 0) & (F.col("in_neither") == 0) & (F.col("not_in_input") == 0)
    )


# --- feature vectors --------------------------------------------------------------------------------


@dataclass(frozen=True)
class FeatureSpec:
    """What fitting learned: a few numbers per column, and the slot table with every category."""

    numeric: list[str]
    fill: dict[str, float]
    scale: dict[str, tuple[float, float]]
    texts: list[str]
    category_fill: dict[str, str]
    counts: dict[str, int]  # categories per text column
    literals: dict[str, list[tuple[str, int, float]]]  # (value, slot, weight) of columns with few categories
    slots: DataFrame
    path: str

    @property
    def size(self) -> int:
        return len(self.numeric) + sum(self.counts.values())

    @cached_property
    def categories(self) -> dict[str, list[str]]:
        """All categories on the driver; no operator of this library asks for them."""
        return {c: list(n) for c, n in category_counts(self.slots).items()}

    def names(self) -> DataFrame:
        """(slot, feature) in the cluster."""
        return self.slots.select("slot", F.concat_ws("_", "column", "value").alias("feature"))

    def pipeline(self, df: DataFrame) -> Encoder:
        missing = [c for c in [*self.numeric, *self.texts] if c not in df.columns]
        if missing:
            raise ValueError(f"no columns {', '.join(missing)}")
        return Encoder(self)


@dataclass(frozen=True)
class Encoder:
    """Turns rows into their non-zero features."""

    spec: FeatureSpec

    def _joined(self, df: DataFrame) -> tuple[DataFrame, Column, list[str]]:
        """The rows beside their dictionary entries, an array of (slot, value) in slot order, and the added columns.

        A column with few categories looks them up among literals. Any other one joins its part of the slot table, which
        Spark broadcasts or shuffles by its size; a category that a third of the rows share is split by the skew join.
        An unseen category, or a missing one without fill, has no slot.
        """
        spec, prefix = self.spec, "_e"
        while any(c.startswith(prefix) for c in df.columns):
            prefix += "_"
        numbers = []
        for i, c in enumerate(spec.numeric):
            mean, std = spec.scale[c]
            x = F.coalesce(present(df, c).cast("double"), F.lit(float(spec.fill[c])))
            numbers.append(F.struct(F.lit(i).alias("slot"), ((x - mean) / (std or 1.0)).alias("value")))
        hits, added, rows = [], [], df
        for i, c in enumerate(spec.texts):
            cell = text_cells(df, [c])[0]
            if c in spec.category_fill:
                cell = F.coalesce(cell, F.lit(spec.category_fill[c]))
            if c in spec.literals:
                values, slots, weights = (F.array(*[F.lit(x[k]) for x in spec.literals[c]]) for k in range(3))
                at = F.nullif(F.array_position(values, cell), F.lit(0).cast("long")).cast("int") - 1
                slot, weight = F.get(slots, at), F.get(weights, at)
            else:
                value, slot, weight = (f"{prefix}{kind}{i}" for kind in ("v", "s", "w"))
                own = spec.slots.where((F.col("column") == c) & F.col("value").isNotNull())
                own = own.select(F.col("value").alias(value), F.col("slot").cast("int").alias(slot), F.col("weight").alias(weight))
                rows = rows.join(own, cell == F.col(value), "left")
                added += [value, slot, weight]
                slot, weight = F.col(slot), F.col(weight)
            hits.append(F.when(slot.isNotNull(), F.struct(slot.alias("slot"), weight.alias("value"))))
        kind = "array<struct<slot:int,value:double>>"
        return rows, F.concat(F.array(*numbers).cast(kind), F.array_compact(F.array(*hits)).cast(kind)), added

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with a sparse ``features`` vector; which slot is which feature is in the slot table it names."""
        rows, cells, added = self._joined(df)
        parts = F.struct(
            F.lit(0).cast("tinyint").alias("type"), F.lit(self.spec.size).alias("size"),
            cells["slot"].alias("indices"), cells["value"].alias("values"),
        )
        vector = T.StructType([T.StructField("features", VectorUDT())])
        # a vector is this struct to Spark, but no cast leads there; its JSON reader does
        built = F.from_json(F.to_json(F.struct(parts.alias("features"))), vector)["features"]
        found = rows.withColumn("features", built).drop(*added)
        return found.withMetadata("features", {"ml_attr": {"num_attrs": self.spec.size}, "slots": self.spec.path})

    def cells(self, df: DataFrame, key: str) -> DataFrame:
        """(key, slot, value): the encoded matrix without its zeros, one row per cell."""
        rows, cells, _ = self._joined(df)
        return rows.select(key, F.inline(cells)).where(F.col("value") != 0)


def _feature_columns(df: DataFrame, exclude) -> tuple[list[str], list[str]]:
    numeric = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in exclude
    ]
    return numeric, roles.categorical_columns(df, exclude)


def _spec(slots: DataFrame, numeric, fill, scale, texts, fill_mode: bool) -> FeatureSpec:
    """Reads a few numbers per text column off the slot table, and the categories of those with few."""
    entry = F.when(F.col("value").isNotNull(), F.struct("slot", "value", "weight"))
    columns = slots.where(F.col("value").isNotNull()).groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"), F.min("slot").alias("low"))
    found = {r["column"]: r for r in columns.collect()}
    few = [c for c, r in found.items() if r["n"] <= LITERALS]
    literals: dict[str, list] = {c: [] for c in few}
    if few:
        held = slots.where(F.col("column").isin(few)).select("column", entry.alias("e")).where(F.col("e").isNotNull())
        for r in held.orderBy("e").collect():  # at most LITERALS per column
            literals[r["column"]].append((r["e"]["value"], r["e"]["slot"], r["e"]["weight"]))
    texts = [c for c in texts if c in found]
    path = slots.inputFiles()[0].rsplit("/", 1)[0]
    return FeatureSpec(
        numeric=numeric, fill=fill, scale=scale, texts=texts, counts={c: found[c]["n"] for c in texts},
        category_fill={c: found[c]["mode"] for c in texts} if fill_mode else {}, literals=literals, slots=slots, path=path,
    )


def fit_features(train: DataFrame, exclude=()) -> FeatureSpec:
    """Median fill and scaling for numbers, mode fill and one-hot for texts, learned from the training rows."""
    numeric, texts = _feature_columns(train, exclude)
    stats = moments(train, numeric)
    numeric = [c for c in numeric if stats[c].present]  # a column without any value has nothing to learn
    fill = medians(train, numeric)
    slots = _slots(train, {c: stats[c].present for c in numeric}, texts, F.lit(1.0))
    return _spec(slots, numeric, fill, {c: stats[c].filled(fill[c]) for c in numeric}, texts, fill_mode=True)


def fit_segment_features(df: DataFrame, features: list[str]) -> FeatureSpec:
    """Mean fill and scaling for numbers; dummies, scaled as well, for texts.

    Dummies are not centred: distances between rows stay the same and the vectors stay sparse.
    """
    chosen = df.select(*features)
    numeric, texts = _feature_columns(chosen, ())
    stats = moments(chosen, numeric)
    numeric = [c for c in numeric if stats[c].present]
    share = F.col("n") / F.lit(chosen.count() if texts else 1)
    weight = F.when(share < 1, 1 / F.sqrt(share * (1 - share))).otherwise(1.0)
    slots = _slots(chosen, {c: stats[c].present for c in numeric}, texts, weight)
    means = {c: stats[c].mean for c in numeric}
    return _spec(slots, numeric, means, {c: stats[c].filled(means[c]) for c in numeric}, texts, fill_mode=False)


def feature_names(df: DataFrame, column: str = "features") -> list[str]:
    """Encoded feature names, in vector order, as a list: from the slot table that the column names, else from its ML
    attributes. ``FeatureSpec.names`` leaves them in the cluster."""
    metadata = df.schema[column].metadata
    if "slots" in metadata:
        slots = df.sparkSession.read.parquet(metadata["slots"]).orderBy("slot")
        return [r[0] for r in slots.select(F.concat_ws("_", "column", "value")).collect()]
    attributes = metadata.get("ml_attr", {})
    slots = [a for group in attributes.get("attrs", {}).values() for a in group]
    names = {a["idx"]: a.get("name") for a in slots}
    size = attributes.get("num_attrs", len(names))
    if len(names) != size or any(n is None for n in names.values()):
        raise ValueError(f"'{column}' carries names for {len(names)} of {size} features")
    return [names[i].split("__", 1)[-1] for i in range(size)]
