"""Table profile: shape, missing values, duplicates, descriptions, frequencies, bins and correlations."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ebbtide.functions import roles
from ebbtide.functions.shaping import fan_out, named, number_cells, present, text_cells, unfold
from ebbtide.operators.quantiles import column_quantiles, exact_quantiles
from ebbtide.session import stage

# Sizes of the report.
MIN_ROWS = 10
PREVIEW_ROWS = 10
TOP_VALUES = 5
QUARTILES = [0.25, 0.5, 0.75]
WHISKER = 1.5
HISTOGRAM_BINS = 30  # ours: the charts this stands for leave the bin count to the drawing library

FLAT = 1e-11  # share of the squares that rounding may leave as spread where a pair's rows are all equal


def validate_table(df: DataFrame, label: str | None = None, time_column: str | None = None) -> DataFrame:
    """Rows (check, passed, detail): enough rows, a churn column and, if asked for, a numeric time column.

    Reading stops at the tenth row.
    """
    target = label or roles.target_column(df)
    checks = [
        F.struct(
            F.lit("min_rows").alias("check"),
            (F.col("n") >= MIN_ROWS).alias("passed"),
            F.when(F.col("n") >= MIN_ROWS, F.lit(f"at least {MIN_ROWS} rows"))
            .otherwise(F.concat(F.col("n").cast("string"), F.lit(f" rows, {MIN_ROWS} needed")))
            .alias("detail"),
        ),
        F.struct(
            F.lit("target_column").alias("check"),
            F.lit(target is not None and target in df.columns).alias("passed"),
            F.lit(target or "no column name contains churn").alias("detail"),
        ),
    ]
    if time_column is not None:
        kind = df.schema[time_column].dataType
        checks.append(
            F.struct(
                F.lit("numeric_time").alias("check"),
                F.lit(isinstance(kind, T.NumericType)).alias("passed"),
                F.lit(f"{time_column} {kind.simpleString()}").alias("detail"),
            )
        )
    return fan_out(df.limit(MIN_ROWS).agg(F.count(F.lit(1)).alias("n")), [], checks)


def table_shape(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, role, and whether its name suits a cohort, time or segment axis."""
    segmenting = set(roles.segmentation_defaults(df))
    rows = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.lit(roles.column_role(df, f.name)).alias("role"),
            F.lit(roles.matches(f.name, roles.COHORT_TERMS)).alias("cohort_like"),
            F.lit(roles.matches(f.name, roles.TIME_TERMS)).alias("time_like"),
            F.lit(f.name in segmenting).alias("segmentation_default"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    counted = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))
    return fan_out(counted, ["n_rows", "n_columns"], rows)


def cell_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) over all cells; each task sends a value once, however often it holds it."""
    cells = unfold(df, text_cells(df, columns)).groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
    return named(cells, columns)


def _counted_cells(df: DataFrame) -> DataFrame:
    """(column, n_rows, missing, distinct_values). Columns of like type are unfolded together and keep that type."""
    kinds: dict[str, list[str]] = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.IntegralType):
            kinds.setdefault("bigint", []).append(f.name)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            kinds.setdefault("double", []).append(f.name)
        else:
            kinds.setdefault("string", []).append(f.name)
    parts = []
    for kind, columns in kinds.items():
        cells = unfold(df, [present(df, c).cast(kind) for c in columns])
        values = cells.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
        counted = values.groupBy("slot").agg(
            F.sum("n").alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
            F.count("value").alias("distinct_values"),
        )
        slots = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("slot"))
        whole = slots.join(counted, "slot", "left").na.fill(0, ["n_rows", "missing", "distinct_values"])
        parts.append(named(whole, columns))
    return functools.reduce(DataFrame.unionByName, parts)


def column_profile(df: DataFrame, distinct: str = "exact") -> DataFrame:
    """(column, missing, missing_pct, distinct_values) for every column.

    ``distinct`` is "exact", "approx" (one pass, no shuffle of values) or "none".
    """
    if distinct == "exact":
        cells = _counted_cells(df)
    else:
        aggregates = [F.count(F.lit(1)).alias("n_rows")]
        rows = []
        for i, c in enumerate(df.columns):
            cell = present(df, c)
            aggregates.append(F.count_if(cell.isNull()).alias(f"m{i}"))
            fields = [F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")]
            if distinct == "approx":
                aggregates.append(F.approx_count_distinct(cell).alias(f"d{i}"))
                fields.append(F.col(f"d{i}").alias("distinct_values"))
            else:
                fields.append(F.lit(None).cast("bigint").alias("distinct_values"))
            rows.append(F.struct(*fields))
        cells = fan_out(df.agg(*aggregates), ["n_rows"], rows)
    return cells.select(
        "column",
        "missing",
        F.try_divide(100.0 * F.col("missing"), F.col("n_rows")).alias("missing_pct"),
        "distinct_values",
    )


def missing_columns(df: DataFrame) -> DataFrame:
    """Columns with at least one missing value, worst first."""
    found = column_profile(df, distinct="none").where(F.col("missing") > 0)
    return found.select("column", "missing", "missing_pct").orderBy(F.desc("missing"), "column")


def _fingerprint(columns: list[str]) -> list[Column]:
    """128 bits of a row in two columns; equal rows have equal ones."""
    return [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows, rows that repeat an earlier one in every column (NULL equals NULL), and their share.

    Fingerprints are counted first, so that of most rows only sixteen bytes are shuffled. Rows whose fingerprint comes up
    more than once are then compared in full; different rows that share one do not count.
    """
    rows = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    marked = rows.select(*rows.columns, *[f.alias(f"f{i}") for i, f in enumerate(_fingerprint(rows.columns))])
    counted = marked.groupBy("f0", "f1").agg(F.count(F.lit(1)).alias("n"))
    repeated = stage(counted.where("n > 1").select("f0", "f1"), "repeated")
    groups = marked.join(repeated, ["f0", "f1"], "left_semi").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    found = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return found.select(
        total.alias("n_rows"), "duplicates", F.try_divide(100.0 * F.col("duplicates"), total).alias("duplicate_pct"))


def numeric_describe(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max). ``exact=False`` takes quartiles from a sketch."""
    columns = columns or roles.numeric_columns(df)
    aggregates = []
    for i, c in enumerate(columns):
        x = present(df, c)
        aggregates += [
            F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
            F.min(x).cast("double").alias(f"l{i}"), F.max(x).cast("double").alias(f"h{i}"),
        ]
        if not exact:
            aggregates.append(F.percentile_approx(x.cast("double"), QUARTILES, 10_000).alias(f"q{i}"))
    found = df.agg(*aggregates).first()  # one number per column and statistic
    rows = [
        (c, found[f"n{i}"], *[found[f"{s}{i}"] for s in "asl"], *([] if exact else found[f"q{i}"] or [None] * 3), found[f"h{i}"])
        for i, c in enumerate(columns)
    ]
    names = ["column string", "count bigint", "mean double", "std double", "min double", "max double"]
    if not exact:
        names[5:5] = ["q25 double", "q50 double", "q75 double"]
    described = df.sparkSession.createDataFrame(rows, ", ".join(f"`{n.split()[0]}` {n.split()[1]}" for n in names))
    if exact:
        quartiles = quartile_columns(column_quantiles(df, columns, QUARTILES), "column")
        described = described.join(F.broadcast(quartiles), "column", "left")  # a row per column on both sides
    return described.select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def quartile_columns(quantiles: DataFrame, key: str) -> DataFrame:
    """Turn (key, q, value) rows into q25, q50 and q75 columns."""
    names = ["q25", "q50", "q75"]
    return quantiles.groupBy(key).agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for q, n in zip(QUARTILES, names)]
    )


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = TOP_VALUES) -> DataFrame:
    """(column, value, n, position): the k most frequent values of each column, ties to the smaller value.

    Spark cuts every task's rows to k per column before the ranking shuffle.
    """
    columns = columns or roles.categorical_columns(df)
    ranked = cell_counts(df, columns).where(F.col("value").isNotNull())
    order = W.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return ranked.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, distinct_values), missing values not counted."""
    return cell_counts(df, columns).groupBy("column").agg(F.count("value").alias("distinct_values"))


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def category_by_target(df: DataFrame, column: str, label: str) -> DataFrame:
    kept = df.where(F.col(column).isNotNull() & F.col(label).isNotNull())
    return kept.groupBy(F.col(column).alias("category"), F.col(label).alias("class")).agg(
        F.count(F.lit(1)).alias("n")
    )


def histogram(df: DataFrame, column: str, by: str | None = None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, bin_lo, bin_hi, [by], n) over equal-width bins between the column's ends; empty bins are left out."""
    x = present(df, column).cast("double")
    ends = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    kept = df.select(x.alias("x"), *([by] if by else []), ends.alias("ends")).where(F.col("x").isNotNull())
    lo, width = F.col("ends.lo"), (F.col("ends.hi") - F.col("ends.lo")) / bins
    place = F.coalesce(F.floor(F.try_divide(F.col("x") - lo, width)), F.lit(0))
    binned = kept.withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int")).groupBy(
        "bin", "ends", *([by] if by else [])
    ).agg(F.count(F.lit(1)).alias("n"))
    return binned.select(
        "bin", (lo + F.col("bin") * width).alias("bin_lo"), (lo + (F.col("bin") + 1) * width).alias("bin_hi"),
        *([by] if by else []), "n",
    )


def box_stats(df: DataFrame, column: str, by: str) -> DataFrame:
    """Per group: quartiles (linear), whiskers at the last values within 1.5 interquartile ranges, outliers.

    Once the quartiles are known, one aggregate over the rows finds whiskers and outliers.
    """
    long = df.select(F.col(by).cast("string").alias("group"), present(df, column).cast("double").alias("value"))
    long = long.where(F.col("group").isNotNull() & F.col("value").isNotNull())
    quartiles = quartile_columns(exact_quantiles(long, QUARTILES, key="group"), "group")
    reach = WHISKER * (F.col("q75") - F.col("q25"))
    fenced = stage(quartiles.withColumn("low_fence", F.col("q25") - reach).withColumn("high_fence", F.col("q75") + reach), "fences")
    x = F.col("value")
    within = (x >= F.col("low_fence")) & (x <= F.col("high_fence"))
    return (
        long.join(fenced, "group")
        .groupBy("group", "q25", "q50", "q75")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(within, x)).alias("low_whisker"),
            F.max(F.when(within, x)).alias("high_whisker"),
            F.count_if(~within).alias("outliers"),
        )
    )


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_x, column_y, correlation): Pearson over the rows where both are present, for every ordered pair.

    NULL where a column does not vary over the rows of a pair. One pass finds means and constant columns; a second one
    adds up, in every task, the products of all pairs of centred columns as matrices over Arrow batches. What a task
    sends is one row per pair, whatever the number of rows.
    """
    columns = columns or roles.numeric_columns(df)
    numbers = df.select(*[x.alias(f"c{i}") for i, x in enumerate(number_cells(df, columns))])
    found = numbers.agg(*[
        f(f"c{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg))
    ]).first()
    varying = np.array([found[f"lo{i}"] != found[f"hi{i}"] for i in range(len(columns))])
    means = np.array([0.0 if found[f"mean{i}"] is None else found[f"mean{i}"] for i in range(len(columns))])
    i, j, sums = "i int, j int", range(len(columns)), ["n", "x", "y", "xx", "yy", "xy"]

    def products(batches):
        total = np.zeros((6, len(j), len(j)))
        for batch in batches:
            cells = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            there = ~np.isnan(cells)
            x, here = np.where(there, cells - means, 0.0), there.astype(float)
            s, q = x.T @ here, (x * x).T @ here
            total += np.stack([here.T @ here, s, s.T, q, q.T, x.T @ x])
        a, b = np.indices(total.shape[1:]).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *map(pa.array, total.reshape(6, -1))], names=["i", "j", *sums])

    parts = numbers.mapInArrow(products, f"{i}, {', '.join(f'{s} double' for s in sums)}")
    whole = parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in sums])
    spread_x = F.col("n") * F.col("xx") - F.col("x") * F.col("x")
    spread_y = F.col("n") * F.col("yy") - F.col("y") * F.col("y")
    moves = F.array(*[F.lit(bool(v)) for v in varying])
    varies = F.get(moves, F.col("i")) & F.get(moves, F.col("j"))
    varies = varies & (spread_x > FLAT * F.col("n") * F.col("xx")) & (spread_y > FLAT * F.col("n") * F.col("yy"))
    product = (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(spread_x * spread_y)
    pairs = whole.select("i", "j", F.when(varies, product).alias("correlation"))
    return named(named(pairs, columns, "i", "column_x"), columns, "j", "column_y")


def correlation_with(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, correlation) of each column with one other, in a single aggregate; as in :func:`correlation_matrix`."""
    y = present(df, target).cast("double")
    measures = []
    for i, x in enumerate(number_cells(df, columns)):
        a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        measures.append(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"r{i}"))
    return fan_out(df.agg(*measures), [], [
        F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("correlation")) for i, c in enumerate(columns)
    ])


def preview(df: DataFrame, key: str, n: int = PREVIEW_ROWS) -> DataFrame:
    """First rows by key: a distributed table has no row order of its own."""
    return df.orderBy(key).limit(n)


def churn_overview(df: DataFrame, label: str) -> DataFrame:
    """One row: customers, churned, churn rate in percent of the labelled ones, and customers without a label."""
    return df.agg(
        F.count(F.lit(1)).alias("customers"),
        F.coalesce(F.sum(F.col(label).cast("bigint")), F.lit(0)).alias("churned"),
        (100.0 * F.avg(label)).alias("churn_rate_pct"),
        F.count_if(F.col(label).isNull()).alias("unlabelled"),
    )
