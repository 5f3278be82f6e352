"""Churn label: domain checks and normalisation to 0/1.

A label with at most two values is fully described by its minimum and maximum, so one global
min/max (a single row from each task) replaces a shuffle of distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Label pairs read as (not churned, churned), compared in lower case.
KNOWN_PAIRS = (("no", "yes"), ("false", "true"), ("0", "1"))


def _comparable(df: DataFrame, label: str) -> Column:
    kind = df.schema[label].dataType
    column = F.col(label)
    if isinstance(kind, T.StringType):
        return F.lower(column)
    if isinstance(kind, T.BooleanType):
        return column.cast("int")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column)
    return column


def normalize_label(df: DataFrame, label: str, out: str = "churned") -> DataFrame:
    """Add ``out`` as INT 0/1; a missing label stays NULL, a third value or a lone unknown value is an error."""
    value = _comparable(df, label)
    ends = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    lo, hi = ends["lo"], ends["hi"]
    if isinstance(df.schema[label].dataType, T.StringType):
        pairs = KNOWN_PAIRS
    else:
        pairs = ((0, 1),)
    mapped = F.when(value.isNull(), None)
    for no, yes in pairs:
        mapped = mapped.when(lo.isin(no, yes) & hi.isin(no, yes) & value.isin(no, yes), (value == yes).cast("int"))
    mapped = (
        mapped.when(lo == hi, F.raise_error(F.lit(f"label '{label}' has a single value that is not a known label")))
        .when(value == lo, 0)
        .when(value == hi, 1)
        .otherwise(F.raise_error(F.lit(f"label '{label}' has more than two values")))
    )
    return df.withColumn(out, mapped.cast("int"))


def label_check(df: DataFrame, label: str) -> DataFrame:
    """One row (check, passed, detail): at most two distinct values, missing ones not counted."""
    value = _comparable(df, label).alias("v")
    distinct = df.select(value).where(F.col("v").isNotNull()).distinct().limit(3)
    return distinct.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("label_values").alias("check"),
        (F.col("n") <= 2).alias("passed"),
        F.when(F.col("n") <= 2, F.concat(F.col("n").cast("string"), F.lit(" distinct values")))
        .otherwise(F.lit("more than two distinct values"))
        .alias("detail"),
    )


def label_domain(df: DataFrame, label: str) -> DataFrame:
    """(domain, n_outside, passed): how many distinct label values fall outside each known pair."""
    value = _comparable(df, label).cast("string").alias("v")
    values = df.select(value).where(F.col("v").isNotNull()).distinct()
    outside = [
        F.count_if(~F.col("v").isin(no, yes)).alias(f"{no}/{yes}") for no, yes in KNOWN_PAIRS
    ]
    names = [f"{no}/{yes}" for no, yes in KNOWN_PAIRS]
    return (
        values.agg(*outside)
        .unpivot([], names, "domain", "n_outside")
        .withColumn("passed", F.col("n_outside") == 0)
    )


def target_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
