"""Column roles guessed from names and types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Lower-cased name parts that mark a column's role.
TARGET_TERMS = ("churn",)
COHORT_TERMS = ("date", "month", "year", "join", "start", "signup", "register", "onboard")
TIME_TERMS = ("tenure", "time", "period", "duration", "month", "day", "year")
DATE_TERMS = ("date", "time", "day")
SEGMENTATION_TERMS = ("tenure", "monthly", "charge", "usage", "spend", "revenue")
SEGMENTATION_DEFAULTS = 5


def matches(name: str, terms) -> bool:
    return any(term in name.lower() for term in terms)


def target_column(df: DataFrame) -> str | None:
    """First column whose name marks it as the churn label."""
    return next((c for c in df.columns if matches(c, TARGET_TERMS)), None)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def cohort_candidates(df: DataFrame) -> list[str]:
    return [c for c in df.columns if matches(c, COHORT_TERMS)]


def date_candidates(df: DataFrame) -> list[str]:
    dates = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, dates) or matches(f.name, DATE_TERMS)]


def segmentation_defaults(df: DataFrame) -> list[str]:
    target = target_column(df)
    chosen = [c for c in df.columns if c != target and matches(c, SEGMENTATION_TERMS)]
    return chosen[:SEGMENTATION_DEFAULTS]


def column_role(df: DataFrame, name: str) -> str:
    """target, numeric, categorical, boolean, date or ignored."""
    if name == target_column(df):
        return "target"
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, T.StringType):
        return "categorical"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "ignored"
