"""Small DataFrame shaping helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fan_out(df: DataFrame, keep: list[str], rows: list[Column]) -> DataFrame:
    """One output row per struct in ``rows`` for each input row; no join, no shuffle."""
    return df.select(*keep, F.inline(F.array(*rows)))


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL."""
    column = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column)
    return column


def unfold(df: DataFrame, cells: list[Column], keep: list[str] | None = None) -> DataFrame:
    """(keep..., slot INT, value): one row per cell, ``slot`` being the cell's place in ``cells``.

    A number is a cheaper grouping key than a column name; :func:`named` puts the names back on results.
    """
    return df.select(*(keep or []), F.posexplode(F.array(*cells)).alias("slot", "value"))


def named(df: DataFrame, names: list[str], slot: str = "slot", out: str = "column") -> DataFrame:
    """Replace ``slot`` by the name at that place."""
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col(slot)).alias(out)
    return df.select(*[name if c == slot else F.col(c) for c in df.columns])


def number_cells(df: DataFrame, columns: list[str]) -> list[Column]:
    return [present(df, c).cast("double") for c in columns]


def text_cells(df: DataFrame, columns: list[str]) -> list[Column]:
    cells = []
    for c in columns:
        cell = present(df, c)
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            cell = cell + F.lit(0.0)  # -0.0 and 0.0 are one value
        cells.append(cell.cast("string"))
    return cells


def long_numbers(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., column, value DOUBLE), one row per cell, missing cells left out."""
    return named(unfold(df, number_cells(df, columns), keep).where(F.col("value").isNotNull()), columns)


def long_texts(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., column, value STRING), one row per cell, missing cells kept as NULL."""
    return named(unfold(df, text_cells(df, columns), keep), columns)
