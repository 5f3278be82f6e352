"""Exact order statistics and interpolated quantiles for tables of any size and any number of keys.

A first read sketches every key's values; the sketch's error is bounded, so two of its values enclose each wanted rank
for sure. A second read counts the rows below each bracket, which every task sends as one number, and the equal values
inside, a thousandth of all or so. Running totals over these few (:mod:`ebbtide.functions.ranking`) find the value at
each rank. No task needs a whole column, and what is shuffled does not grow with the number of distinct values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.ranking import running_total
from ebbtide.functions.shaping import named, number_cells, unfold
from ebbtide.session import stage

ACCURACY = 4_000  # a sketched rank is off by one in so many at most
# With this many values or fewer a bracket of twice the error would be narrower than a few ranks: all are counted.
FEW = 2 * ACCURACY


def bracketed_runs(long: DataFrame, probabilities: list[float], key: str = "column", value: str = "value") -> DataFrame:
    """(key, value, n, before, total): distinct values near the wanted ranks with their rows, the rows below them and all
    rows of their key. Every value whose rank is within two of ``p * total`` is there.

    Missing values are left out, NaN among them; a NULL key is a key.
    """
    x = F.col(value).cast("double")
    present = long.select(F.col(key).alias("_key"), F.nanvl(x, F.lit(None)).alias("_x")).where(F.col("_x").isNotNull())
    wide = 2 / ACCURACY
    ends = sorted({min(max(p + d, 0.0), 1.0) for p in probabilities for d in (-wide, wide)})
    sketched = present.groupBy("_key").agg(
        F.count(F.lit(1)).alias("total"), F.percentile_approx("_x", ends, ACCURACY).alias("at"))
    few = F.col("total") <= FEW
    brackets = []
    for i, p in enumerate(probabilities):
        low, high = (F.get("at", F.lit(ends.index(min(max(p + d, 0.0), 1.0)))) for d in (-wide, wide))
        brackets += [F.when(few, float("-inf")).otherwise(low).alias(f"low{i}"), F.when(few, float("inf")).otherwise(high).alias(f"high{i}")]
    found = stage(sketched.select(F.col("_key").alias("_of"), "total", *brackets), "brackets")

    each = present.join(found, F.col("_key").eqNullSafe(F.col("_of")))  # a row per key, broadcast if Spark finds it small
    numbers = range(len(probabilities))
    inside = reduce(Column.__or__, [F.col("_x").between(F.col(f"low{i}"), F.col(f"high{i}")) for i in numbers])
    # rows outside count where the next bracket begins; beyond the last bracket nobody asks for them
    later = [F.when(F.col(f"low{i}") > F.col("_x"), F.col(f"low{i}")) for i in numbers]
    following = F.least(*later) if len(later) > 1 else later[0]
    counted = each.select("_key", "total", inside.alias("inside"), F.when(inside, F.col("_x")).otherwise(following).alias("edge"))
    counted = counted.where(F.col("edge").isNotNull()).groupBy("_key", "total", "edge", "inside").agg(F.count(F.lit(1)).alias("n"))
    runs = running_total(stage(counted, "counted"), ["_key"], ["edge", "inside"], F.col("n"))
    return runs.where("inside").select(F.col("_key").alias(key), F.col("edge").alias("value"), "n", "before", "total")


def at_rank(runs: DataFrame, rank: Column) -> DataFrame:
    """The runs that hold a 0-based rank, which may depend on ``total``."""
    return runs.where((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")))


def quantiles_of(runs: DataFrame, probabilities: list[float], key: str = "column") -> DataFrame:
    """(key, q, value): linearly interpolated quantiles of each key's runs."""
    each = runs.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in probabilities])))
    place = F.col("q") * (F.col("total") - 1)
    low = F.floor(place)
    high = F.least(low + 1, F.col("total") - 1)

    def holds(rank):
        return (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))

    ends = each.where(holds(low) | holds(high)).groupBy(key, "q").agg(
        F.max(F.when(holds(low), F.col("value"))).alias("a"),
        F.max(F.when(holds(high), F.col("value"))).alias("b"),
        F.max(place - low).alias("share"),
    )
    return ends.select(key, "q", (F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("value"))


def exact_quantiles(long: DataFrame, probabilities: list[float], key: str = "column", value: str = "value") -> DataFrame:
    """(key, q, value) of a (key, value) table."""
    return quantiles_of(bracketed_runs(long, probabilities, key, value), probabilities, key)


def column_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """(column, q, value) for numeric columns."""
    long = unfold(df, number_cells(df, columns))
    return named(exact_quantiles(long, probabilities, key="slot"), columns)
