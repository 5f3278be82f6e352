"""Running totals and ranks within groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ebbtide.session import stage


def running_total(df: DataFrame, group: list[str], order: list[str], weight: Column, name: str = "before") -> DataFrame:
    """Adds the total weight of the earlier rows of the same group; ``order`` decides, NULLs first.

    Rows are range-partitioned by group and order, so a hot group lies in many partitions. Totals run inside each
    (group, partition) and start at the sum of the group's earlier partitions, of which there are few.
    """
    held = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),  # so that no column can clash with the names below
        weight.alias("w"), *[F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(group)],
        *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)],
    )
    groups, orders = [f"g{i}" for i in range(len(group))], [f"o{i}" for i in range(len(order))]
    rows = stage(held.repartitionByRange(*groups, *orders).withColumn("part", F.spark_partition_id()), "dealt")
    inside = W.partitionBy(*groups, "part").orderBy(*orders).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(*groups, "part").agg(F.sum("w").alias("w"))
    earlier = W.partitionBy(*groups).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(g).alias(f"of_{g}") for g in groups], F.col("part").alias("at"), F.sum("w").over(earlier).alias("start"))
    same = reduce(
        Column.__and__, [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in groups], F.col("part") == F.col("at"))
    local = F.coalesce(F.sum("w").over(inside), F.lit(0))
    found = rows.withColumn("local", local).join(starts, same)
    total = (F.col("local") + F.coalesce("start", F.lit(0))).alias(name)
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns], total)
