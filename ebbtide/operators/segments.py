"""Reports on a segment column: sizes, churn, profiles, tiers and priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ebbtide.functions.shaping import long_texts, present

# Churn-rate cuts (a rate must lie above the cut) and the half-side of the centroid box.
RISK_TIERS = ((0.30, "high"), (0.15, "medium"))
LOWEST_TIER = "low"
PRIORITIES = ((0.40, "critical"), (0.25, "high"))
LOWEST_PRIORITY = "moderate"
EXPANSION = "expansion"
RANKED_SEGMENTS = 2
CENTROID_BOX = 0.5


def segment_distribution(df: DataFrame, segment: str = "segment") -> DataFrame:
    return df.where(F.col(segment).isNotNull()).groupBy(segment).agg(F.count(F.lit(1)).alias("n"))


def churn_rate_by_group(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, n, churn_rate), lowest rate first; ``n`` counts all rows of the group."""
    return (
        df.where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("churn_rate"))
        .orderBy("churn_rate", group)
    )


def segment_summary(df: DataFrame, segment: str, label: str) -> DataFrame:
    """(segment, size, proportion, churn_rate): size, share and rate come out of one aggregation."""
    sizes = (
        df.where(F.col(segment).isNotNull())
        .groupBy(segment)
        .agg(F.count(F.lit(1)).alias("size"), F.avg(label).alias("churn_rate"))
    )
    return share_of_total(sizes, "size").select(segment, "size", "proportion", "churn_rate")


def share_of_total(sizes: DataFrame, size: str) -> DataFrame:
    """Add ``proportion`` to a table with one row per group."""
    return sizes.withColumn("proportion", F.col(size) / F.sum(size).over(W.partitionBy()))


def segment_bubble(df: DataFrame, segment: str, label: str) -> DataFrame:
    return segment_summary(df, segment, label).select(segment, "churn_rate", "size")


def segment_profile(df: DataFrame, segment: str, features: list[str]) -> DataFrame:
    """Per segment the mean of each numeric feature and the commonest value of each text feature."""
    texts = [f for f in features if isinstance(df.schema[f].dataType, T.StringType)]
    numbers = [f for f in features if f not in texts]
    kept = df.where(F.col(segment).isNotNull())
    profile = kept.groupBy(segment).agg(*[F.avg(present(df, f).cast("double")).alias(f) for f in numbers]) \
        if numbers else kept.select(segment).distinct()
    if texts:
        counts = long_texts(kept, texts, [segment]).where(F.col("value").isNotNull())
        counts = counts.groupBy(segment, "column", "value").agg(F.count(F.lit(1)).alias("n"))
        order = W.partitionBy(segment, "column").orderBy(F.desc("n"), "value")
        modes = counts.withColumn("rn", F.row_number().over(order)).where(F.col("rn") == 1)
        wide = modes.groupBy(segment).pivot("column", texts).agg(F.first("value"))
        profile = profile.join(wide, segment, "left")
    return profile.select(segment, *features)


def segment_profile_long(df: DataFrame, segment: str, features: list[str]) -> DataFrame:
    """(segment, feature, value) for numeric features."""
    return segment_profile(df, segment, features).unpivot(segment, features, "feature", "value")


def segment_centroids(df: DataFrame, segment: str, x: str, y: str) -> DataFrame:
    """Box of half-side 0.5 around each segment's mean of two features."""
    means = df.where(F.col(segment).isNotNull()).groupBy(segment).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"))
    return means.select(
        segment,
        (F.col("cx") - CENTROID_BOX).alias("x_min"), (F.col("cy") - CENTROID_BOX).alias("y_min"),
        (F.col("cx") + CENTROID_BOX).alias("x_max"), (F.col("cy") + CENTROID_BOX).alias("y_max"),
    )


def _graded(rate, cuts, lowest):
    grade = F.when(rate.isNull(), None)
    for cut, name in cuts:
        grade = grade.when(rate > cut, name)
    return grade.otherwise(lowest)


def segment_risk_tier(summary: DataFrame) -> DataFrame:
    """Add ``tier`` to a segment summary."""
    return summary.withColumn("tier", _graded(F.col("churn_rate"), RISK_TIERS, LOWEST_TIER))


def segment_priority(summary: DataFrame, segment: str = "segment", k: int = RANKED_SEGMENTS) -> DataFrame:
    """The k segments with the highest churn, graded, and the k with the lowest, marked for expansion.

    With fewer than 2k segments one segment can be in both lists and then has two rows.
    """
    high = W.orderBy(F.desc("churn_rate"), segment)  # one row per segment
    low = W.orderBy("churn_rate", F.desc(segment))
    rated = summary.where(F.col("churn_rate").isNotNull())
    ranked = rated.select("*", F.row_number().over(high).alias("from_top"), F.row_number().over(low).alias("from_bottom"))
    entries = F.array(
        F.when(F.col("from_top") <= k, F.struct(
            F.lit("high_risk").alias("list"), F.col("from_top").alias("position"),
            _graded(F.col("churn_rate"), PRIORITIES, LOWEST_PRIORITY).alias("priority"),
        )),
        F.when(F.col("from_bottom") <= k, F.struct(
            F.lit("low_risk").alias("list"), F.col("from_bottom").alias("position"),
            F.lit(EXPANSION).alias("priority"),
        )),
    )
    kept = ranked.select(segment, "size", "proportion", "churn_rate", F.explode(F.array_compact(entries)).alias("e"))
    return kept.select(segment, "size", "proportion", "churn_rate", "e.*")
