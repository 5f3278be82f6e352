"""Advice as evidence: which keyword rules the features of a (feature, importance) table set off, and by what.

Keywords, rule order and list lengths are fixed values. Rules are constants of the query, so they are unfolded against
the features instead of joined. Texts for people are left to whoever shows the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# List lengths of the report.
TOP_CHART = 15
TOP_RULES = 5
MIN_RECOMMENDATIONS = 3

# Insight keywords in report order.
THEMES = ("contract", "tenure", "monthly", "service", "support", "payment", "dependents")

# Keywords that must all be in one feature name, in report order; no keywords means always.
ACTIONS = (("contract",), ("tenure",), ("monthly", "charge"), ("service",), ("support",), (), ())

# Keywords of which any may be in a feature name, in report order; no keywords marks a general rule.
RECOMMENDATIONS = (
    ("contract",), ("tenure",), ("price", "charge", "cost"), ("service", "support", "ticket"),
    ("use", "usage", "activity"), (), (), (),
)


def top_features(importance: DataFrame, n: int = TOP_CHART) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def keyword_match(importance: DataFrame, keywords) -> DataFrame:
    """(feature, keyword) for every keyword contained in a feature name, whatever the case."""
    each = importance.select("feature", F.explode(F.array(*[F.lit(k) for k in keywords])).alias("keyword"))
    return each.where(F.contains(F.lower("feature"), F.col("keyword")))


def feature_insights(importance: DataFrame) -> DataFrame:
    """(rule, theme, title, n_features, importance, top_feature) of the themes named by any feature."""
    themes = F.array(*[
        F.struct(F.lit(i + 1).alias("rule"), F.lit(t).alias("theme")) for i, t in enumerate(THEMES)
    ])
    each = importance.select("feature", "importance", F.inline(themes))
    named = each.where(F.contains(F.lower("feature"), F.col("theme")))
    return named.groupBy("rule", "theme", F.initcap("theme").alias("title")).agg(
        F.count_distinct("feature").alias("n_features"),
        F.sum("importance").alias("importance"),
        F.min(F.struct((-F.col("importance")).alias("least"), "feature"))["feature"].alias("top_feature"),
    )


def _ranked(importance: DataFrame, n: int) -> DataFrame:
    """The n most important features with their rank."""
    order = W.orderBy(F.desc("importance"), "feature")  # n rows
    return top_features(importance, n).withColumn("rank", F.row_number().over(order))


def _evidence(importance: DataFrame, n: int, rules, met) -> DataFrame:
    """(rule, keywords, feature, importance, rank): every rule once, with the best leading feature that ``met`` accepts."""
    table = F.array(*[
        F.struct(F.lit(i + 1).alias("rule"), F.array(*[F.lit(w) for w in words]).cast("array<string>").alias("words"))
        for i, words in enumerate(rules)
    ])
    leading = _ranked(importance, n).agg(F.collect_list(F.struct("rank", "feature", "importance")).alias("leading"))
    each = leading.select("leading", F.inline(table))
    hits = F.filter("leading", lambda f: (F.size("words") > 0) & met(F.lower(f["feature"])))
    best = each.withColumn("best", F.array_min(hits))
    return best.select(
        "rule", F.array_join("words", " ").alias("keywords"), (F.size("words") > 0).alias("specific"),
        F.col("best.feature").alias("feature"), F.col("best.importance").alias("importance"), F.col("best.rank").alias("rank"),
    )


def _all_words(name: Column) -> Column:
    return F.forall("words", lambda w: F.contains(name, w))


def _any_word(name: Column) -> Column:
    return F.exists("words", lambda w: F.contains(name, w))


def recommended_actions(importance: DataFrame, n: int = TOP_RULES) -> DataFrame:
    """(rule, keywords, specific, feature, importance, rank): rules whose keywords all occur in one of the leading
    features, the best such feature beside them, and the rules that always hold."""
    return _evidence(importance, n, ACTIONS, _all_words).where(~F.col("specific") | F.col("feature").isNotNull())


def retention_recommendations(importance: DataFrame, n: int = TOP_RULES) -> DataFrame:
    """(position, rule, keywords, specific, feature, importance, rank): the rules met, topped up to three with general
    ones."""
    found = _evidence(importance, n, RECOMMENDATIONS, _any_word)
    chosen = found.where(~F.col("specific") | F.col("feature").isNotNull())
    order = W.orderBy(F.desc("specific"), "rule")  # eight rows at most
    ranked = chosen.withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("specific") | (F.col("position") <= MIN_RECOMMENDATIONS)).select(
        "position", "rule", "keywords", "specific", "feature", "importance", "rank"
    )
