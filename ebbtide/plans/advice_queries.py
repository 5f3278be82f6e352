"""Advice queries. Their importances come from the tables: how strongly each encoded feature goes with churn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.shaping import named, text_cells, unfold
from ebbtide.operators import profile, rules
from ebbtide.plans.model_queries import TEXTS
from ebbtide.plans.registry import BASE, base, query, rounded, shared
from ebbtide.plans.table_queries import MEASURES
from ebbtide.session import stage


def association(df: DataFrame, label: str) -> DataFrame:
    """(feature, importance): absolute correlation of every number and category with the label, summing to one.

    A stand-in for model importances that SQL can recompute. A category's correlation follows from its row
    and churn counts, so no indicator columns are built.
    """
    numbers = profile.correlation_with(df, MEASURES, label)
    numbers = numbers.select(F.col("column").alias("feature"), F.abs("correlation").alias("strength"))
    totals = df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(label).alias("c"))).scalar()
    n, c = totals["n"].cast("double"), totals["c"].cast("double")
    cells = unfold(df, text_cells(df, TEXTS), [label]).where(F.col("value").isNotNull())
    hot = named(cells.groupBy("slot", "value").agg(
        F.count(F.lit(1)).cast("double").alias("k"), F.sum(label).cast("double").alias("kc")
    ), TEXTS).withColumn("feature", F.concat_ws("_", "column", "value"))
    phi = F.try_divide(n * F.col("kc") - F.col("k") * c, F.sqrt(F.col("k") * (n - F.col("k")) * c * (n - c)))
    both = numbers.unionByName(hot.select("feature", F.abs(phi).alias("strength")))
    total = both.agg(F.sum("strength")).scalar()
    return both.select("feature", F.round(F.col("strength") / total, 9).alias("importance"))


def importance(spark, folder) -> DataFrame:
    return shared(
        spark, folder, "importance", lambda: stage(association(base(spark, folder), "churned"), "importance")
    )


_STRENGTHS = " UNION ALL ".join(
    f"SELECT '{m}' AS feature, abs(corr(CAST({m} AS DOUBLE), CAST(churned AS DOUBLE))) AS strength FROM base" for m in MEASURES
) + " UNION ALL " + " UNION ALL ".join(
    f"""SELECT '{t}_' || v.{t}, abs(corr(CASE WHEN b.{t} = v.{t} THEN 1.0 ELSE 0.0 END, CAST(b.churned AS DOUBLE)))
  FROM (SELECT DISTINCT {t} FROM base WHERE {t} IS NOT NULL) v, base b GROUP BY v.{t}""" for t in TEXTS)

IMPORTANCE = f"""{BASE}, strengths AS ({_STRENGTHS}),
importance AS (SELECT feature, round(strength / (SELECT sum(strength) FROM strengths), 9) AS importance FROM strengths),
ranked AS (
  SELECT feature, importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM importance),
first_five AS (SELECT * FROM ranked WHERE rank <= 5)"""


def _list(values) -> str:
    return "CAST([" + ", ".join(f"'{v}'" for v in values) + "] AS VARCHAR[])"


def _rules_sql(rules) -> str:
    rows = ", ".join(f"({i + 1}, {_list(words)})" for i, words in enumerate(rules))
    return f"rule AS (SELECT * FROM (VALUES {rows}) AS v(rule, words))"


def _evidence_sql(rules, lacking: str) -> str:
    """Best leading feature per rule; ``lacking`` is 0 for a feature that meets it."""
    return f"""{_rules_sql(rules)},
hits AS (SELECT rule, f.*, row_number() OVER (PARTITION BY rule ORDER BY rank) AS k
  FROM rule, first_five f WHERE len(words) > 0 AND {lacking} = 0),
evidence AS (
  SELECT rule, array_to_string(words, ' ') AS keywords, len(words) > 0 AS specific, feature, importance, rank
  FROM rule LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (rule) WHERE len(words) = 0 OR feature IS NOT NULL)"""


@query("top_features", f"WITH {IMPORTANCE} SELECT feature, importance FROM ranked WHERE rank <= 15")
def top_features(spark, folder):
    return rules.top_features(importance(spark, folder))


@query("feature_keyword_match", f"""WITH {IMPORTANCE}, words AS (SELECT unnest({_list(rules.THEMES)}) AS keyword)
SELECT feature, keyword FROM importance JOIN words ON contains(lower(feature), keyword)""")
def feature_keyword_match(spark, folder):
    return rules.keyword_match(importance(spark, folder), rules.THEMES)


@query("feature_insights", f"""WITH {IMPORTANCE}, {_rules_sql([(t,) for t in rules.THEMES])}
SELECT rule, words[1] AS theme, upper(words[1][1]) || words[1][2:] AS title, count(DISTINCT feature) AS n_features,
  round(sum(importance), 6) AS importance, arg_min(feature, rank) AS top_feature
FROM rule JOIN ranked ON contains(lower(feature), words[1]) GROUP BY rule, words""")
def feature_insights(spark, folder):
    return rounded(rules.feature_insights(importance(spark, folder)), 6, "importance")


_MISSED = "len(list_filter(words, lambda w: NOT contains(lower(f.feature), w)))"
_MET = "(CASE WHEN len(list_filter(words, lambda w: contains(lower(f.feature), w))) > 0 THEN 0 ELSE 1 END)"


@query("recommended_actions", f"""WITH {IMPORTANCE}, {_evidence_sql(rules.ACTIONS, _MISSED)}
SELECT rule, keywords, specific, feature, importance, rank FROM evidence""")
def recommended_actions(spark, folder):
    return rules.recommended_actions(importance(spark, folder))


@query("retention_recommendations", f"""WITH {IMPORTANCE}, {_evidence_sql(rules.RECOMMENDATIONS, _MET)},
placed AS (SELECT *, CAST(row_number() OVER (ORDER BY specific DESC, rule) AS INTEGER) AS position FROM evidence)
SELECT position, rule, keywords, specific, feature, importance, rank FROM placed WHERE specific OR position <= 3""")
def retention_recommendations(spark, folder):
    return rules.retention_recommendations(importance(spark, folder))
