"""The whole study on the customer table: its own label and features, models, advice from them, segments and return."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.operators import metrics, models, prep, profile, roi, rules
from ebbtide.operators import segments as report
from ebbtide.plans.model_queries import KEY, Trained, train_both
from ebbtide.plans.registry import BASE, base, query, shared
from ebbtide.plans.segment_queries import CLUSTER_FEATURES, clustered
from ebbtide.plans.table_queries import MEASURES

LABEL = "churned"
NOT_FEATURES = ("churn", "raw_balance", "split")


def study(spark, folder) -> Trained:
    """Both models on every feature of the customer table, a hash of the key holding out the test rows."""
    return shared(
        spark, folder, "study", lambda: train_both(prep.hash_split(base(spark, folder), KEY), LABEL, NOT_FEATURES)
    )


def importances(spark, folder):
    """Importances of the boosted model."""
    found = study(spark, folder)
    return models.feature_importance(found.boosted, found.prepared)


@query("study_scores")
def study_scores(spark, folder):
    return study(spark, folder).scores


@query("study_metrics")
def study_metrics(spark, folder):
    return models.evaluate(study(spark, folder).scores, LABEL)


@query("study_importance")
def study_importance(spark, folder):
    return importances(spark, folder)


@query("study_high_risk")
def study_high_risk(spark, folder):
    scores = study(spark, folder).scores.where("model = 'boosted'")
    return metrics.high_risk_customers(scores, "p")


@query("study_insights")
def study_insights(spark, folder):
    return rules.feature_insights(importances(spark, folder))


@query("study_actions")
def study_actions(spark, folder):
    return rules.recommended_actions(importances(spark, folder))


@query("study_recommendations")
def study_recommendations(spark, folder):
    return rules.retention_recommendations(importances(spark, folder))


@query("kmeans_profile")
def kmeans_profile(spark, folder):
    return report.segment_profile(clustered(spark, folder), "segment", CLUSTER_FEATURES)


@query("kmeans_box")
def kmeans_box(spark, folder):
    return profile.box_stats(clustered(spark, folder), "monthly_charges", "segment")


@query("kmeans_priority")
def kmeans_priority(spark, folder):
    return report.segment_priority(report.segment_summary(clustered(spark, folder), "segment", LABEL))


@query("kmeans_return")
def kmeans_return(spark, folder):
    return roi.roi_scenarios(report.segment_summary(clustered(spark, folder), "segment", LABEL))


# --- what must hold whatever the models found, with exact twins --------------------------------------

_UNIT = "(CAST(CAST('0x' || substr(md5(CAST(customer_id AS VARCHAR) || '-42'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0)"
_SPLIT = f"{BASE}, rows_ AS (SELECT *, CASE WHEN {_UNIT} < 0.25 THEN 'test' ELSE 'train' END AS split FROM base)"
_TEXTS = ["segment_name", "region", "signup_month", "contract_type"]


@query("study_scores_check", f"""WITH {_SPLIT}
SELECT m AS model, count(*) AS n, count(DISTINCT customer_id) AS customers, true AS probabilities
FROM rows_, (SELECT unnest(['logistic', 'boosted']) AS m) WHERE split = 'test' GROUP BY m""")
def study_scores_check(spark, folder):
    scores = study(spark, folder).scores
    return scores.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(KEY).alias("customers"),
        F.coalesce(F.every(F.col("p").between(0, 1)), F.lit(True)).alias("probabilities"),
    )


@query("study_importance_check", f"""WITH {_SPLIT}, train AS (SELECT * FROM rows_ WHERE split = 'train'),
names AS ({" UNION ALL ".join(f"SELECT '{m}' AS feature" for m in MEASURES)} UNION ALL
  {" UNION ALL ".join(f"SELECT DISTINCT '{t}_' || {t} FROM train WHERE {t} IS NOT NULL" for t in _TEXTS)})
SELECT feature, true AS valid FROM names""")
def study_importance_check(spark, folder):
    """Every feature of the training rows has an importance, none is negative, and they sum to one."""
    found = importances(spark, folder)
    total = found.agg(F.sum("importance")).scalar()
    valid = (F.col("importance") >= 0) & (F.abs(total - 1.0) < 1e-9)
    return found.select("feature", valid.alias("valid"))


@query("study_advice_check", f"""WITH {BASE}
SELECT 'actions' AS list, true AS backed, true AS complete FROM (SELECT 1) UNION ALL SELECT 'insights', true, true
UNION ALL SELECT 'recommendations', true, true""")
def study_advice_check(spark, folder):
    """Every specific entry names a leading feature that holds its keyword, and each list is as long as it must be."""
    found = importances(spark, folder)
    actions, advice = rules.recommended_actions(found), rules.retention_recommendations(found)
    insights = rules.feature_insights(found).select(
        F.col("theme").alias("keywords"), F.lit(True).alias("specific"), F.col("top_feature").alias("feature"), F.lit(1).alias("rank"))
    parts = [("actions", actions, len([r for r in rules.ACTIONS if not r])), ("insights", insights, 0),
             ("recommendations", advice, rules.MIN_RECOMMENDATIONS)]
    rows = None
    for name, part, least in parts:
        words = F.split("keywords", " ")
        named = F.exists(words, lambda w: F.contains(F.lower("feature"), w)) & (F.col("rank") <= rules.TOP_RULES)
        checked = part.agg(
            F.coalesce(F.every(~F.col("specific") | named), F.lit(True)).alias("backed"),
            (F.count(F.lit(1)) >= least).alias("complete")).select(F.lit(name).alias("list"), "backed", "complete")
        rows = checked if rows is None else rows.unionByName(checked)
    return rows


@query("kmeans_reports_check", f"""WITH {BASE}, n AS (SELECT count(*) AS n, CAST(sum(churned) AS BIGINT) AS c FROM base)
SELECT n AS customers, c AS churned, 3 AS segments, 3 AS boxes, 4 AS priorities, 12 AS returns, true AS by_size FROM n""")
def kmeans_reports_check(spark, folder):
    rows = clustered(spark, folder)
    summary = report.segment_summary(rows, "segment", LABEL)
    by_name = F.transform(F.array_sort(F.collect_list(F.struct("segment", "size"))), lambda s: s["size"])
    return summary.agg(
        F.sum("size").alias("customers"),
        F.sum(F.round(F.col("size") * F.col("churn_rate")).cast("bigint")).alias("churned"),
        F.count(F.lit(1)).cast("int").alias("segments"),
        (by_name == F.sort_array(by_name, asc=False)).alias("by_size"),
    ).select(
        "customers", "churned", "segments",
        kmeans_box(spark, folder).agg(F.count(F.lit(1))).scalar().cast("int").alias("boxes"),
        kmeans_priority(spark, folder).agg(F.count(F.lit(1))).scalar().cast("int").alias("priorities"),
        kmeans_return(spark, folder).agg(F.count(F.lit(1))).scalar().cast("int").alias("returns"),
        "by_size",
    )
