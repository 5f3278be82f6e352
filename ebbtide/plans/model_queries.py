"""Preparation, model, metric and attribution queries on the planted-signal table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators import explain, metrics, models, prep, profile
from ebbtide.plans.registry import BASE, PLANTED, base, customers, planted, query, rounded, shared
from ebbtide.plans.table_queries import MEASURES
from ebbtide.session import stage
from ebbtide.sources.tables import read_table

KEY = "customer_id"
NOT_FEATURES = ("z", "score", "split")
TEXTS = ["segment_name", "region", "contract_type"]
FIXED_COEFFICIENTS = {"order_count": -0.4, "tenure_days": 0.002, "support_events": 0.15}
FIXED_INTERCEPT = 0.25


@dataclass(frozen=True)
class Trained:
    prepared: models.Prepared
    logistic: models.Classifier
    boosted: models.Classifier
    scores: DataFrame
    test: DataFrame


def train_both(rows: DataFrame, label: str, exclude=()) -> Trained:
    """Prepare once, fit both classifiers on the training rows, score the test rows once."""
    train, test = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")
    prepared = models.prepare(train, KEY, label, exclude=exclude)
    logistic, boosted = models.train_logistic(prepared), models.train_boosted(prepared)
    scores = models.score(logistic, test, KEY, label, "logistic").unionByName(
        models.score(boosted, test, KEY, label, "boosted")
    )
    return Trained(prepared, logistic, boosted, stage(scores, "scores"), test)


def trained(spark, folder) -> Trained:
    return shared(spark, folder, "models", lambda: train_both(planted(spark, folder), "churn", NOT_FEATURES))


# --- preparation ------------------------------------------------------------------------------------


@query("impute_median", f"""WITH {BASE} SELECT customer_id,
  round(coalesce(acct_balance, (SELECT quantile_cont(acct_balance, 0.5) FROM base)), 6) AS acct_balance FROM base""")
def impute_median(spark, folder):
    return rounded(prep.impute_median(base(spark, folder).select(KEY, "acct_balance"), ["acct_balance"]), 6, "acct_balance")


@query("impute_mode", f"""WITH {BASE}, m AS (
  SELECT contract_type FROM base WHERE contract_type IS NOT NULL GROUP BY contract_type
  ORDER BY count(*) DESC, contract_type LIMIT 1)
SELECT customer_id, coalesce(contract_type, (SELECT contract_type FROM m)) AS contract_type FROM base""")
def impute_mode(spark, folder):
    return prep.impute_mode(base(spark, folder).select(KEY, "contract_type"), ["contract_type"])


_Z = ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM base)) / (SELECT stddev_pop({c}) FROM base), 6) + 0.0 AS {c}" for c in MEASURES
)


@query("standardize", f"WITH {BASE} SELECT customer_id, {_Z} FROM base")
def standardize(spark, folder):
    return rounded(prep.standardize(base(spark, folder).select(KEY, *MEASURES), MEASURES), 6, *MEASURES)


def _hot_sql(table: str, columns, filled: bool) -> str:
    parts = []
    for c in columns:
        mode = f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
        value = f"coalesce({c}, {mode})" if filled else c
        parts.append(f"SELECT customer_id, '{c}_' || {value} AS feature, CAST(1 AS DOUBLE) AS value FROM {table} WHERE {value} IS NOT NULL")
    return " UNION ALL ".join(parts)


@query("onehot", f"WITH {BASE} {_hot_sql('base', TEXTS, True)}")
def onehot(spark, folder):
    return prep.onehot(base(spark, folder), KEY, TEXTS)


_DUMMY_NUMBERS = ["tenure_days", "acct_balance"]


@query("dummies_segment", f"WITH {BASE} " + " UNION ALL ".join(
    f"SELECT customer_id, '{c}' AS feature, round(coalesce(CAST({c} AS DOUBLE), (SELECT avg({c}) FROM base)), 6) AS value FROM base"
    for c in _DUMMY_NUMBERS) + " UNION ALL " + _hot_sql("base", ["contract_type"], False))
def dummies_segment(spark, folder):
    found = prep.dummies_segment(base(spark, folder), KEY, [*_DUMMY_NUMBERS, "contract_type"])
    return rounded(found, 6, "value")


_PREP_NUMBERS = ["tenure_days", "total_charges", "acct_balance"]


def _scaled_sql(c: str) -> str:
    return f"""SELECT customer_id, '{c}' AS feature,
  round((coalesce({c}, m) - avg(coalesce({c}, m)) OVER ()) / stddev_pop(coalesce({c}, m)) OVER (), 6) + 0.0 AS value
FROM base, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m FROM base)"""


@query("preprocess", f"""WITH {BASE} SELECT * FROM (
{" UNION ALL ".join(_scaled_sql(c) for c in _PREP_NUMBERS)} UNION ALL {_hot_sql('base', TEXTS, True)})
WHERE value <> 0""")
def preprocess(spark, folder):
    """Non-zero cells of the encoded matrix."""
    rows = base(spark, folder).select(KEY, *_PREP_NUMBERS, *TEXTS)
    spec = prep.fit_features(rows, exclude=(KEY,))
    cells = spec.pipeline(rows).cells(rows, KEY).join(spec.names(), "slot")
    return cells.select(KEY, "feature", F.round("value", 6).alias("value")).where(F.col("value") != 0)


_WIDE = ["c_custkey", "c_acctbal", "c_mktsegment", "c_name"]


@query("preprocess_wide", """SELECT * FROM (
SELECT c_custkey, 'c_acctbal' AS feature,
  round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) + 0.0 AS value FROM customer
UNION ALL SELECT c_custkey, 'c_mktsegment_' || c_mktsegment, 1 FROM customer
UNION ALL SELECT c_custkey, 'c_name_' || c_name, 1 FROM customer) WHERE value <> 0""")
def preprocess_wide(spark, folder):
    """As ``preprocess``, with a category for every customer."""
    rows = read_table(spark, folder, "customer", _WIDE)
    spec = prep.fit_features(rows, exclude=("c_custkey",))
    cells = spec.pipeline(rows).cells(rows, "c_custkey").join(spec.names(), "slot")
    return cells.select("c_custkey", "feature", F.round("value", 6).alias("value")).where(F.col("value") != 0)


@query("train_wide_check", """SELECT 'c_acctbal' AS feature, true AS stationary
UNION ALL SELECT DISTINCT 'c_mktsegment_' || c_mktsegment, true FROM customer
UNION ALL SELECT DISTINCT 'c_name_' || c_name, true FROM customer""")
def train_wide_check(spark, folder):
    """The linear model learns with a category for every customer: the gradient of its penalised mean loss is next to
    zero in every coefficient. Label: an odd nation."""
    rows = read_table(spark, folder, "customer", [*_WIDE, "c_nationkey"]).withColumn("y", (F.col("c_nationkey") % 2).cast("int"))
    prepared = models.prepare(rows, "c_custkey", "y", exclude=("c_nationkey",))
    learner = models.train_logistic(prepared).stages[-1]
    weights = spark.createDataFrame(list(enumerate(map(float, learner.coefficients))), "slot int, weight double")
    cells = stage(prepared.pipeline.cells(rows, "c_custkey"), "cells")
    margin = cells.join(weights, "slot").groupBy("c_custkey").agg((F.sum(F.col("value") * F.col("weight")) + learner.intercept).alias("margin"))
    slope = rows.select("c_custkey", "y").join(margin, "c_custkey").select("c_custkey", (1 / (1 + F.exp(-F.col("margin"))) - F.col("y")).alias("d"))
    pulls = cells.join(slope, "c_custkey").groupBy("slot").agg((F.sum(F.col("value") * F.col("d")) / prepared.train.count()).alias("g"))
    named = prepared.spec.names().join(weights, "slot").join(pulls, "slot", "left")
    still = F.abs(F.coalesce("g", F.lit(0.0)) + learner.getOrDefault("regParam") * F.col("weight")) < 1e-4
    return named.select("feature", still.alias("stationary"))


@query("feature_names", f"""WITH {PLANTED}, train AS (SELECT * FROM planted WHERE split = 'train'),
names AS (
  SELECT 0 AS block, 'order_count' AS feature UNION ALL SELECT 1, 'acct_balance_raw' UNION ALL SELECT 2, 'is_machinery'
  UNION ALL SELECT DISTINCT 3, 'segment_name_' || segment_name FROM train
  UNION ALL SELECT DISTINCT 4, 'region_' || region FROM train)
SELECT CAST(row_number() OVER (ORDER BY block, feature) - 1 AS INTEGER) AS position, feature FROM names""")
def feature_names(spark, folder):
    rows = planted(spark, folder).where(F.col("split") == "train")
    spec = prep.fit_features(rows, exclude=(KEY, "churn", *NOT_FEATURES))
    return spec.names().select(F.col("slot").cast("int").alias("position"), "feature")


@query("feature_names_wide", """WITH n AS (SELECT 0 AS block, 'c_acctbal' AS feature
  UNION ALL SELECT DISTINCT 1, 'c_mktsegment_' || c_mktsegment FROM customer
  UNION ALL SELECT DISTINCT 2, 'c_name_' || c_name FROM customer)
SELECT CAST(row_number() OVER (ORDER BY block, feature) - 1 AS INTEGER) AS position, feature FROM n""")
def feature_names_wide(spark, folder):
    """A text column with a category per customer has a slot for each like any other; the names stay in the cluster."""
    rows = read_table(spark, folder, "customer", ["c_custkey", "c_acctbal", "c_mktsegment", "c_name"])
    slots = prep.feature_slots(rows, exclude=("c_custkey",))
    return slots.select(F.col("slot").cast("int").alias("position"), F.concat_ws("_", "column", "value").alias("feature"))


@query("onehot_orders", """SELECT o_orderkey, 'customer_' || o_custkey AS feature, CAST(1 AS DOUBLE) AS value FROM orders
UNION ALL SELECT o_orderkey, 'o_orderpriority_' || o_orderpriority, 1 FROM orders""")
def onehot_orders(spark, folder):
    rows = read_table(spark, folder, "orders", ["o_orderkey", "o_custkey", "o_orderpriority"])
    rows = rows.withColumn("customer", F.col("o_custkey").cast("string"))
    return prep.onehot(rows, "o_orderkey", ["customer", "o_orderpriority"])


@query("stratified_split", f"WITH {PLANTED} SELECT customer_id, churn, split FROM planted")
def stratified_split(spark, folder):
    return prep.hash_split(planted(spark, folder).select(KEY, "churn"), KEY)


@query("stratified_split_exact", f"""WITH {PLANTED},
hashed AS (SELECT customer_id, churn,
  CAST(CAST('0x' || substr(md5(CAST(customer_id AS VARCHAR) || '-42'), 1, 13) AS BIGINT) AS DOUBLE) AS h FROM planted),
sizes AS (SELECT churn, count(*) AS n, ceil(0.25 * (SELECT count(*) FROM planted)) AS wanted,
  (SELECT count(*) FROM planted) AS total FROM planted GROUP BY churn),
shares AS (SELECT churn, wanted, floor(wanted * n / total) AS low, wanted * n / total - floor(wanted * n / total) AS rest FROM sizes),
quota AS (SELECT churn, low + CASE WHEN row_number() OVER (ORDER BY rest DESC, churn) <= wanted - sum(low) OVER ()
  THEN 1 ELSE 0 END AS q FROM shares),
ranked AS (SELECT customer_id, churn, row_number() OVER (PARTITION BY churn ORDER BY h, customer_id) AS rn FROM hashed)
SELECT r.customer_id, r.churn, CASE WHEN rn <= q THEN 'test' ELSE 'train' END AS split
FROM ranked r JOIN quota USING (churn)""")
def stratified_split_exact(spark, folder):
    return prep.stratified_split(planted(spark, folder).select(KEY, "churn"), KEY, "churn")


@query("split_integrity", f"""WITH {PLANTED} SELECT count(*) AS n_input,
  count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test,
  CAST(0 AS BIGINT) AS in_both, CAST(0 AS BIGINT) AS in_neither, CAST(0 AS BIGINT) AS not_in_input, true AS passed
FROM planted""")
def split_integrity(spark, folder):
    rows = planted(spark, folder)
    parts = prep.hash_split(rows.select(KEY, "churn"), KEY)
    return prep.split_integrity(rows, parts.where("split = 'train'"), parts.where("split = 'test'"), KEY)


# --- metrics on fixed scores ------------------------------------------------------------------------

_COUNTS = f"""{PLANTED}, k AS (SELECT
  count(*) FILTER (WHERE churn = 0 AND score < 0.5) AS tn, count(*) FILTER (WHERE churn = 0 AND score >= 0.5) AS fp,
  count(*) FILTER (WHERE churn = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE churn = 1 AND score >= 0.5) AS tp
  FROM planted)"""


def _auc_sql(table: str, score: str) -> str:
    return f"""(WITH g AS (SELECT {score} AS s, count(*) FILTER (WHERE churn = 1) AS pos,
      count(*) FILTER (WHERE churn = 0) AS neg FROM {table} GROUP BY {score}),
    w AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
    SELECT CAST(sum(pos * (below + neg / 2.0)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) FROM w)"""


@query("threshold_prediction", f"""WITH {PLANTED} SELECT customer_id, score,
  CASE WHEN score >= 0.5 THEN 'Churned' ELSE 'Not Churned' END AS prediction FROM planted""")
def threshold_prediction(spark, folder):
    return metrics.threshold_prediction(planted(spark, folder).select(KEY, "score"))


@query("attach_scores", f"""WITH {PLANTED} SELECT b.customer_id, b.segment_name, b.churn AS churn_text, p.score
FROM base b LEFT JOIN planted p ON p.customer_id = b.customer_id""")
def attach_scores(spark, folder):
    rows = customers(spark, folder).select(KEY, "segment_name", F.col("churn").alias("churn_text"))
    return models.attach_scores(rows, planted(spark, folder).select(KEY, "score"), KEY)


@query("confusion_matrix", f"""WITH {_COUNTS} SELECT 0 AS actual, 0 AS predicted, tn AS n FROM k
UNION ALL SELECT 0, 1, fp FROM k UNION ALL SELECT 1, 0, fn FROM k UNION ALL SELECT 1, 1, tp FROM k""")
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(planted(spark, folder), "churn", "score")


def _metrics_sql(name: str, score: str) -> str:
    flagged = f"(CASE WHEN {score} >= 0.5 THEN 1 ELSE 0 END)"
    return f"""SELECT '{name}' AS model, round(a, 9) AS accuracy, round(p, 9) AS precision, round(r, 9) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1_score,
  round({_auc_sql('planted', score)}, 9) AS roc_auc
FROM (SELECT avg(CASE WHEN churn = {flagged} THEN 1.0 ELSE 0.0 END) AS a,
  coalesce(sum(churn * {flagged}) / nullif(sum({flagged}), 0), 0) AS p,
  coalesce(sum(churn * {flagged}) / nullif(sum(churn), 0), 0) AS r FROM planted)"""


_BALANCE_SCORE = "round(1.0 / (1.0 + exp(acct_balance_raw / 5000.0 - 1.0)), 6)"


@query("classification_metrics", f"""WITH {PLANTED} SELECT accuracy, precision, recall, f1_score, roc_auc
FROM ({_metrics_sql('planted', 'score')})""")
def classification_metrics(spark, folder):
    return rounded(metrics.classification_metrics(planted(spark, folder), "churn", "score"), 9, *metrics.METRICS)


@query("roc_auc", f"WITH {PLANTED} SELECT round({_auc_sql('planted', 'score')}, 9) AS roc_auc")
def roc_auc(spark, folder):
    return rounded(metrics.roc_auc(planted(spark, folder), "churn", "score"), 9, "roc_auc")


def _compared(spark, folder):
    rows = planted(spark, folder)
    balance = F.round(1.0 / (1.0 + F.exp(F.col("acct_balance_raw") / 5000.0 - 1.0)), 6)
    tables = [
        metrics.classification_metrics(rows.select("churn", s.alias("s")), "churn", "s").withColumn("model", F.lit(name))
        for name, s in (("planted", F.col("score")), ("balance", balance))
    ]
    return rounded(metrics.metrics_comparison(*tables), 9, *metrics.METRICS)


_COMPARED = f"{_metrics_sql('planted', 'score')} UNION ALL {_metrics_sql('balance', _BALANCE_SCORE)}"


@query("metrics_comparison", f"WITH {PLANTED} {_COMPARED}")
def metrics_comparison(spark, folder):
    return _compared(spark, folder)


@query("metrics_long", f"WITH {PLANTED}, m AS ({_COMPARED}) " + " UNION ALL ".join(
    f"SELECT model, '{m}' AS metric, {m} AS value FROM m" for m in metrics.METRICS))
def metrics_long(spark, folder):
    return metrics.metrics_long(_compared(spark, folder))


_REPORT = f"""{_COUNTS},
c AS (
  SELECT '0' AS class, CAST(tn AS DOUBLE) AS hit, CAST(tn + fn AS DOUBLE) AS said, CAST(tn + fp AS DOUBLE) AS support FROM k
  UNION ALL SELECT '1', tp, tp + fp, tp + fn FROM k),
pr AS (SELECT class, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r, support FROM c),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr),
a AS (SELECT CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS acc FROM k),
raw AS (
  SELECT class, p, r, f1, support FROM f
  UNION ALL SELECT 'accuracy', acc, acc, acc, acc FROM a
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f1), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM f),
report AS (SELECT class, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1_score,
  round(support, 9) AS support FROM raw)"""


def _report(spark, folder):
    found = metrics.classification_report(planted(spark, folder), "churn", "score")
    return rounded(found, 9, *metrics.REPORT_METRICS)


@query("classification_report", f"""WITH {_REPORT} """ + " UNION ALL ".join(
    f"SELECT class, '{m}' AS metric, {m} AS value FROM report" for m in metrics.REPORT_METRICS))
def classification_report(spark, folder):
    return metrics.report_long(_report(spark, folder))


@query("report_transpose", f"WITH {_REPORT} SELECT class, precision, recall, f1_score, support FROM report")
def report_transpose(spark, folder):
    return metrics.report_transpose(metrics.report_long(_report(spark, folder)))


@query("prediction_histogram", f"""WITH {PLANTED},
ends AS (SELECT min(score) AS lo, (max(score) - min(score)) / 30 AS w FROM planted),
b AS (SELECT CAST(least(floor((score - lo) / w), 29) AS INTEGER) AS bin, lo, w,
  CASE WHEN score >= 0.5 THEN 'Churned' ELSE 'Not Churned' END AS prediction FROM planted, ends)
SELECT bin, round(lo + bin * w, 6) AS bin_lo, round(lo + (bin + 1) * w, 6) AS bin_hi, prediction, count(*) AS n
FROM b GROUP BY bin, lo, w, prediction""")
def prediction_histogram(spark, folder):
    named = metrics.threshold_prediction(planted(spark, folder))
    return rounded(profile.histogram(named, "score", "prediction"), 6, "bin_lo", "bin_hi")


@query("high_risk_customers", f"""WITH {PLANTED},
r AS (SELECT customer_id, score, row_number() OVER (ORDER BY score) AS rn, count(*) OVER () AS n FROM planted),
cut AS (SELECT score FROM r WHERE rn = CAST(ceil(round(0.9 * n, 6)) AS BIGINT))
SELECT customer_id, score FROM planted WHERE score >= (SELECT score FROM cut)""")
def high_risk_customers(spark, folder):
    return metrics.high_risk_customers(planted(spark, folder).select(KEY, "score"), "score")


# --- trained models ---------------------------------------------------------------------------------


@query("train_logistic")
def train_logistic(spark, folder):
    """Fitted coefficients, one row per encoded feature, and the intercept."""
    found = trained(spark, folder)
    learner = found.logistic.stages[-1]
    rows = [(n, float(c)) for n, c in zip(found.prepared.names, learner.coefficients)]
    return spark.createDataFrame([*rows, ("(intercept)", float(learner.intercept))], "feature string, coefficient double")


@query("train_boosted")
def train_boosted(spark, folder):
    """One row per fitted tree."""
    learner = trained(spark, folder).boosted.stages[-1]
    rows = [(i, t.depth, t.numNodes, float(w)) for i, (t, w) in enumerate(zip(learner.trees, learner.treeWeights))]
    return spark.createDataFrame(rows, "tree int, depth int, nodes int, weight double")


@query("score")
def score(spark, folder):
    return trained(spark, folder).scores


@query("evaluate")
def evaluate(spark, folder):
    return models.evaluate(trained(spark, folder).scores, "churn")


@query("feature_importance_logistic")
def feature_importance_logistic(spark, folder):
    found = trained(spark, folder)
    return models.feature_importance(found.logistic, found.prepared)


@query("feature_importance_boosted")
def feature_importance_boosted(spark, folder):
    found = trained(spark, folder)
    return models.feature_importance(found.boosted, found.prepared)


@query("feature_importance")
def feature_importance(spark, folder):
    """Both models' importances, most important first."""
    logistic = feature_importance_logistic(spark, folder).withColumn("model", F.lit("logistic"))
    boosted = feature_importance_boosted(spark, folder).withColumn("model", F.lit("boosted"))
    return logistic.unionByName(boosted).orderBy("model", F.desc("importance"), "feature")


@query("shap_linear_fixed", f"""WITH {BASE}, m AS (SELECT
  {", ".join(f"avg({c}) AS m_{c}" for c in FIXED_COEFFICIENTS)} FROM base),
b AS (SELECT round({FIXED_INTERCEPT} + {" + ".join(f"{w} * m_{c}" for c, w in FIXED_COEFFICIENTS.items())}, 6) AS base FROM m)
""" + " UNION ALL ".join(
    f"""SELECT customer_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value,
  round({w} * ({c} - m_{c}), 6) + 0.0 AS shap, b.base FROM base, m, b""" for c, w in FIXED_COEFFICIENTS.items()))
def shap_linear_fixed(spark, folder):
    found = explain.linear_attributions(base(spark, folder), KEY, FIXED_COEFFICIENTS, FIXED_INTERCEPT)
    return rounded(found, 6, "shap", "base")


@query("shap_linear")
def shap_linear(spark, folder):
    found = trained(spark, folder)
    return explain.shap_linear(found.logistic, found.test, KEY)


def _tree_attributions(spark, folder):
    found = trained(spark, folder)
    return shared(
        spark, folder, "shap", lambda: stage(explain.shap_tree(found.boosted, found.test, KEY), "shap")
    )


@query("shap_tree")
def shap_tree(spark, folder):
    return _tree_attributions(spark, folder)


@query("shap_summary")
def shap_summary(spark, folder):
    return explain.shap_summary(_tree_attributions(spark, folder))
