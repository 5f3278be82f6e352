"""Checks of the learning jobs on the planted signal: what must hold of any correct fit, with exact twins."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ebbtide.operators import clustering, models, prep
from ebbtide.plans.model_queries import KEY, _tree_attributions, shap_linear, trained
from ebbtide.plans.registry import BASE, PLANTED, base, query
from ebbtide.plans.segment_queries import CLUSTER_FEATURES

_FEATURES = f"""{PLANTED}, train AS (SELECT * FROM planted WHERE split = 'train'),
names AS (SELECT 'order_count' AS feature UNION ALL SELECT 'acct_balance_raw' UNION ALL SELECT 'is_machinery'
  UNION ALL SELECT DISTINCT 'segment_name_' || segment_name FROM train
  UNION ALL SELECT DISTINCT 'region_' || region FROM train),
test AS (SELECT customer_id, churn FROM planted WHERE split = 'test')"""
GRADIENT = 1e-4


@query("score_check", f"""WITH {PLANTED} SELECT m AS model, count(*) AS n, true AS probabilities
FROM planted, (SELECT unnest(['logistic', 'boosted']) AS m) WHERE split = 'test' GROUP BY m""")
def score_check(spark, folder):
    return trained(spark, folder).scores.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.every(F.col("p").between(0, 1)).alias("probabilities"))


@query("logistic_check", f"WITH {_FEATURES} SELECT feature, true AS stationary FROM names UNION ALL SELECT '(intercept)', true")
def logistic_check(spark, folder):
    """The gradient of the penalised mean loss is next to zero in every coefficient."""
    found = trained(spark, folder)
    learner, rows = found.logistic.stages[-1], found.prepared.train
    x = F.concat(vector_to_array("features"), F.array(F.lit(1.0)))
    weights = [float(w) for w in [*learner.coefficients, learner.intercept]]
    margin = F.aggregate(F.zip_with("x", F.lit(weights), lambda a, w: a * w), F.lit(0.0), lambda a, v: a + v)
    slope = rows.select(x.alias("x"), F.col(found.prepared.label).alias("y")).withColumn("d", 1.0 / (1.0 + F.exp(-margin)) - F.col("y"))
    cells = slope.select("d", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg(F.col("d") * F.col("v")).alias("g"))
    penalty = learner.getOrDefault("regParam")
    pull = F.lit([penalty * w for w in weights[:-1]] + [0.0])
    names = F.lit([*found.prepared.names, "(intercept)"])
    return cells.select(F.get(names, F.col("i")).alias("feature"), (F.abs(F.col("g") + F.get(pull, F.col("i"))) < GRADIENT).alias("stationary"))


@query("boosted_check", "SELECT i AS tree, true AS shallow FROM range(100) t(i)")
def boosted_check(spark, folder):
    """A hundred trees of depth three at most; with a NULL answer if the importances do not sum to one."""
    learner = trained(spark, folder).boosted.stages[-1]
    whole = abs(float(np.sum(learner.featureImportances.toArray())) - 1.0) < 1e-9
    rows = [(i, t.depth <= 3 if whole else None) for i, t in enumerate(learner.trees)]
    return spark.createDataFrame(rows, "tree long, shallow boolean")


@query("importance_check", f"""WITH {_FEATURES} SELECT m AS model, feature, true AS valid FROM names,
  (SELECT unnest(['logistic', 'boosted']) AS m)""")
def importance_check(spark, folder):
    """Every feature once per model; absolute coefficients for one, shares of the whole gain for the other."""
    found = trained(spark, folder)
    size = {n: abs(float(c)) for n, c in zip(found.prepared.names, found.logistic.stages[-1].coefficients)}
    rows = models.feature_importance(found.logistic, found.prepared)
    expected = F.create_map(*[F.lit(v) for pair in size.items() for v in pair])
    linear = rows.select(F.lit("logistic").alias("model"), "feature", (F.col("importance") == expected[F.col("feature")]).alias("valid"))
    gains = models.feature_importance(found.boosted, found.prepared)
    total = gains.agg(F.sum("importance")).scalar()
    return linear.unionByName(gains.select(
        F.lit("boosted").alias("model"), "feature", ((F.col("importance") >= 0) & (F.abs(total - 1.0) < 1e-9)).alias("valid")))


@query("evaluate_check", f"""WITH {PLANTED} SELECT m AS model, count(*) AS n, true AS agrees
FROM planted, (SELECT unnest(['logistic', 'boosted']) AS m) WHERE split = 'test' GROUP BY m""")
def evaluate_check(spark, folder):
    """Metrics against those recomputed from the score table by plain counts."""
    scores = trained(spark, folder).scores
    y, said = F.col("churn") == 1, F.col("p") >= 0.5
    tp, fp, fn = F.count_if(y & said), F.count_if(~y & said), F.count_if(y & ~said)
    plain = scores.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.avg((y == said).cast("double")).alias("a"),
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("p"), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("r"))
    both = models.evaluate(scores, "churn").join(plain, "model")
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    gap = F.greatest(*[F.abs(F.col(a) - b) for a, b in (
        ("accuracy", F.col("a")), ("precision", F.col("p")), ("recall", F.col("r")), ("f1_score", f1))])
    return both.select("model", "n", ((gap < 1e-12) & F.col("roc_auc").between(0, 1)).alias("agrees"))


def _adds_up(shap, model, test):
    """(customer_id, n_features, adds_up): attributions and base against the model's margin."""
    p = F.get(vector_to_array("probability"), F.lit(1))
    margin = model.transform(test).select(KEY, F.log(p / (1 - p)).alias("margin"))
    total = shap.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_features"), (F.sum("shap") + F.max("base")).alias("total"))
    return total.join(margin, KEY).select(KEY, "n_features", (F.abs(F.col("total") - F.col("margin")) < 1e-6).alias("adds_up"))


_ADDS_UP = f"WITH {_FEATURES} SELECT customer_id, (SELECT count(*) FROM names) AS n_features, true AS adds_up FROM test"


@query("shap_linear_check", _ADDS_UP)
def shap_linear_check(spark, folder):
    found = trained(spark, folder)
    return _adds_up(shap_linear(spark, folder), found.logistic, found.test)


@query("shap_tree_check", _ADDS_UP)
def shap_tree_check(spark, folder):
    found = trained(spark, folder)
    return _adds_up(_tree_attributions(spark, folder), found.boosted, found.test)


@query("kmeans_check", f"WITH {BASE} SELECT customer_id, true AS nearest FROM base")
def kmeans_check(spark, folder):
    """Every customer is in the segment whose centre is nearest."""
    rows = base(spark, folder)
    assigned, model = clustering.fit_segments(rows, KEY, CLUSTER_FEATURES)
    encoded = prep.fit_segment_features(rows, CLUSTER_FEATURES).pipeline(rows).transform(rows)
    centres = [[float(v) for v in c] for c in model.clusterCenters()]
    x = vector_to_array("features")

    def distance(centre):
        return F.aggregate(F.zip_with(x, F.lit(centre), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)

    order = clustering.segment_order(model)
    far = encoded.select(KEY, F.array(*[distance(centres[i]) for i in order]).alias("d"))
    mine = F.get("d", F.substring("segment", 9, 3).cast("int") - 1)
    return assigned.select(KEY, "segment").join(far, KEY).select(KEY, (mine <= F.array_min("d") + 1e-9).alias("nearest"))
