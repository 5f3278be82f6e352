"""Second-order boosted trees on the planted signal, and what must hold of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators import boosting, explain, models
from ebbtide.plans.check_queries import _ADDS_UP, _FEATURES, _adds_up
from ebbtide.plans.model_queries import KEY, Trained, trained
from ebbtide.plans.registry import PLANTED, query, shared
from ebbtide.session import stage


def second_order(spark, folder) -> tuple[Trained, models.Classifier]:
    found = trained(spark, folder)
    return found, shared(spark, folder, "second_order", lambda: models.train_second_order(found.prepared, KEY))


@query("train_second_order")
def train_second_order(spark, folder):
    """One row per node: its split, or none, its sums and the value it would add as a leaf."""
    return second_order(spark, folder)[1].stages[-1].table(spark)


@query("score_second_order")
def score_second_order(spark, folder):
    found, model = second_order(spark, folder)
    return models.score(model, found.test, KEY, found.prepared.label, "second_order")


@query("evaluate_second_order")
def evaluate_second_order(spark, folder):
    return models.evaluate(stage(score_second_order(spark, folder), "scores"), "churn")


@query("feature_importance_second_order")
def feature_importance_second_order(spark, folder):
    found, model = second_order(spark, folder)
    return models.feature_importance(model, found.prepared)


@query("shap_second_order")
def shap_second_order(spark, folder):
    found, model = second_order(spark, folder)
    return explain.shap_tree(model, found.test, KEY)


def node_sums(learner: boosting.BoostedTrees, rows: DataFrame, key: str, label: str) -> DataFrame:
    """(tree, node, g, h, n) by walking every row's own values, not its bins, through one tree after another."""
    nodes, p = learner.nodes, learner.params
    worth = {(x.tree, x.node): x.value for x in nodes}

    def add(batches):
        for batch in batches:
            y, draw = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sizes = batch.column(2).value_lengths().to_numpy()
            cells = np.repeat(np.arange(len(y)), sizes), batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            margin, found = np.full(len(y), learner.base), []
            for tree, at in sorted(boosting._reached(nodes, len(y), *cells, "cut").items()):
                share, chosen = 1 / (1 + np.exp(-margin)), boosting._drawn(p.row_share, p.seed, tree, draw)
                above = at.copy()
                while (live := (above > 0) & chosen).any():  # every node on the way from the leaf to the root
                    for node in np.unique(above[live]).tolist():
                        here = live & (above == node)
                        s = share[here]
                        found.append((tree, node, float((s - y[here]).sum()), float((s * (1 - s)).sum()), int(here.sum())))
                    above = above // 2
                margin = margin + np.array([worth[tree, i] for i in at.tolist()])
            columns = list(zip(*found)) if found else [()] * 5
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["tree", "node", "g", "h", "n"])

    parts = F.unwrap_udt("features")
    cells = rows.select(F.col(label).cast("double").alias("y"), F.xxhash64(key).alias("draw"), parts["indices"].alias("i"), parts["values"].alias("v"))
    sums = cells.mapInArrow(add, "tree int, node int, g double, h double, n long")
    return sums.groupBy("tree", "node").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])


@query("second_order_check", "SELECT CAST(i AS INTEGER) AS tree, true AS by_formula FROM range(100) t(i)")
def second_order_check(spark, folder):
    """Every node's sums, leaf value and split gain against the formulas over the rows that reach it."""
    found, model = second_order(spark, folder)
    learner = model.stages[-1]
    p = learner.params
    sums = stage(node_sums(learner, found.prepared.train, KEY, found.prepared.label), "sums")
    nodes = learner.table(spark).alias("x").join(sums.alias("s"), ["tree", "node"], "left")
    for side, bit in (("l", 0), ("r", 1)):
        child = sums.select("tree", ((F.col("node") - bit) / 2).alias("parent"), F.col("g").alias(f"g{side}"), F.col("h").alias(f"h{side}"))
        child = child.where(F.col("parent") == F.floor("parent")).withColumn("parent", F.col("parent").cast("int")).where("parent > 0")
        nodes = nodes.join(child.withColumnRenamed("parent", "node"), ["tree", "node"], "left")

    def score(g, h):
        pull = F.greatest(F.abs(F.col(g)) - p.l1, F.lit(0.0))
        return pull * pull / (F.col(h) + p.l2)

    def near(a, b):
        return F.abs(a - b) <= 1e-3 * (1 + F.abs(b))

    value = -p.rate * F.signum("g") * F.greatest(F.abs(F.col("g")) - p.l1, F.lit(0.0)) / (F.col("h") + p.l2)
    gain = score("gl", "hl") + score("gr", "hr") - score("g", "h")
    holds = (near(F.col("gradient"), F.col("g")) & near(F.col("curvature"), F.col("h")) & (F.col("rows") == F.col("n"))
             & near(F.col("value"), value) & F.when(F.col("slot").isNull(), F.col("gl").isNull()).otherwise(near(F.col("gain"), gain)))
    return nodes.groupBy("tree").agg(F.every(F.coalesce(holds, F.lit(False))).alias("by_formula"))


@query("second_order_score_check", f"""WITH {PLANTED} SELECT count(*) AS n, true AS probabilities, true AS better_than_share
FROM planted WHERE split = 'test'""")
def second_order_score_check(spark, folder):
    """Every test row has a probability, and their mean log loss is below that of the label's share for all rows."""
    found, model = second_order(spark, folder)
    share = 1 / (1 + np.exp(-model.stages[-1].base))

    def loss(p):
        return F.avg(-F.when(F.col("churn") == 1, F.log(p)).otherwise(F.log(1 - p)))

    return score_second_order(spark, folder).agg(
        F.count(F.lit(1)).alias("n"), F.every(F.col("p").between(0, 1)).alias("probabilities"),
        (loss(F.col("p")) < loss(F.lit(float(share)))).alias("better_than_share"))


@query("second_order_importance_check", f"WITH {_FEATURES} SELECT feature, true AS valid FROM names")
def second_order_importance_check(spark, folder):
    """Every feature once, with the mean gain of its splits as a share of all features' mean gains."""
    found, model = second_order(spark, folder)
    gains = model.stages[-1].table(spark).where("slot IS NOT NULL").groupBy("slot").agg(F.avg("gain").alias("mean"))
    whole = gains.agg(F.sum("mean")).first()[0]
    expected = found.prepared.spec.names().join(gains, "slot", "left").select("feature", (F.coalesce("mean", F.lit(0.0)) / whole).alias("share"))
    rows = feature_importance_second_order(spark, folder).join(expected, "feature")
    return rows.select("feature", (F.abs(F.col("importance") - F.col("share")) < 1e-9).alias("valid"))


@query("shap_second_order_check", _ADDS_UP)
def shap_second_order_check(spark, folder):
    found, model = second_order(spark, folder)
    return _adds_up(shap_second_order(spark, folder), model, found.test)
