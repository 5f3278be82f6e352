"""Per-row attributions of the linear and the boosted model, and their ranking."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.operators.boosting import BoostedTrees
from ebbtide.operators.models import Classifier
from ebbtide.operators.prep import feature_names
from ebbtide.operators.profile import quartile_columns
from ebbtide.operators.quantiles import exact_quantiles
from ebbtide.session import stage_root

# Rows of the attribution ranking.
MAX_DISPLAY = 20


def _doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _long(df: DataFrame, key: str, names: list[str], values: Column, shap: Column, base: Column) -> DataFrame:
    """(key, feature, value, shap, base)."""
    named = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), values.alias("value"), shap.alias("shap"))
    return df.select(key, F.explode(named).alias("c"), base.alias("base")).select(
        key, F.col("c.feature").alias("feature"), F.col("c.value").alias("value"), F.col("c.shap").alias("shap"), "base"
    )


def linear_attributions(df: DataFrame, key: str, coefficients: dict[str, float], intercept: float = 0.0) -> DataFrame:
    """coefficient * (value - mean) per row and feature; ``base`` is the margin at the means.

    The background is the table itself. Missing values attribute nothing and count as the mean.
    """
    columns = list(coefficients)
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    means = [row[f"m{i}"] or 0.0 for i in range(len(columns))]
    weights = [coefficients[c] for c in columns]
    base = intercept + float(np.dot(weights, means))
    values = [F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in zip(columns, means)]
    shap = [w * (v - m) for w, v, m in zip(weights, values, means)]
    return _long(df, key, columns, F.array(*values), F.array(*shap), F.lit(base))


def shap_linear(model: Classifier, df: DataFrame, key: str) -> DataFrame:
    """Attributions of a logistic model on the margin scale; attributions plus base add up to the margin."""
    learner, encoded = model.stages[-1], model.stages[0].transform(df)
    names = feature_names(encoded)
    means = encoded.agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
    weights = learner.coefficients.toArray()
    base = float(learner.intercept + np.dot(weights, means))
    rows = encoded.select(key, vector_to_array("features").alias("x"))
    shap = F.zip_with(
        F.zip_with("x", _doubles(means), lambda x, m: x - m), _doubles(weights), lambda d, w: d * w
    )
    return _long(rows, key, names, F.col("x"), shap, F.lit(base))


@dataclass(frozen=True)
class _Leaf:
    """A leaf as the tests its path puts on each feature. ``share`` is the part of the rows passing them."""

    value: float
    features: tuple[int, ...]
    tests: tuple[tuple, ...]
    shares: tuple[float, ...]


def _tree_nodes(spark: SparkSession, learner) -> dict[int, dict]:
    """Nodes per tree, read from the saved model; as many rows as the model has nodes."""
    path = f"{stage_root(spark)}/trees-{uuid.uuid4().hex}"
    learner.write().overwrite().save(path)
    nodes: dict[int, dict] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        nodes.setdefault(r["treeID"], {})[r["id"]] = r
    return nodes


def _second_order_nodes(learner: BoostedTrees) -> dict[int, dict]:
    """The same fields as a saved model's nodes have; the root is node 0."""
    nodes: dict[int, dict] = {}
    for x in learner.nodes:
        split = x.slot is not None
        nodes.setdefault(x.tree, {})[x.node - 1] = {
            "leftChild": 2 * x.node - 1 if split else -1, "rightChild": 2 * x.node if split else -1,
            "prediction": x.value, "rawCount": x.curvature,
            "split": {"featureIndex": x.slot, "leftCategoriesOrThreshold": [x.cut], "numCategories": -1},
        }
    return nodes


def _passes(test, x: np.ndarray) -> np.ndarray:
    kind, *args = test
    if kind == "between":
        return (x > args[0]) & (x <= args[1])
    return np.isin(x, args[0])


def _merge(old, kind, arg, left):
    """Tighten a feature's test by one more split."""
    if kind == "threshold":
        _, lo, hi = old or ("between", -np.inf, np.inf)
        return ("between", lo, min(hi, arg)) if left else ("between", max(lo, arg), hi)
    mine, count = arg
    allowed = set(mine) if left else set(range(count)) - set(mine)
    return ("in", sorted(allowed if old is None else allowed & set(old[1])))


def _leaves(nodes: dict, weight: float) -> tuple[list[_Leaf], float]:
    """Leaves of one tree and the tree's mean output over its training rows."""
    found, mean = [], 0.0
    stack = [(0, {}, {}, 1.0)]
    while stack:
        at, tests, shares, reach = stack.pop()
        node = nodes[at]
        if node["leftChild"] < 0:
            value = weight * node["prediction"]
            mean += reach * value
            if tests:
                features = tuple(tests)
                found.append(_Leaf(value, features, tuple(tests[f] for f in features), tuple(shares[f] for f in features)))
            continue
        split = node["split"]
        f, cut = split["featureIndex"], split["leftCategoriesOrThreshold"]
        for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
            kind, arg = ("threshold", cut[0]) if split["numCategories"] < 0 else ("categories", (cut, split["numCategories"]))
            part = nodes[child]["rawCount"] / node["rawCount"]
            stack.append((
                child,
                {**tests, f: _merge(tests.get(f), kind, arg, left)},
                {**shares, f: shares.get(f, 1.0) * part},
                reach * part,
            ))
    return found, mean


def _contributions(leaf: _Leaf, pattern: int) -> np.ndarray:
    """Shapley value of each of the leaf's features when bit j of ``pattern`` says whether feature j passes."""
    m = len(leaf.features)
    out = np.zeros(m)
    for i in range(m):
        # coefficient k: sets of k other passing features, the rest replaced by their share
        poly = np.array([1.0])
        for j in range(m):
            if j != i:
                passed = float(pattern >> j & 1)
                poly = np.convolve(poly, [leaf.shares[j], passed])
        total = sum(c * factorial(k) * factorial(m - k - 1) / factorial(m) for k, c in enumerate(poly))
        out[i] = leaf.value * (float(pattern >> i & 1) - leaf.shares[i]) * total
    return out


def _tree_shap_udf(leaves: list[_Leaf]):
    known: dict[tuple[int, int], np.ndarray] = {}

    @F.pandas_udf("array<double>")
    def attribute(rows: pd.Series) -> pd.Series:
        x = np.stack(rows.to_numpy())
        phi = np.zeros(x.shape)
        for number, leaf in enumerate(leaves):
            code = np.zeros(len(x), dtype=np.int64)
            for j, (f, test) in enumerate(zip(leaf.features, leaf.tests)):
                code |= _passes(test, x[:, f]).astype(np.int64) << j
            patterns, place = np.unique(code, return_inverse=True)
            table = []
            for p in patterns.tolist():
                if (number, p) not in known:
                    known[number, p] = _contributions(leaf, p)
                table.append(known[number, p])
            phi[:, leaf.features] += np.stack(table)[place]
        return pd.Series(list(phi))

    return attribute


def shap_tree(model: Classifier, df: DataFrame, key: str) -> DataFrame:
    """Path-dependent tree attributions of a boosted model on the margin scale: twice the boosted sum of first-order trees;
    those of second order add up to the margin themselves, and a node's share of the rows is its share of the curvature.

    Executors apply the leaf table, whose size is set by the model, to Arrow batches of encoded rows.
    """
    learner = model.stages[-1]
    if isinstance(learner, BoostedTrees):
        nodes, weights, base = _second_order_nodes(learner), [1.0] * learner.params.trees, learner.base
    else:
        nodes, weights, base = _tree_nodes(df.sparkSession, learner), [2.0 * w for w in learner.treeWeights], 0.0
    leaves = []
    for tree, weight in enumerate(weights):
        found, mean = _leaves(nodes[tree], weight)
        leaves += found
        base += mean
    encoded = model.stages[0].transform(df)
    names = feature_names(encoded)
    rows = encoded.select(key, vector_to_array("features").alias("x"))
    rows = rows.withColumn("s", _tree_shap_udf(leaves)("x"))
    return _long(rows, key, names, F.col("x"), F.col("s"), F.lit(float(base)))


def shap_summary(shap: DataFrame, max_display: int = MAX_DISPLAY) -> DataFrame:
    """Features by mean absolute attribution, with the spread of their attributions and the direction of effect."""
    # not corr, which divides by zero for a feature that never varies or never matters
    direction = F.try_divide(F.covar_pop("value", "shap"), F.stddev_pop("value") * F.stddev_pop("shap"))
    ranked = (
        shap.groupBy("feature")
        .agg(
            F.avg(F.abs("shap")).alias("mean_abs_shap"),
            F.min("shap").alias("min_shap"),
            F.max("shap").alias("max_shap"),
            direction.alias("value_shap_corr"),
        )
        .orderBy(F.desc("mean_abs_shap"), "feature")
        .limit(max_display)
    )
    spread = quartile_columns(exact_quantiles(shap, [0.25, 0.5, 0.75], key="feature", value="shap"), "feature")
    return ranked.join(spread, "feature", "left").orderBy(F.desc("mean_abs_shap"), "feature")
