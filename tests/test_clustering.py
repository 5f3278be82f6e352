"""Segments that depend on the rows alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import clustering
from ebbtide.plans.registry import base

FOLDER = "/root/testdata/sf0.01"
FEATURES = ["tenure_days", "monthly_charges", "contract_type", "acct_balance"]


def test_same_segments_after_any_partitioning(spark):
    rows = base(spark, FOLDER)
    first = clustering.kmeans_segments(rows.coalesce(1), "customer_id", FEATURES, 4).select("customer_id", "segment")
    for other in (rows.repartition(7), rows.repartition(3, "region").sortWithinPartitions(F.desc("acct_balance"))):
        again = clustering.kmeans_segments(other, "customer_id", FEATURES, 4).select("customer_id", "segment")
        assert first.exceptAll(again).count() == 0 and again.exceptAll(first).count() == 0


def test_steps_against_a_plain_version(spark):
    """Lloyd steps from the same first centres, row by row."""
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.normal(m, 0.6, (120, 2)) for m in ((0, 0), (4, 0), (0, 5))])
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, a double, b double").repartition(4)
    found, model = clustering.fit_segments(rows, "id", ["a", "b"], 3)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    centers = np.array(model.clusterCenters())
    at = ((z[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
    assert np.allclose([z[at == j].mean(axis=0) for j in range(3)], centers, atol=1e-3)  # a fixed point of the step
    assert model.summary.clusterSizes == np.bincount(at, minlength=3).tolist() == [120, 120, 120]
    assert model.summary.trainingCost == pytest.approx(((z - centers[at]) ** 2).sum(), rel=1e-5)
    order = clustering.segment_order(model)
    mine = {r["id"]: int(r["segment"][8:]) for r in found.collect()}
    assert all(order[mine[i] - 1] == at[i] for i in range(len(x)))


def test_first_centers_follow_squared_distances(spark):
    """The second centre is a row with a chance in proportion to its squared distance from the first."""
    rows = spark.createDataFrame([(i, [0], [int(v * clustering.UNIT)]) for i, v in enumerate((0.0, 1.0, 3.0))], clustering.CELLS)
    seen = np.zeros((3, 3))
    for seed in range(60):
        a, b = clustering.first_centers(rows.coalesce(1), 1, 2, seed)[:, 0]
        seen[[0.0, 1.0, 3.0].index(a), [0.0, 1.0, 3.0].index(b)] += 1
    assert np.trace(seen) == 0 and (seen.sum(axis=1) > 8).all()
    assert seen[0, 2] > 2 * seen[0, 1] and seen[1, 2] > seen[1, 0]  # 9 to 1, and 4 to 1


def test_few_different_rows_and_clashing_names(spark):
    rows = spark.createDataFrame([(i, float(i % 2), 1.0, "x") for i in range(10)], "id int, a double, b double, cluster string")
    found, model = clustering.fit_segments(rows, "id", ["a", "b"], 5)
    assert len(model.clusterCenters()) == 2 and found.columns == ["id", "a", "b", "cluster", "segment"]
    assert found.select("a", "segment").distinct().count() == 2 and found.where("cluster = 'x'").count() == 10
    with pytest.raises(ValueError):
        clustering.fit_segments(rows.where("false"), "id", ["a", "b"], 2)
