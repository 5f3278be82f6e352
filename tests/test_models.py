"""Learning jobs: invariants on the planted signal."""

import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ebbtide.operators import clustering, explain, metrics, models, prep
from ebbtide.plans import model_queries
from ebbtide.plans.registry import base, planted

FOLDER = "/root/testdata/sf0.01"
KEY = "customer_id"


@pytest.fixture(scope="module")
def trained(spark):
    return model_queries.trained(spark, FOLDER)


def test_both_models_find_the_signal(spark, trained):
    rows = {r["model"]: r for r in models.evaluate(trained.scores, "churn").collect()}
    assert set(rows) == {"logistic", "boosted"}
    assert all(r["roc_auc"] > 0.8 for r in rows.values())
    assert trained.scores.where("p < 0 or p > 1 or p is null").count() == 0


def test_penalty_is_spread_over_rows(trained):
    learner = trained.logistic.stages[-1]
    assert learner.getOrDefault("regParam") == pytest.approx(1.0 / trained.prepared.train.count())


def test_training_rows_in_one_file_are_spread_over_tasks(spark, monkeypatch):
    rows = [(i, i % 2, None if i % 7 == 0 else i / 3, "abc"[i % 3]) for i in range(400)] + [(None, 1, 0.5, None), (3, 0, 0.5, "a")]
    table = spark.createDataFrame(rows, "id long, y int, x double, t string").coalesce(1)

    def prepared():
        train = models.prepare(table, "id", "y").train
        found = train.collect()
        return train.rdd.getNumPartitions(), sorted((str(r["id"]), r["y"], str(r["features"])) for r in found), train.schema["features"].metadata["ml_attr"]

    few = prepared()
    assert few[0] == 1  # a small table stays as it is
    monkeypatch.setattr(models, "TASK_ROWS", 10)
    many = prepared()
    assert many[0] > spark.sparkContext.defaultParallelism / 2 and many[1:] == few[1:] and len(many[1]) == 402


def test_importances(trained):
    boosted = models.feature_importance(trained.boosted, trained.prepared).collect()
    assert sum(r["importance"] for r in boosted) == pytest.approx(1.0)
    logistic = [r["importance"] for r in models.feature_importance(trained.logistic, trained.prepared).collect()]
    assert logistic == sorted(logistic, reverse=True) and min(logistic) >= 0
    assert {r["feature"] for r in boosted} == set(trained.prepared.names)


def test_importance_of_wrong_length_is_refused(spark):
    with pytest.raises(ValueError):
        models._importance_table(spark, ["a"], [0.1, 0.2])


@pytest.mark.parametrize("kind", ["logistic", "boosted"])
def test_attributions_add_up_to_the_margin(trained, kind):
    model = getattr(trained, kind)
    shap = (explain.shap_linear if kind == "logistic" else explain.shap_tree)(model, trained.test, KEY)
    total = shap.groupBy(KEY).agg((F.sum("shap") + F.first("base")).alias("margin"))
    p = F.get(vector_to_array("probability"), F.lit(1))
    truth = model.transform(trained.test).select(KEY, F.log(p / (1 - p)).alias("truth"))
    worst = total.join(truth, KEY).agg(F.max(F.abs(F.col("margin") - F.col("truth"))), F.count("*")).first()
    assert worst[0] < 1e-6 and worst[1] == trained.test.count()


def test_tree_attributions_against_enumeration(spark, trained):
    """Shapley values by their definition, over all subsets of the features a small model splits on."""
    from itertools import combinations

    small = models.train_boosted(trained.prepared, models.BoostedParams(trees=3, depth=3))
    nodes = explain._tree_nodes(spark, small.stages[-1])
    weights = small.stages[-1].treeWeights
    used = sorted({n["split"]["featureIndex"] for t in nodes.values() for n in t.values() if n["leftChild"] >= 0})

    def value(tree, at, x, known):
        node = tree[at]
        if node["leftChild"] < 0:
            return node["prediction"]
        left, right = node["leftChild"], node["rightChild"]
        f, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"]
        if f in known:
            goes_left = x[f] <= cut[0] if node["split"]["numCategories"] < 0 else x[f] in cut
            return value(tree, left if goes_left else right, x, known)
        share = tree[left]["rawCount"] / node["rawCount"]
        return share * value(tree, left, x, known) + (1 - share) * value(tree, right, x, known)

    def margin(x, known):
        return sum(2 * w * value(nodes[t], 0, x, known) for t, w in enumerate(weights))

    encoded = small.transform(trained.test).select(KEY, vector_to_array("features").alias("x")).orderBy(KEY).limit(4)
    shap = explain.shap_tree(small, trained.test, KEY)
    names = trained.prepared.names
    for row in encoded.collect():
        found = {r["feature"]: r["shap"] for r in shap.where(F.col(KEY) == row[KEY]).collect()}
        for f in used:
            rest = [g for g in used if g != f]
            expected = 0.0
            for size in range(len(rest) + 1):
                weight = math.factorial(size) * math.factorial(len(rest) - size) / math.factorial(len(used))
                for known in combinations(rest, size):
                    expected += weight * (margin(row["x"], {*known, f}) - margin(row["x"], set(known)))
            assert found[names[f]] == pytest.approx(expected, abs=1e-9)


def test_saved_model_scores_alike(spark, trained, tmp_path):
    models.save_model(trained.logistic, str(tmp_path / "model"))
    again = models.load_model(str(tmp_path / "model"))
    a = models.score(trained.logistic, trained.test, KEY, "churn", "m")
    b = models.score(again, trained.test, KEY, "churn", "m")
    assert a.exceptAll(b).count() == 0


def test_unseen_and_missing_categories_are_all_zero(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, c string")
    spec = prep.fit_segment_features(train.withColumn("x", F.col("id") * 1.0), ["x", "c"])
    hot = prep.fit_features(train, exclude=("id",))
    new = spark.createDataFrame([(1, "z"), (2, "a"), (3, None)], "id int, c string")
    pipeline = hot.pipeline(new)
    rows = pipeline.transform(new).select("id", vector_to_array("features").alias("v")).orderBy("id").collect()
    assert [list(r["v"]) for r in rows] == [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]  # missing takes the mode, b
    seg = spec.pipeline(train.withColumn("x", F.lit(2.0)))
    rows = seg.transform(new.withColumn("x", F.lit(2.0))).select("id", vector_to_array("features").alias("v")).orderBy("id").collect()
    assert list(rows[0]["v"])[1:] == [0.0, 0.0] and list(rows[2]["v"])[1:] == [0.0, 0.0]


@pytest.mark.parametrize("n", [1_500, 50_000])
def test_every_category_is_encoded(spark, n):
    rows = spark.range(n).select(
        "id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") * 1.5).alias("x"))
    prepared = models.prepare(rows, "id", "y")
    assert len(prepared.names) == n + 1 and {"x", "name_n0", f"name_n{n - 1}"} <= set(prepared.names)
    hot = prepared.train.select(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, v: a + (v == 1.0).cast("double")).alias("k"))
    if n == 1_500:
        assert prepared.train.count() == n and hot.where("k < 1").count() == 0
        segments, _ = clustering.fit_segments(rows, "id", ["x", "name"], 2)
        assert segments.count() == n and len(prep.fit_segment_features(rows, ["x", "name"]).categories["name"]) == n


def test_feature_names_must_match(spark):
    with pytest.raises(ValueError):
        prep.feature_names(spark.range(1).select(F.array(F.lit(1.0)).alias("features")).withMetadata(
            "features", {"ml_attr": {"num_attrs": 2, "attrs": {"numeric": [{"idx": 0, "name": "a"}]}}}))


def test_segments_are_stable_and_named_by_size(spark):
    rows = base(spark, FOLDER)
    features = ["tenure_days", "monthly_charges", "contract_type", "acct_balance"]
    first, model = clustering.fit_segments(rows, KEY, features, 3)
    second, _ = clustering.fit_segments(rows.repartition(5), KEY, features, 3)
    sizes = {r["segment"]: r["count"] for r in first.groupBy("segment").count().collect()}
    assert sizes["Segment 1"] >= sizes["Segment 2"] >= sizes["Segment 3"] > 0
    assert sum(sizes.values()) == rows.count()
    again, _ = clustering.fit_segments(rows, KEY, features, 3)
    assert first.select(KEY, "segment").exceptAll(again.select(KEY, "segment")).count() == 0
    assert second.count() == rows.count()
    _, fewer = clustering.fit_segments(rows, KEY, features, 2)
    assert model.summary.trainingCost <= fewer.summary.trainingCost


def test_segmentation_needs_two_features(spark):
    with pytest.raises(ValueError):
        clustering.kmeans_segments(base(spark, FOLDER), KEY, ["tenure_days"])


def test_auc_agrees_with_the_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rows = planted(spark, FOLDER)
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="churn", numBins=0).evaluate(rows)
    assert metrics.roc_auc(rows, "churn", "score").first()[0] == pytest.approx(theirs, abs=1e-12)


def test_summary_of_a_feature_that_never_matters(spark):
    shap = spark.createDataFrame(
        [(i, "flat", float(i), 0.0, 0.1) for i in range(4)] + [(i, "used", float(i), i * 0.5, 0.1) for i in range(4)],
        "customer_id int, feature string, value double, shap double, base double")
    rows = explain.shap_summary(shap).collect()
    assert [r["feature"] for r in rows] == ["used", "flat"]
    assert rows[0]["value_shap_corr"] == pytest.approx(1.0) and rows[1]["value_shap_corr"] is None
    assert [r["feature"] for r in explain.shap_summary(shap, max_display=1).collect()] == ["used"]
