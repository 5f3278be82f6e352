"""Second-order boosted trees against a plain version, and on odd tables."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ebbtide.operators import boosting, explain, models
from ebbtide.operators.boosting import SecondOrderParams

WHOLE = SecondOrderParams(trees=4, row_share=1.0, column_share=1.0)


def table(spark, n=400, seed=3):
    draw = np.random.default_rng(seed)
    a, b = draw.integers(0, 40, n), draw.integers(0, 25, n)
    c = draw.integers(0, 3, n)
    y = (a / 40 + (c == 1) * 0.7 + draw.normal(0, 0.3, n) > 0.7).astype(int)
    rows = [(i, float(a[i]), float(b[i]), f"c{c[i]}", int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c string, y int")


def plain(x, y, p):
    """Greedy trees by exhaustive search over every value of every feature."""
    base = np.log(y.mean() / (1 - y.mean()))
    margin, out = np.full(len(y), base), []

    def score(g, h):
        return max(abs(g) - p.l1, 0.0) ** 2 / (h + p.l2)

    for tree in range(p.trees):
        share = 1 / (1 + np.exp(-margin))
        g, h = share - y, share * (1 - share)

        def grow(node, rows, depth):
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (max(p.min_gain, 1e-6), None, None)
            for f in range(x.shape[1]) if depth < p.depth else ():
                for cut in np.unique(x[rows, f])[:-1]:
                    left = rows & (x[:, f] <= cut)
                    gl, hl = g[left].sum(), h[left].sum()
                    gain = score(gl, hl) + score(gs - gl, hs - hl) - score(gs, hs)
                    if min(hl, hs - hl) >= p.min_curvature and gain > best[0] + 1e-5:
                        best = (gain, f, cut)
            value = -p.rate * np.sign(gs) * max(abs(gs) - p.l1, 0.0) / (hs + p.l2)
            out.append((tree, node, best[1], best[0] if best[1] is not None else None, value, int(rows.sum())))
            if best[1] is None:
                margin[rows] += value
                return
            left = x[:, best[1]] <= best[2]
            grow(2 * node, rows & left, depth + 1)
            grow(2 * node + 1, rows & ~left, depth + 1)

        grow(1, np.ones(len(y), bool), 0)
    return sorted(out)


@pytest.mark.parametrize("change", [{}, {"l1": 2.0, "l2": 0.5, "min_gain": 3.0}, {"min_curvature": 12.0, "depth": 2, "rate": 0.5}])
def test_trees_are_those_of_exhaustive_search(spark, change):
    p = replace(WHOLE, **change)
    prepared = models.prepare(table(spark), "id", "y")
    found = models.train_second_order(prepared, "id", p).stages[-1].nodes
    rows = prepared.train.select(vector_to_array("features").alias("x"), "y").collect()
    expected = plain(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float), p)
    assert [(n.tree, n.node, n.slot, n.rows) for n in found] == [(t, i, f, k) for t, i, f, _, _, k in expected]
    for n, (_, _, _, gain, value, _) in zip(found, expected):
        assert n.value == pytest.approx(value, abs=1e-5) and (gain is None or n.gain == pytest.approx(gain, abs=1e-3))


def test_same_trees_after_any_partitioning(spark):
    rows, p = table(spark), replace(WHOLE, trees=3, row_share=0.7, column_share=0.6)
    prepared = models.prepare(rows, "id", "y")
    dealt = prepared.train.repartition(7, "b").sortWithinPartitions(F.desc("id")) if "b" in prepared.train.columns else prepared.train.repartition(7)
    a = boosting.fit_trees(prepared.train.coalesce(1), "id", "y", prepared.spec, p)
    b = boosting.fit_trees(dealt, "id", "y", prepared.spec, p)
    assert a.nodes == b.nodes
    assert any(n.rows < 400 for n in a.nodes if n.node == 1)


def test_rows_are_staged_in_blocks(spark):
    """A pass reads a row per block, not a row per row."""
    rows, p = table(spark), WHOLE
    prepared = models.prepare(rows, "id", "y")
    cuts = boosting.numeric_cuts(prepared.train, prepared.spec, p.bins)
    binned = boosting._binned(prepared.train.coalesce(1), "y", "id", cuts, 0.5)
    blocks = list(boosting._opened([binned.toArrow().combine_chunks().to_batches()[0]]))
    assert binned.count() == 1 and len(blocks) == 1 and len(blocks[0][0]) == 400
    assert (blocks[0][1] == 0.5).all() and blocks[0][3].reshape(400, len(cuts)).max() < p.bins and blocks[0][4].sum() == len(blocks[0][5])


def test_attributions_and_saved_model(spark, tmp_path):
    rows = table(spark)
    prepared = models.prepare(rows, "id", "y")
    model = models.train_second_order(prepared, "id", replace(WHOLE, trees=12))  # margins are written anew on the way
    p = F.get(vector_to_array("probability"), F.lit(1))
    truth = {r["id"]: r["m"] for r in model.transform(rows).select("id", F.log(p / (1 - p)).alias("m")).collect()}
    shap = explain.shap_tree(model, rows, "id").groupBy("id").agg((F.sum("shap") + F.first("base")).alias("m")).collect()
    assert len(shap) == 400 and all(r["m"] == pytest.approx(truth[r["id"]], abs=1e-9) for r in shap)
    last = max(n.tree for n in model.stages[-1].nodes)
    assert last == 11 and models.evaluate(models.score(model, rows, "id", "y", "m"), "y").first()["roc_auc"] > 0.85
    models.save_model(model, str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m"))
    assert again.stages[-1] == model.stages[-1]
    assert sum(r["importance"] for r in models.feature_importance(again, prepared).collect()) == pytest.approx(1.0)


def test_odd_tables(spark):
    rows = table(spark)
    p = replace(WHOLE, trees=2)
    with pytest.raises(ValueError):
        prepared = models.prepare(rows, "id", "y")
        boosting.fit_trees(prepared.train.where("false"), "id", "y", prepared.spec, p)
    one = models.prepare(rows.withColumn("y", F.lit(1)), "id", "y")
    nodes = models.train_second_order(one, "id", p).stages[-1].nodes
    assert [n.node for n in nodes] == [1, 1]
    texts = models.prepare(rows.select("id", "c", "y"), "id", "y")
    assert any(n.slot is not None for n in models.train_second_order(texts, "id", p).stages[-1].nodes)
    numbers = models.prepare(rows.select("id", "a", "b", "y"), "id", "y")
    assert any(n.slot == 0 for n in models.train_second_order(numbers, "id", p).stages[-1].nodes)
    gaps = rows.withColumn("a", F.when(F.col("id") % 5 > 0, F.col("a"))).withColumn("y", F.when(F.col("id") > 20, F.col("y")))
    assert models.train_second_order(models.prepare(gaps, "id", "y"), "id", p).stages[-1].nodes[0].rows == 379


def test_a_category_for_every_row(spark):
    rows = table(spark).withColumn("name", F.concat(F.lit("n"), "id"))
    prepared = models.prepare(rows, "id", "y")
    model = models.train_second_order(prepared, "id", replace(WHOLE, trees=2, min_curvature=0.1))
    assert prepared.spec.size == 405 and len(model.stages[-1].featureImportances) == 405
    assert model.transform(rows).where(F.get(vector_to_array("probability"), F.lit(1)).between(0, 1)).count() == 400
