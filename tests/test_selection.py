"""Bracketed selection, dictionary encoding, and columns named like the library's own helpers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.functions import ranking
from ebbtide.operators import models, prep, profile, quantiles

WANTED = [0.0, 0.001, 0.25, 0.5, 0.75, 0.9, 1.0]


def test_quantiles_of_large_and_small_groups(spark):
    large = spark.range(60_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 5 == 0, 7.0).otherwise(F.randn(3) * 1e3).alias("value"))
    equal = spark.range(20_000).select(F.lit(5).cast("long").alias("k"), F.lit(1.0).alias("value"))
    odd = spark.createDataFrame([(None, float(v)) for v in (3, 1, 2, 2)] + [(9, 4.0), (9, None), (9, math.nan), (8, None)], "k long, value double")
    rows = large.unionByName(equal).unionByName(odd)
    values = {}
    for r in rows.collect():
        if r["value"] is not None and not math.isnan(r["value"]):
            values.setdefault(r["k"], []).append(r["value"])
    found = {(r["k"], r["q"]): r["value"] for r in quantiles.exact_quantiles(rows, WANTED, "k").collect()}
    assert set(found) == {(k, p) for k in values for p in WANTED}
    for (k, p), got in found.items():
        assert got == pytest.approx(np.quantile(values[k], p), rel=1e-12, abs=1e-12)


def test_few_values_are_shuffled(spark, monkeypatch):
    counted = {}

    def watched(df, name, real=quantiles.stage):
        counted[name] = real(df, name)
        return counted[name]

    monkeypatch.setattr(quantiles, "stage", watched)
    sizes = []
    for n in (50_000, 100_000):
        rows = spark.range(n).select(F.lit(1).alias("k"), F.rand(5).alias("value"))
        assert len(quantiles.exact_quantiles(rows, [0.25, 0.5, 0.75], "k").collect()) == 3
        sizes.append(counted["counted"].count())
        assert sizes[-1] < 0.01 * n  # all values are distinct


def test_running_total_keeps_columns_named_like_its_own(spark):
    names = ["g", "v", "_w", "w", "row", "part", "local", "start", "g0", "o0"]
    df = spark.createDataFrame([(i % 2, i, 5, 6, 7, 8, 9, 10, 11, 12) for i in range(20)], names)
    rows = ranking.running_total(df, ["g"], ["v"], F.lit(2).cast("long")).collect()
    assert all(tuple(r)[2:10] == (5, 6, 7, 8, 9, 10, 11, 12) and r["before"] == 2 * (r["v"] // 2) for r in rows) and len(rows) == 20


def test_split_keeps_columns_named_like_its_own(spark):
    df = spark.createDataFrame([(i, i % 2, 7, "c", 3, 4) for i in range(40)], "id long, y int, _h int, _class string, row int, _key int")
    rows = prep.stratified_split(df, "id", "y").collect()
    assert {tuple(r)[2:6] for r in rows} == {(7, "c", 3, 4)} and sum(r["split"] == "test" for r in rows) == 10


def test_duplicates_of_columns_named_like_its_own(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "_copies int, c0 string")
    assert tuple(profile.duplicate_rows(df).first())[:2] == (3, 1)


def test_joined_and_literal_categories_are_encoded_alike(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(i, float(i % 7) if i % 11 else None, f"c{i % 90}" if i % 13 else None, ("x", "y", None)[i % 3], "z") for i in range(500)],
        "id long, num double, many string, few string, _ev1 string")
    new = rows.unionByName(spark.createDataFrame([(900, math.nan, "unseen", None, "z")], rows.schema))

    def encoded():
        spec = prep.fit_features(rows, exclude=("id",))
        found = spec.pipeline(new).transform(new)
        assert found.columns == [*new.columns, "features"]
        cells = {(r["id"], r["slot"]): r["value"] for r in spec.pipeline(new).cells(new, "id").collect()}
        return spec, {r["id"]: r["features"] for r in found.collect()}, cells

    spec, joined, cells = encoded()
    assert "many" not in spec.literals and set(spec.literals) == {"few", "_ev1"}
    monkeypatch.setattr(prep, "LITERALS", 1000)
    assert "many" in encoded()[0].literals and encoded()[1] == joined
    names = {r["slot"]: r["feature"] for r in spec.names().collect()}
    assert sorted(names) == list(range(spec.size)) == list(range(1 + 90 + 2 + 1))
    for i, vector in joined.items():
        held = {names[int(s)] for s in vector.indices if s >= 1}
        assert held == ({"few_x", "_ev1_z"} if i == 900 else held) and len(held) == (2 if i == 900 else 3)
        assert {s: v for s, v in zip(vector.indices, vector.values) if v} == {s: v for (j, s), v in cells.items() if j == i}


def test_fitting_collects_no_category(spark, monkeypatch):
    def refuse(*_args, **_kwargs):
        raise AssertionError("categories on the driver")

    rows = spark.range(3_000).select(
        "id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") * 1.5).alias("x"))
    monkeypatch.setattr(prep, "category_counts", refuse)
    monkeypatch.setattr(type(rows), "toLocalIterator", refuse)
    real, sizes = type(rows).collect, []

    def counted(self):
        found = real(self)
        sizes.append(len(found))
        return found

    monkeypatch.setattr(type(rows), "collect", counted)
    prepared = models.prepare(rows, "id", "y")
    model = models.train_logistic(prepared, models.LogisticParams(max_iter=5))
    assert max(sizes) < 100 and model.stages[-1].numFeatures == 3_001 and prepared.spec.size == 3_001
    assert models.feature_importance(model, prepared).count() == 3_001


@pytest.mark.parametrize("forced", [False, True])
def test_duplicates_are_compared_in_full(spark, monkeypatch, forced):
    if forced:
        monkeypatch.setattr(profile, "_fingerprint", lambda columns: [F.lit(0), F.lit(0)])
    rows = [(1, None, 0.0), (None, 1, 0.0), (1, None, -0.0), (2, 2, math.nan), (2, 2, math.nan), (2, 2, None), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "a int, b int, x double").repartition(3)
    assert tuple(profile.duplicate_rows(df).first()) == (8, 3, 37.5)
    assert tuple(profile.duplicate_rows(df.limit(0)).first()) == (0, 0, None)
