"""Small frames with known answers."""

import math
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ebbtide.functions import ranking, roles
from ebbtide.functions.shaping import long_numbers
from ebbtide.operators import cohort, label, metrics, prep, profile, quantiles, roi, rules, segments
from ebbtide.plans import model_queries
from ebbtide.sources import csv


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- label ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("values,kind,expected", [
    (["Yes", "No", None], "string", [1, 0, None]),
    (["Yes", "no"], "string", [1, 0]),
    (["TRUE", "false"], "string", [1, 0]),
    (["Yes", "Yes"], "string", [1, 1]),
    (["stayed", "left"], "string", [1, 0]),
    ([0, 1, 1], "int", [0, 1, 1]),
    ([0, 0], "int", [0, 0]),
    ([10, 9, None], "int", [1, 0, None]),
    ([True, False], "boolean", [1, 0]),
    ([1.0, 0.0, float("nan")], "double", [1, 0, None]),
])
def test_label_values(spark, values, kind, expected):
    df = frame(spark, list(enumerate(values)), f"i int, y {kind}")
    assert [r["churned"] for r in label.normalize_label(df, "y").orderBy("i").collect()] == expected


@pytest.mark.parametrize("values", [["a", "b", "c"], ["x", "x"]])
def test_label_errors(spark, values):
    df = frame(spark, [(v,) for v in values], "y string")
    with pytest.raises(PySparkException):
        label.normalize_label(df, "y").collect()


@pytest.mark.parametrize("values,passed", [(["a"], True), (["a", "b", None], True), (["a", "b", "c"], False)])
def test_label_check(spark, values, passed):
    assert label.label_check(frame(spark, [(v,) for v in values], "y string"), "y").first()["passed"] is passed


# --- roles and validation ---------------------------------------------------------------------------


def test_roles(spark):
    df = frame(spark, [], "id long, Monthly_Usage double, JoinDate date, CHURN_flag string, last_churn string, active boolean")
    assert roles.target_column(df) == "CHURN_flag"
    assert roles.cohort_candidates(df) == ["Monthly_Usage", "JoinDate"]
    assert roles.date_candidates(df) == ["JoinDate"]
    assert roles.segmentation_defaults(df) == ["Monthly_Usage"]
    assert roles.column_role(df, "active") == "boolean"


@pytest.mark.parametrize("n,passed", [(9, False), (10, True)])
def test_minimum_rows(spark, n, passed):
    checks = {r["check"]: r["passed"] for r in profile.validate_table(spark.range(n).withColumn("Churn", F.lit(1))).collect()}
    assert checks == {"min_rows": passed, "target_column": True}


def test_text_time_column_is_refused(spark):
    df = frame(spark, [("a", 1)], "t string, churn int")
    with pytest.raises(TypeError):
        cohort.time_bins(df, "t")
    checks = {r["check"]: r["passed"] for r in profile.validate_table(df, time_column="t").collect()}
    assert checks["numeric_time"] is False


def test_no_target(spark):
    checks = {r["check"]: r["passed"] for r in profile.validate_table(spark.range(20)).collect()}
    assert checks["target_column"] is False


# --- cohort -----------------------------------------------------------------------------------------


def test_bins(spark):
    values = [0, 7, 8, 72, -1, None, 1, 2, 3, 4, 5, 6, 9]
    df = frame(spark, [(i, v) for i, v in enumerate(values)], "i int, t bigint")
    found = {r["t"]: (r["bin_lo"], r["period"]) for r in cohort.time_bins(df, "t").collect()}
    assert found[0] == (0, "0-6") and found[7] == (0, "0-6") and found[8] == (7, "7-13")
    assert found[72] == (70, "70-76") and found[-1] == (None, None) and found[None] == (None, None)


def test_few_values_are_not_binned(spark):
    df = frame(spark, [(v,) for v in [3, 1, 2, 1, None]], "t int")
    assert {(r["bin_lo"], r["period"]) for r in cohort.time_bins(df, "t").collect()} == {
        (1, "1"), (2, "2"), (3, "3"), (None, None)}


def test_fractional_time(spark):
    df = frame(spark, [(float(v) + 0.5,) for v in range(30)], "t double")
    found = {r["t"]: r["bin_lo"] for r in cohort.time_bins(df, "t").collect()}
    assert found[0.5] == 0 and found[2.5] == 2 and found[29.5] == 28


def test_few_fractional_values_stay_apart(spark):
    df = frame(spark, [(1.2,), (1.8,), (None,)], "t double")
    found = {(r["bin_lo"], r["period"]) for r in cohort.time_bins(df, "t").collect()}
    assert found == {(1.2, "1.2"), (1.8, "1.8"), (None, None)}


def test_cohort_choice(spark):
    df = frame(spark, [("2020-02-03", "a"), ("nonsense", "b")], "d string, c string")
    assert [r["cohort"] for r in cohort.choose_cohort(df, date="d").orderBy("c").collect()] == ["2020-02", None]
    assert [r["cohort"] for r in cohort.choose_cohort(df, existing="c", date="d").orderBy("c").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        cohort.choose_cohort(df)


def test_average_is_of_cells_not_customers(spark):
    rows = [("a", 1, 1)] + [("a", 2, 0)] * 9
    df = frame(spark, rows, "c string, t int, y int")
    cells = cohort.cohort_cells(cohort.time_bins(df, "t"), "c", "y")
    assert cohort.avg_churn_by_cohort(cells).first()["avg_churn_rate"] == 0.5


@pytest.mark.parametrize("rates,pattern,ratio", [
    ([0.5, 0.0], "early", None), ([0.1, 0.2], "late", 2.0), ([0.10, 0.11], "consistent", 1.1),
])
def test_pattern(spark, rates, pattern, ratio):
    halves = frame(spark, [("early", rates[0]), ("late", rates[1])], "half string, avg_churn_rate double")
    row = cohort.early_late_pattern(halves).first()
    assert row["pattern"] == pattern
    assert row["ratio"] == (None if ratio is None else pytest.approx(ratio))


# --- profile ----------------------------------------------------------------------------------------


def test_null_safe_duplicates(spark):
    df = frame(spark, [(1, "x"), (1, "x"), (None, None), (None, None), (None, "x"), (2, None)], "a int, b string")
    assert profile.duplicate_rows(df).first()["duplicates"] == 2


def test_duplicates_of_mixed_columns(spark):
    rows = [(i % 7, None if i % 5 == 0 else f"v{i % 5}", -0.0 if i % 2 else 0.0) for i in range(200)]
    df = frame(spark, rows, "a int, b string, c double")
    assert profile.duplicate_rows(df).first()["duplicates"] == 200 - 35


def test_empty_table(spark):
    df = frame(spark, [], "a int, b string")
    row = profile.duplicate_rows(df).first()
    assert (row["n_rows"], row["duplicates"], row["duplicate_pct"]) == (0, 0, None)


def test_nan_counts_as_missing(spark):
    df = frame(spark, [(1.0,), (float("nan"),), (None,)], "x double")
    for how in ("exact", "approx", "none"):
        assert profile.column_profile(df, how).first()["missing"] == 2
    assert profile.column_profile(df, "approx").first()["distinct_values"] == 1


def test_describe_sketch_is_close(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    row = profile.numeric_describe(df, exact=False).first()
    assert (row["q25"], row["q50"], row["q75"]) == (250.0, 500.0, 750.0)


def test_histogram_of_a_constant(spark):
    row = profile.histogram(frame(spark, [(5.0,)] * 3, "x double"), "x").collect()
    assert [(r["bin"], r["n"]) for r in row] == [(0, 3)]


def test_correlation_with_gaps_and_constants(spark):
    rows = [(float(i), float(i * i % 17), 2.0, None if i % 5 == 0 else float(-i), 1e9 + i % 3,
             float("nan") if i > 3 else 7.0, None) for i in range(60)]
    df = frame(spark, rows, "a double, b double, flat double, d double, far double, e double, none double").repartition(4)
    found = {(r[0], r[1]): r[2] for r in profile.correlation_matrix(df).collect()}
    assert len(found) == 49
    columns = dict(zip(df.columns, zip(*rows)))
    for (x, y), value in found.items():
        both = [(p, q) for p, q in zip(columns[x], columns[y]) if None not in (p, q) and p == p and q == q]
        if len({p for p, _ in both}) < 2 or len({q for _, q in both}) < 2:
            assert value is None, (x, y)
        else:
            assert value == pytest.approx(statistics.correlation(*zip(*both)), abs=1e-6), (x, y)
    assert found["a", "d"] == pytest.approx(-1)
    single = {r["column"]: r["correlation"] for r in profile.correlation_with(df, ["b", "flat", "d"], "a").collect()}
    assert single["flat"] is None and all(single[c] == pytest.approx(found[c, "a"], abs=1e-9) for c in "bd")


def test_profile_of_an_empty_table(spark):
    rows = profile.column_profile(frame(spark, [], "a int, b string, c double, d double")).collect()
    assert sorted((r["column"], r["missing"], r["missing_pct"], r["distinct_values"]) for r in rows) == [
        (c, 0, None, 0) for c in "abcd"]


def test_text_profile(spark):
    df = frame(spark, [("s", "b", 1), ("s", "a", 3), ("s", None, 5)], "segment string, c string, x int")
    row = segments.segment_profile(df, "segment", ["x", "c"]).first()
    assert (row["x"], row["c"]) == (3.0, "a")


# --- quantiles --------------------------------------------------------------------------------------


def linear(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    low = math.floor(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


def test_quantiles_by_ranges(spark):
    data = {
        "even": [float(i) for i in range(1000)],
        "skewed": [0.0] * 700 + [float(i * i) for i in range(500)],
        "constant": [4.0] * 300,
        "tiny": [1.0, 2.0, 3.0, 10.0],
        "negative": [(-1.0) ** i * i / 7 for i in range(801)],
        None: [float(i % 13) for i in range(100)],
    }
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("tiny", None), ("nothing", None)]
    long = frame(spark, rows, "column string, value double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps all ranges apart
    try:
        got = {(r["column"], r["q"]): r["value"] for r in quantiles.exact_quantiles(long.repartition(8), probabilities).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(got) == len(data) * len(probabilities)
    for (k, q), value in got.items():
        assert value == pytest.approx(linear(data[k], q), abs=1e-9), (k, q)


def test_quantiles_of_many_groups(spark):
    long = spark.range(60_000).selectExpr("string(id % 20000) as column", "double(id) as value")
    rows = quantiles.exact_quantiles(long, [0.5]).collect()
    assert len(rows) == 20_000 and all(r["value"] == int(r["column"]) + 20_000 for r in rows)


def test_running_totals(spark):
    rows = [("a" if i % 3 else None, i, i % 7) for i in range(500)]
    df = frame(spark, rows, "g string, t int, w int").repartition(6)
    found = {r["t"]: r["before"] for r in ranking.running_total(df, ["g"], ["t"], F.col("w")).collect()}
    assert len(found) == 500
    for g, t, _ in rows:
        assert found[t] == sum(w for h, u, w in rows if h == g and u < t)


def test_even_median(spark):
    df = frame(spark, [(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    assert prep.medians(df, ["x"]) == {"x": 2.5}
    assert sorted(r["x"] for r in prep.impute_median(df, ["x"]).collect()) == [1.0, 2.0, 2.5, 3.0, 10.0]


# --- preparation ------------------------------------------------------------------------------------


def test_mode_tie(spark):
    df = frame(spark, [("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert prep.modes(df, ["c"]) == {"c": "a"}


def test_zero_variance(spark):
    df = frame(spark, [(5.0,)] * 3, "x double")
    assert [r["x"] for r in prep.standardize(df, ["x"]).collect()] == [0.0, 0.0, 0.0]


def test_onehot_of_unknown_values(spark):
    df = frame(spark, [(1, "a"), (2, "z"), (3, None)], "id int, c string")
    found = prep.onehot(df, "id", ["c"], categories={"c": ["a", "b"]}, fill_mode=False).collect()
    assert [(r["id"], r["feature"]) for r in found] == [(1, "c_a")]


@pytest.mark.parametrize("size", [0.1, 0.25, 0.5])
def test_exact_quota(spark, size):
    df = spark.range(1003).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("y"))
    split = prep.stratified_split(df, "id", "y", size)
    counts = {(r["y"], r["split"]): r["count"] for r in split.groupBy("y", "split").count().collect()}
    tests = counts[0, "test"] + counts[1, "test"]
    assert tests == math.ceil(size * 1003)
    assert abs(counts[1, "test"] - tests * 335 / 1003) < 1


def test_rows_without_a_class_have_no_split(spark):
    df = frame(spark, [(i, None if i % 4 == 0 else i % 2) for i in range(80)], "id long, y int")
    rows = prep.stratified_split(df, "id", "y").collect()
    assert len(rows) == 80 and all((r["split"] is None) == (r["y"] is None) for r in rows)
    assert sum(r["split"] == "test" for r in rows) == 15


def test_many_classes_share_the_quota(spark):
    df = spark.range(3000).selectExpr("id", "concat('c', id % 700) as y")
    found = {r["split"]: r["count"] for r in prep.stratified_split(df, "id", "y").groupBy("split").count().collect()}
    assert found == {"test": 750, "train": 2250}


def test_nan_is_no_score(spark):
    df = frame(spark, [(1, 0.9), (0, 0.1), (1, float("nan")), (0, None)], "y int, s double")
    row = metrics.classification_metrics(df, "y", "s").first()
    assert (row["accuracy"], row["roc_auc"]) == (1.0, 1.0)
    assert metrics.high_risk_customers(df, "s").count() == 1
    assert [r["prediction"] for r in metrics.threshold_prediction(df, "s").collect()] == ["Churned", "Not Churned", None, None]


def test_split_with_equal_hashes(spark, monkeypatch):
    monkeypatch.setattr(prep, "wide_hash", lambda key, salt: F.lit(1.0))
    df = spark.range(100).select("id", (F.col("id") % 2).cast("int").alias("y"))
    split = prep.stratified_split(df, "id", "y", 0.25)
    assert split.where("split = 'test'").count() == 25


def test_integrity_finds_leaks(spark):
    whole, train, test = spark.range(10), spark.range(0, 6), spark.range(5, 9)
    row = prep.split_integrity(whole, train, test, "id").first()
    assert (row["in_both"], row["in_neither"], row["passed"]) == (1, 1, False)


# --- metrics ----------------------------------------------------------------------------------------


def test_auc_of_equal_scores(spark):
    df = frame(spark, [(0, 0.3), (1, 0.3), (1, 0.3)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()[0] == 0.5


def test_auc_of_one_class(spark):
    assert metrics.roc_auc(frame(spark, [(1, 0.3)], "y int, s double"), "y", "s").first()[0] is None


def test_no_positive_predictions(spark):
    df = frame(spark, [(0, 0.1), (1, 0.2), (1, None)], "y int, s double")
    row = metrics.classification_metrics(df, "y", "s").first()
    assert (row["precision"], row["recall"], row["f1_score"]) == (0.0, 0.0, 0.0)
    cells = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion_matrix(df, "y", "s").collect()}
    assert cells == {(0, 0): 1, (0, 1): 0, (1, 0): 1, (1, 1): 0}


def test_metrics_per_model(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.1), ("b", 0, 0.9)]
    df = frame(spark, rows, "model string, y int, s double")
    found = {r["model"]: r["roc_auc"] for r in metrics.classification_metrics(df, "y", "s", by="model").collect()}
    assert found == {"a": 1.0, "b": 0.0}


# --- segments, advice, return -----------------------------------------------------------------------


def test_two_segments_are_in_both_lists(spark):
    df = frame(spark, [("s1", 1), ("s1", 0), ("s2", 0)], "segment string, churned int")
    found = segments.segment_priority(segments.segment_summary(df, "segment", "churned")).collect()
    assert sorted((r["segment"], r["list"]) for r in found) == [
        ("s1", "high_risk"), ("s1", "low_risk"), ("s2", "high_risk"), ("s2", "low_risk")]


@pytest.mark.parametrize("rate,tier", [(0.31, "high"), (0.30, "medium"), (0.15, "low"), (0.0, "low")])
def test_tier_cuts(spark, rate, tier):
    assert segments.segment_risk_tier(frame(spark, [(rate,)], "churn_rate double")).first()["tier"] == tier


@pytest.mark.parametrize("features,specific,total", [
    (["alpha", "beta"], 0, 3), (["Contract_x"], 1, 3), (["contract", "tenure", "monthly_charge", "support"], 4, 4), ([], 0, 3),
])
def test_recommendations_are_filled_to_three(spark, features, specific, total):
    table = frame(spark, [(f, 1.0 / (i + 1)) for i, f in enumerate(features)], "feature string, importance double")
    found = rules.retention_recommendations(table).collect()
    assert len(found) == total and sum(r["specific"] for r in found) == specific
    assert sorted(r["position"] for r in found) == list(range(1, total + 1))


def test_actions_need_all_words_in_one_feature(spark):
    table = frame(spark, [("monthly_x", 0.5), ("charge_y", 0.4)], "feature string, importance double")
    assert not any(r["specific"] for r in rules.recommended_actions(table).collect())
    table = frame(spark, [("MonthlyCharges", 0.5)], "feature string, importance double")
    found = [r for r in rules.recommended_actions(table).collect() if r["specific"]]
    assert [(r["rule"], r["keywords"], r["feature"], r["rank"]) for r in found] == [(3, "monthly charge", "MonthlyCharges", 1)]


def test_return_by_hand(spark):
    summary = frame(spark, [("all", 1000, 0.15)], "segment string, size long, churn_rate double")
    rows = {r["scenario"]: r for r in roi.roi_scenarios(summary).collect()}
    base = rows["base"]
    assert base["customers_saved"] == pytest.approx(30) and base["revenue_protected"] == pytest.approx(30000)
    assert base["net_benefit"] == pytest.approx(-20000) and base["roi_pct"] == pytest.approx(-40)
    assert rows["zero_cost"]["roi_pct"] is None and rows["zero_cost"]["free"]


# --- CSV --------------------------------------------------------------------------------------------

DIRTY = '''customerID,Tenure,MonthlyCharges,IsActive,JoinDate,Contract,CHURN
c1,0,29.85,true,2020-01-05,month,Yes
c2,,NA,false,2020-02-30x,"two, year",No
c3,7,NaN,true,2020-03-01,,
c4,8, ,,2020-03-01,"say ""hi""",No
'''


def test_dirty_csv(spark, tmp_path):
    path = tmp_path / "dirty.csv"
    path.write_text(DIRTY)
    rows, checks = csv.ingest_csv(spark, str(path))
    assert [t for _, t in rows.dtypes] == ["string", "bigint", "double", "boolean", "string", "string", "string"]
    got = [tuple(r) for r in rows.orderBy("customerID").collect()]
    assert got[1] == ("c2", None, None, False, "2020-02-30x", "two, year", "No")
    assert got[3] == ("c4", 8, None, None, "2020-03-01", 'say "hi"', "No")
    passed = {r["check"]: r["passed"] for r in checks.collect()}
    assert passed == {"min_rows": False, "target_column": True, "well_formed": True, "label_values": True}


def test_late_text_makes_a_text_column(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_text("id,x,churn\n" + "".join(f"{i},{i},Yes\n" for i in range(500)) + "500,many,No\n")
    assert dict(csv.read_csv(spark, str(path)).dtypes)["x"] == "string"


def test_malformed_lines_are_reported(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("a,churn\n1,Yes\n2,No,extra\n")
    checks = {r["check"]: (r["passed"], r["detail"]) for r in csv.ingest_csv(spark, str(path))[1].collect()}
    assert checks["well_formed"] == (False, "1 malformed lines")
    rows = csv.ingest_csv(spark, str(path))[0]
    assert rows.count() == 1 and [tuple(r) for r in rows.collect()] == [(1, "Yes")]
    assert [r["line"] for r in csv.bad_lines(spark, str(path)).collect()] == ["2,No,extra"]
    with pytest.raises(ValueError, match="1 malformed"):
        csv.read_csv(spark, str(path))


def test_columns_are_matched_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,plan,churn\n1,x,Yes\n2,y,No\n")
    (tmp_path / "b.csv").write_text("plan,churn,id\nz,No,3\nshort\n")
    rows, checks = csv.ingest_csv(spark, str(tmp_path))
    assert sorted(tuple(r) for r in rows.select("id", "plan", "churn").collect()) == [(1, "x", "Yes"), (2, "y", "No"), (3, "z", "No")]
    assert [r["line"] for r in csv.bad_lines(spark, str(tmp_path)).collect()] == ["short"]
    (tmp_path / "c.csv").write_text("id,other\n4,w\n")
    with pytest.raises(ValueError, match="differ"):
        csv.ingest_csv(spark, str(tmp_path))


def test_pinned_types(spark, tmp_path):
    from pyspark.sql import types as T

    path = tmp_path / "pinned.csv"
    path.write_text("a,churn\n1,Yes\nx,No\n")
    rows = csv.read_csv(spark, str(path), {"a": T.LongType(), "churn": T.StringType()})
    assert [tuple(r) for r in rows.orderBy("churn").collect()] == [(None, "No"), (1, "Yes")]


# --- partitioning -----------------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 2, 8])
def test_partitioning_changes_nothing(spark, parts):
    rows = [(i, f"c{i % 12:02d}", (i * 37) % 113, i % 3 == 0 and 1 or 0, f"t{i % 4}" if i % 9 else None) for i in range(600)]
    df = frame(spark, rows, "id int, c string, t int, y int, k string").repartition(parts)
    cells = cohort.cohort_churn(df, "c", "t", "y")
    assert sorted(map(tuple, cells.collect())) == sorted(
        map(tuple, cohort.cohort_churn(frame(spark, rows, df.schema).coalesce(1).orderBy(F.desc("id")), "c", "t", "y").collect()))
    assert prep.stratified_split(df, "id", "y").where("split = 'test'").agg(F.sum("id")).first()[0] == \
        prep.stratified_split(df.coalesce(1), "id", "y").where("split = 'test'").agg(F.sum("id")).first()[0]
    assert prep.medians(df, ["t"]) == {"t": linear([r[2] for r in rows], 0.5)}
    assert long_numbers(df, ["t", "y"]).count() == 1200


def test_csv_names_and_blanks_survive(spark, tmp_path):
    path = tmp_path / "dots.csv"
    path.write_text("Monthly.Charges,plan,churn\n1.5, a ,Yes\n2,b,No\n")
    rows = csv.read_csv(spark, str(path))
    assert rows.columns == ["Monthly_Charges", "plan", "churn"]
    csv.write_csv(rows, str(tmp_path / "again"))
    again = csv.read_csv(spark, str(tmp_path / "again"))
    assert sorted(map(tuple, again.collect())) == [(1.5, " a ", "Yes"), (2.0, "b", "No")]


def test_booleans_are_features(spark):
    df = frame(spark, [(1, True), (2, False), (3, None), (4, False)], "id int, active boolean")
    spec = prep.fit_features(df, exclude=("id",))
    assert spec.numeric == ["active"] and spec.fill == {"active": 0.0}
    rows = spec.pipeline(df).transform(df).orderBy("id").collect()
    assert rows[0]["features"][0] > 0 and rows[1]["features"][0] == rows[2]["features"][0] < 0


def test_slots_are_the_encoder_s(spark):
    rows = [(1, 1.5, "b", "x_y", None), (2, None, "a", None, None), (3, 2.0, "B", "é", None), (4, 2.0, "a", "Z", None)]
    df = frame(spark, rows, "id int, x double, t string, u string, void double")
    encoded = prep.fit_features(df, exclude=("id",)).pipeline(df).transform(df)
    slots = sorted(prep.feature_slots(df, exclude=("id",)).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in slots] == list(range(len(slots)))
    assert ["_".join(filter(lambda v: v is not None, r[:2])) for r in slots] == prep.feature_names(encoded)
    assert [r["n"] for r in slots] == [3, 1, 2, 1, 1, 1, 1]
    assert prep.feature_slots(df.select("id", "t"), exclude=("id",)).count() == 3
    assert prep.feature_slots(df.select("id", "x"), exclude=("id",)).count() == 1


def test_wide_names_stay_off_the_driver(spark, monkeypatch):
    def refuse(*_args, **_kwargs):
        raise AssertionError("names on the driver")

    monkeypatch.setattr(prep, "category_counts", refuse)
    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    found = model_queries.feature_names_wide(spark, "/root/testdata/sf0.001")
    assert found.where("feature like 'c_name_%'").count() > 0
