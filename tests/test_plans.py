"""What the physical plans must and must not contain."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from ebbtide.operators import cohort, metrics, prep, profile, segments
from ebbtide.plans import fixtures
from ebbtide.plans.registry import base, planted
from ebbtide.sources import tables

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text: str) -> int:
    """Table reads of an executed plan: every final plan, subqueries included."""
    return sum(part.split("Initial Plan")[0].count("FileScan") for part in text.split("Final Plan")[1:])


@pytest.mark.parametrize("name", sorted(
    set(contract.oracle_sql()) - {"csv_ingest", "parquet_sink"}
))
def test_no_cross_joins(spark, name):
    text = plan(contract.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_star_join_scans(spark):
    text = plan(tables.customer_table(spark, FOLDER))
    assert "EqualTo(event_type,error)" in text  # filter reaches the scan
    orders = next(line for line in text.splitlines() if "o_orderpriority" in line and "FileScan" in line)
    assert set(re.findall(r"(o_\w+):", orders.split("ReadSchema")[1])) == {
        "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"}
    assert "props" not in text and "o_orderstatus" not in text


def test_reports_read_their_columns_only(spark):
    rows = base(spark, FOLDER)
    text = plan(segments.segment_summary(fixtures.fixed_segments(rows), "segment", "churned"))
    assert "ReadSchema: struct<raw_balance:double,churned:int>" in text
    text = plan(profile.category_by_target(rows, "contract_type", "churn"))
    assert "ReadSchema: struct<contract_type:string,churn:string>" in text


def test_groupings_combine_before_the_shuffle(spark):
    rows = base(spark, FOLDER)
    for df in (
        cohort.cohort_churn(rows, "signup_month", "tenure_days", "churned"),
        segments.churn_rate_by_group(rows, "region", "churned"),
        profile.top_values(rows, ["region", "contract_type"]),
        metrics.outcome_counts(planted(spark, FOLDER), "churn", "score"),
    ):
        text = plan(df)
        assert "partial_" in text


def test_rankings_are_cut_before_the_shuffle(spark):
    text = plan(profile.top_values(base(spark, FOLDER), ["region", "contract_type"]))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_default_split_does_not_shuffle(spark):
    text = plan(prep.hash_split(planted(spark, FOLDER), "customer_id"))
    assert "Exchange" not in text


def test_top_cohorts_join_is_a_broadcast_semi_join(spark):
    text = plan(cohort.keep_top_cohorts(base(spark, FOLDER), "signup_month"))
    assert "BroadcastHashJoin" in text and "LeftSemi" in text and "TakeOrderedAndProject" in text


def test_preparation_is_a_projection(spark):
    rows = planted(spark, FOLDER).select("customer_id", "order_count", "region")
    text = plan(prep.fit_features(rows, exclude=("customer_id",)).pipeline(rows).transform(rows))
    assert "Exchange" not in text and "Join" not in text


def test_global_numbers_are_read_once(spark):
    df = profile.histogram(base(spark, FOLDER), "total_charges")
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert scans(text) <= 2  # the ends, then the bins


def test_stage_folder_is_the_shared_folder(spark):
    from ebbtide.session import stage_root

    assert stage_root(spark).startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))
    assert spark.sparkContext.applicationId in stage_root(spark)


def test_stage_tables_can_be_released(spark):
    from ebbtide.session import release, stage

    kept, gone = stage(spark.range(5), "kept"), stage(spark.range(5), "gone")
    release(gone)
    assert kept.count() == 5
    with pytest.raises(Exception, match="(?i)not.*exist"):
        gone.count()
    with pytest.raises(ValueError):
        release(spark.read.parquet(f"{FOLDER}/region.parquet"))


def test_nothing_uses_local_scratch_folders():
    root = os.path.dirname(os.path.abspath(contract.__file__))
    for path in glob.glob(f"{root}/ebbtide/**/*.py", recursive=True):
        with open(path) as source:
            text = source.read()
        assert "tempfile" not in text and "localCheckpoint" not in text and ".cache()" not in text, path


def test_changed_files_give_changed_answers(spark, tmp_path):
    folder = str(tmp_path / "tables")
    for name in ("customer", "nation", "region", "orders", "events"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    before = base(spark, folder).count()
    assert base(spark, folder).count() == before
    fewer = spark.read.parquet(f"{FOLDER}/customer.parquet").where("c_custkey <= 20")
    fewer.write.mode("overwrite").parquet(f"{folder}/customer.parquet")
    assert 0 < base(spark, folder).count() <= 21 < before


@pytest.mark.parametrize("n", [8, 50])
def test_correlation_reads_twice_whatever_the_width(spark, tmp_path, n):
    cells = [F.when(F.pmod(F.hash("id", F.lit(i)), 5) > 0, F.rand(i)).alias(f"c{i}") for i in range(n)]
    spark.range(400).select(*cells).write.parquet(str(tmp_path / "wide"))
    found = profile.correlation_matrix(spark.read.parquet(str(tmp_path / "wide")))
    rows = found.collect()
    assert len(rows) == n * n and scans(plan(found)) == 1  # beside the pass for means


def test_quantiles_read_their_source_once(spark):
    from ebbtide.operators.quantiles import exact_quantiles

    found = exact_quantiles(base(spark, FOLDER).selectExpr("region as column", "double(tenure_days) as value"), [0.5])
    text = plan(found)
    assert all("customers-" not in line for line in text.splitlines() if "FileScan" in line)  # only counted values


def test_rows_survive_the_sink(spark, tmp_path):
    rows = base(spark, FOLDER).select("customer_id", "churn", F.col("signup_date"))
    tables.write_parquet(rows, str(tmp_path / "out"), partition_by=["churn"])
    back = tables.read_parquet(spark, str(tmp_path / "out"), ["customer_id", "churn", "signup_date"])
    assert back.exceptAll(rows).count() == 0 and rows.exceptAll(back).count() == 0


def test_cohort_churn_reads_the_table_three_times(spark):
    df = cohort.cohort_churn(base(spark, FOLDER), "signup_month", "tenure_days", "churned")
    df.collect()
    assert scans(plan(df)) <= 3  # bin width, largest cohorts, cells


def test_label_is_read_twice(spark):
    from ebbtide.operators.label import normalize_label

    df = normalize_label(base(spark, FOLDER).select("customer_id", "churn"), "churn", "y")
    df.collect()
    assert scans(plan(df)) <= 2
