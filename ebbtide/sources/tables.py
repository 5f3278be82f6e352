"""Parquet sources and the customer table derived from the order star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.functions.shaping import present

CUTOFF = "2001-02-01"
URGENT = "1-URGENT"

CUSTOMER_COLUMNS = [
    "customer_id", "segment_name", "region", "signup_date", "signup_month", "tenure_days", "order_count",
    "total_charges", "monthly_charges", "urgent_orders", "contract_type", "support_events", "acct_balance", "churn",
]


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet table with NaN read as NULL; projection and filters reach the scan."""
    df = spark.read.parquet(path)
    return df.select(*[present(df, c).alias(c) for c in (columns or df.columns)])


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    return read_parquet(spark, f"{folder}/{name}.parquet", columns)


def order_history(orders: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """One row per customer with an order before the cutoff.

    The first aggregation is by (customer, priority) and combines map-side, so a customer holding a
    large share of all orders leaves each task as a handful of rows; the second only folds those.
    """
    before = F.col("o_orderdate") < F.lit(cutoff).cast("timestamp_ntz")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")  # integer sums do not depend on row order
    per_priority = orders.groupBy("o_custkey", "o_orderpriority").agg(
        F.count_if(before).alias("n"),
        F.min(F.when(before, F.col("o_orderdate"))).alias("first_order"),
        F.sum(F.when(before, cents)).alias("cents"),
        F.max((~before).cast("int")).alias("active"),
    )
    commonest = F.min(F.when(F.col("n") > 0, F.struct(-F.col("n"), F.col("o_orderpriority").alias("priority"))))
    return (
        per_priority.groupBy(F.col("o_custkey").alias("customer_id"))
        .agg(
            F.sum("n").alias("order_count"),
            F.min("first_order").cast("date").alias("signup_date"),
            (F.sum("cents") / F.lit(100.0)).alias("total_charges"),
            F.coalesce(F.sum(F.when(F.col("o_orderpriority") == URGENT, F.col("n"))), F.lit(0)).alias("urgent_orders"),
            commonest["priority"].alias("contract_type"),
            F.max("active").alias("active"),
        )
        .where(F.col("order_count") > 0)
    )


def customer_table(spark: SparkSession, folder: str, cutoff: str = CUTOFF) -> DataFrame:
    """Customers with an order before the cutoff, as CUSTOMER_COLUMNS."""
    customer = read_table(spark, folder, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    nation = read_table(spark, folder, "nation", ["n_nationkey", "n_regionkey"])
    region = read_table(spark, folder, "region", ["r_regionkey", "r_name"])
    orders = read_table(
        spark, folder, "orders", ["o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"]
    )
    errors = (
        read_table(spark, folder, "events", ["user_id", "event_type"])
        .where(F.col("event_type") == "error")
        .groupBy(F.col("user_id").alias("customer_id"))
        .agg(F.count(F.lit(1)).alias("support_events"))
    )
    tenure = F.date_diff(F.lit(cutoff).cast("date"), F.col("signup_date"))
    return (
        customer.withColumnRenamed("c_custkey", "customer_id")
        .join(order_history(orders, cutoff), "customer_id")
        .join(errors, "customer_id", "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "customer_id",
            F.col("c_mktsegment").alias("segment_name"),
            F.col("r_name").alias("region"),
            "signup_date",
            F.date_format("signup_date", "yyyy-MM").alias("signup_month"),
            tenure.alias("tenure_days"),
            "order_count",
            "total_charges",
            (F.col("total_charges") * 30.0 / tenure).alias("monthly_charges"),
            "urgent_orders",
            "contract_type",
            F.coalesce("support_events", F.lit(0)).alias("support_events"),
            F.col("c_acctbal").alias("acct_balance"),
            F.when(F.col("active") == 1, "No").otherwise("Yes").alias("churn"),
        )
    )


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Keep a result: Parquet on any Hadoop file system, replacing what is there."""
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)
