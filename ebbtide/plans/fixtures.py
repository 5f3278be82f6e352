"""Tables with planted properties, derived from the customer table, for queries that need a known answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.hashing import unit_hash


def with_gaps(customers: DataFrame) -> DataFrame:
    """One contract type in 23 and one balance in 17 missing, the true balance kept as ``raw_balance``."""
    return customers.withColumns({
        "raw_balance": F.col("acct_balance"),
        "contract_type": F.when(F.col("customer_id") % 23 != 0, F.col("contract_type")),
        "acct_balance": F.when(F.col("customer_id") % 17 != 0, F.col("acct_balance")),
    })


def planted_signal(base: DataFrame) -> DataFrame:
    """Customers with a label that follows a known score, for learning and metric operators."""
    key = F.col("customer_id")
    machinery = (F.col("segment_name") == "MACHINERY").cast("int")
    z = (9 - F.col("order_count")) + machinery - (F.col("raw_balance") / 5000.0 - 1.0)
    noisy = F.col("z") + unit_hash(key, "-9") - 0.5
    return (
        base.select(
            "customer_id", "order_count", F.col("raw_balance").alias("acct_balance_raw"),
            machinery.alias("is_machinery"), "segment_name", "region", z.alias("z"),
        )
        .withColumn("churn", (unit_hash(key, "-7") < 1.0 / (1.0 + F.exp(-F.col("z")))).cast("int"))
        .withColumn("score", F.round(1.0 / (1.0 + F.exp(-noisy)), 6))
        .withColumn("split", F.when(unit_hash(key, "-42") < 0.25, "test").otherwise("train"))
    )


def fixed_segments(base: DataFrame) -> DataFrame:
    """Customers with a segment set by balance bands, so segment reports can be checked exactly."""
    band = (
        F.when(F.col("raw_balance") < 3000, "Segment 1")
        .when(F.col("raw_balance") < 6000, "Segment 2")
        .otherwise("Segment 3")
    )
    return base.withColumn("segment", band)
