"""Return on a retention programme: scenarios against groups of customers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.shaping import fan_out


@dataclass(frozen=True)
class Scenario:
    """The defaults are the calculator's starting inputs."""

    name: str = "base"
    churn_reduction_pct: float = 20.0
    customer_value: float = 1000.0
    program_cost: float = 50000.0


SCENARIOS = (
    Scenario(),
    Scenario("low", churn_reduction_pct=5.0),
    Scenario("high", churn_reduction_pct=50.0),
    Scenario("zero_cost", program_cost=0.0),
)


def roi_scenarios(summary: DataFrame, group: str = "segment", customers: str = "size", rate: str = "churn_rate",
                  scenarios=SCENARIOS) -> DataFrame:
    """Every scenario for every group: the scenario list is unfolded on each row, so there is no join.

    Without a cost the return has no finite value: it is NULL and ``free`` is true.
    """
    rows = [
        F.struct(
            F.lit(s.name).alias("scenario"), F.lit(s.churn_reduction_pct).alias("churn_reduction_pct"),
            F.lit(s.customer_value).alias("customer_value"), F.lit(s.program_cost).alias("program_cost"),
        )
        for s in scenarios
    ]
    table = fan_out(summary, [group, customers, rate], rows)
    lowered = F.col(rate) * (1 - F.col("churn_reduction_pct") / 100)
    table = table.withColumn("customers_saved", F.col(customers) * (F.col(rate) - lowered))
    table = table.withColumn("revenue_protected", F.col("customers_saved") * F.col("customer_value"))
    table = table.withColumn("net_benefit", F.col("revenue_protected") - F.col("program_cost"))
    free = F.col("program_cost") <= 0
    return table.withColumn(
        "roi_pct", F.when(~free, F.try_divide(F.col("net_benefit"), F.col("program_cost")) * 100)
    ).withColumn("free", free)
