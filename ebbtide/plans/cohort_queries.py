"""Cohort queries: month of sign-up by tenure."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators import cohort
from ebbtide.plans.registry import BASE, BINS, base, cells, query, rounded, shared
from ebbtide.session import stage

TOP, FEW = cells(10), cells(5)
MAX_PERIODS = 20


def _churn(spark, folder, k=cohort.MAX_COHORTS):
    rows = cohort.month_cohort(base(spark, folder), "signup_date")
    return cohort.cohort_churn(rows, "cohort", "tenure_days", "churned", k)


def _cells(spark, folder, k=cohort.MAX_COHORTS):
    """The cells as a stage table, computed once for all reports on them."""
    return shared(spark, folder, f"cells-{k}", lambda: stage(_churn(spark, folder, k), "cells"))


@query("month_cohort", f"WITH {BASE} SELECT customer_id, strftime(signup_date, '%Y-%m') AS cohort FROM base")
def month_cohort(spark, folder):
    return cohort.month_cohort(base(spark, folder), "signup_date").select("customer_id", "cohort")


_TEXT_MONTH = "CASE WHEN customer_id % 19 <> 0 THEN strftime(signup_date, '%Y-%m') END"


def _text_dates(spark, folder):
    """Customers whose sign-up dates are texts, one in 19 unreadable."""
    day = F.col("signup_date").cast("string")
    return base(spark, folder).withColumn("signup_date", F.when(F.col("customer_id") % 19 == 0, F.concat(day, F.lit("x"))).otherwise(day))


@query("month_cohort_text", f"WITH {BASE} SELECT customer_id, {_TEXT_MONTH} AS cohort FROM base")
def month_cohort_text(spark, folder):
    return cohort.month_cohort(_text_dates(spark, folder), "signup_date").select("customer_id", "cohort")


@query("unreadable_dates", f"""WITH {BASE} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS missing,
  count(*) FILTER (WHERE customer_id % 19 = 0) AS unreadable FROM base""")
def unreadable_dates(spark, folder):
    return cohort.date_check(_text_dates(spark, folder), "signup_date")


# columns of date texts by pattern: what Spark writes them with, and the pattern that has to win
_WRITTEN = {"month_first": "MM/dd/yyyy", "day_first": "dd/MM/yyyy HH:mm", "dotted": "d.M.yyyy", "named": "dd MMM yyyy"}
_WON = {"month_first": "M/d/yyyy", "day_first": "d/M/yyyy", "dotted": "d.M.yyyy", "named": "d MMM yyyy"}
_BAD_DATE = {"month_first": 7, "day_first": 11, "dotted": 13, "named": 17}


def _written_dates(spark, folder):
    rows = base(spark, folder)
    texts = [F.when(F.col("customer_id") % _BAD_DATE[c] == 0, "unknown").otherwise(F.date_format("signup_date", p)).alias(c)
             for c, p in _WRITTEN.items()]
    return rows.select("customer_id", *texts)


@query("month_cohort_formats", f"WITH {BASE} SELECT customer_id, " + ", ".join(
    f"CASE WHEN customer_id % {n} <> 0 THEN strftime(signup_date, '%Y-%m') END AS {c}" for c, n in _BAD_DATE.items()) + " FROM base")
def month_cohort_formats(spark, folder):
    """Months of date texts in four formats, each found by the vote of its column."""
    rows = _written_dates(spark, folder)
    for c in _WRITTEN:
        rows = cohort.month_cohort(rows, c, c)
    return rows


@query("date_formats", f"WITH {BASE} " + " UNION ALL ".join(
    f"SELECT '{c}' AS date_column, '{_WON[c]}' AS pattern, count(*) AS n_rows, count(*) FILTER (WHERE customer_id % {n} = 0) AS unreadable FROM base"
    for c, n in _BAD_DATE.items()))
def date_formats(spark, folder):
    """The pattern that reads most of each column, and the texts it leaves."""
    rows, found = _written_dates(spark, folder), []
    for c in _WRITTEN:
        pattern = cohort.date_pattern(rows, c)
        found.append(cohort.date_check(rows, c, pattern).select(F.lit(c).alias("date_column"), F.lit(pattern).alias("pattern"), "n_rows", "unreadable"))
    return functools.reduce(DataFrame.unionByName, found)


@query("cohort_choice", f"""WITH {BASE} SELECT customer_id, region AS existing, {_TEXT_MONTH} AS by_date,
  CAST(order_count AS VARCHAR) AS custom FROM base""")
def cohort_choice(spark, folder):
    """The three ways to a cohort side by side."""
    rows = cohort.choose_cohort(_text_dates(spark, folder), existing="region", date="signup_date", out="existing")
    rows = cohort.choose_cohort(rows, date="signup_date", custom="order_count", out="by_date")
    rows = cohort.choose_cohort(rows, custom="order_count", out="custom")
    return rows.select("customer_id", "existing", "by_date", F.col("custom").cast("string").alias("custom"))


@query("binned_time_range", f"WITH {BINS} SELECT least(n, 11) AS n_values, mx AS max_value, w AS bin_width FROM span")
def binned_time_range(spark, folder):
    return cohort.time_range(base(spark, folder), "tenure_days")


@query("cohort_bins", f"""WITH {BINS} SELECT bin_lo, period, count(*) AS n, min(tenure_days) AS min_value,
  max(tenure_days) AS max_value FROM binned GROUP BY bin_lo, period""")
def cohort_bins(spark, folder):
    return cohort.bin_sizes(base(spark, folder), "tenure_days")


@query("top_cohorts", f"WITH {TOP} SELECT signup_month, n FROM top")
def top_cohorts(spark, folder):
    return cohort.top_cohorts(base(spark, folder), "signup_month")


@query("top_cohort_filter", f"""WITH {TOP} SELECT customer_id, signup_month, churned FROM base
WHERE signup_month IN (SELECT signup_month FROM top)""")
def top_cohort_filter(spark, folder):
    kept = cohort.keep_top_cohorts(base(spark, folder), "signup_month")
    return kept.select("customer_id", "signup_month", "churned")


@query("cohort_churn", f"WITH {TOP} SELECT cohort, bin_lo, period, n, churned, churn_rate FROM cells")
def cohort_churn(spark, folder):
    return _churn(spark, folder)


def _wide(pivoted):
    """Name the period columns by their place in time, so the columns are the same for every table size."""
    periods = pivoted.columns[1:]
    named = [F.col(f"`{p}`").alias(f"t{i + 1:02d}") for i, p in enumerate(periods)]
    blank = [F.lit(None).cast("double").alias(f"t{i + 1:02d}") for i in range(len(periods), MAX_PERIODS)]
    return pivoted.select("cohort", *named, *blank)


def _wide_sql(value: str) -> str:
    columns = ", ".join(f"max(CASE WHEN t = {i} THEN {value} END) AS t{i:02d}" for i in range(1, MAX_PERIODS + 1))
    return f"""WITH {TOP}, placed AS (SELECT *, dense_rank() OVER (ORDER BY bin_lo) AS t FROM cells)
SELECT cohort, {columns} FROM placed GROUP BY cohort"""


@query("cohort_churn_pivot", _wide_sql("churn_rate"))
def cohort_churn_pivot(spark, folder):
    return _wide(cohort.churn_pivot(_cells(spark, folder)))


@query("cohort_retention_pivot", _wide_sql("1 - churn_rate"))
def cohort_retention_pivot(spark, folder):
    return _wide(cohort.retention_pivot(_cells(spark, folder)))


@query("cohort_trend", f"""WITH {TOP},
grid AS (SELECT c.cohort, p.bin_lo, p.period FROM (SELECT DISTINCT cohort FROM cells) c,
         (SELECT DISTINCT bin_lo, period FROM cells) p)
SELECT g.cohort, g.bin_lo, g.period, c.churn_rate FROM grid g
LEFT JOIN cells c ON c.cohort = g.cohort AND c.bin_lo = g.bin_lo""")
def cohort_trend(spark, folder):
    return cohort.cohort_trend(_cells(spark, folder))


@query("avg_churn_by_cohort", f"WITH {TOP} SELECT cohort, round(avg_churn_rate, 9) AS avg_churn_rate FROM by_cohort")
def avg_churn_by_cohort(spark, folder):
    return rounded(cohort.avg_churn_by_cohort(_cells(spark, folder)), 9, "avg_churn_rate")


@query("avg_churn_by_time", f"WITH {TOP} SELECT bin_lo, period, round(avg_churn_rate, 9) AS avg_churn_rate FROM by_time")
def avg_churn_by_time(spark, folder):
    return rounded(cohort.avg_churn_by_time(_cells(spark, folder)), 9, "avg_churn_rate")


@query("cohort_extremes", f"""WITH {TOP},
c AS (SELECT cohort, round(avg_churn_rate, 12) AS r FROM by_cohort),
t AS (SELECT bin_lo, period, round(avg_churn_rate, 12) AS r FROM by_time)
SELECT (SELECT cohort FROM c ORDER BY r DESC, cohort LIMIT 1) AS highest_cohort,
  (SELECT round(max(r), 9) FROM c) AS highest_cohort_rate,
  (SELECT cohort FROM c ORDER BY r, cohort LIMIT 1) AS lowest_cohort,
  (SELECT round(min(r), 9) FROM c) AS lowest_cohort_rate,
  (SELECT period FROM t ORDER BY r DESC, bin_lo LIMIT 1) AS highest_period,
  (SELECT round(max(r), 9) FROM t) AS highest_period_rate""")
def cohort_extremes(spark, folder):
    found = cohort.cohort_extremes(_cells(spark, folder))
    return rounded(found, 9, "highest_cohort_rate", "lowest_cohort_rate", "highest_period_rate")


@query("critical_periods", f"""WITH {FEW} SELECT bin_lo, period, round(avg_churn_rate, 9) AS avg_churn_rate FROM by_time
ORDER BY round(avg_churn_rate, 12) DESC, bin_lo LIMIT 2""")
def critical_periods(spark, folder):
    few = _cells(spark, folder, cohort.PATTERN_COHORTS)
    return rounded(cohort.critical_periods(few), 9, "avg_churn_rate")


_HALVES = f"""{FEW}, halves AS (
  SELECT bin_lo, period, avg_churn_rate, CAST(row_number() OVER (ORDER BY bin_lo) AS INTEGER) AS position,
         count(*) OVER () AS n_periods,
         CASE WHEN row_number() OVER (ORDER BY bin_lo) <= (count(*) OVER ()) // 2 THEN 'early' ELSE 'late' END AS half
  FROM by_time)"""


@query("period_half", f"""WITH {_HALVES} SELECT bin_lo, period, round(avg_churn_rate, 9) AS avg_churn_rate, position,
  n_periods, half FROM halves""")
def period_half(spark, folder):
    return rounded(cohort.period_half(_cells(spark, folder, cohort.PATTERN_COHORTS)), 9, "avg_churn_rate")


@query("early_late_pattern", f"""WITH {_HALVES}, r AS (
  SELECT avg(avg_churn_rate) FILTER (WHERE half = 'early') AS e, avg(avg_churn_rate) FILTER (WHERE half = 'late') AS l
  FROM halves)
SELECT round(e, 9) AS early_rate, round(l, 9) AS late_rate,
  round(CASE WHEN least(e, l) <> 0 THEN greatest(e, l) / least(e, l) END, 9) AS ratio,
  CASE WHEN e > l * 1.2 THEN 'early' WHEN l > e * 1.2 THEN 'late' ELSE 'consistent' END AS pattern,
  CASE WHEN e > l THEN 'early' ELSE 'late' END AS heavier_half FROM r""")
def early_late_pattern(spark, folder):
    halves = cohort.period_half(_cells(spark, folder, cohort.PATTERN_COHORTS))
    return rounded(cohort.early_late_pattern(halves), 9, "early_rate", "late_rate", "ratio")
