"""Cohort by lifetime churn: month cohorts, time bins, churn and retention cells, and what they show.

The cells of :func:`cohort_churn` are few (cohorts by periods). Reports that follow read them several
times, so put them in a stage table first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# Gates and bands of the cohort report.
MAX_PERIOD_VALUES = 10
MAX_COHORTS = 10
PATTERN_COHORTS = 5
CRITICAL_PERIODS = 2
PATTERN_BAND = 1.2


# Patterns of date texts, tried after ISO; among equals the first wins, so months come before days.
DATE_PATTERNS = (
    "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy", "M/d/yy", "d/M/yy", "d.M.yy", "yyyyMMdd",
    "d MMM yyyy", "d-MMM-yyyy", "MMM d, yyyy", "d MMMM yyyy", "MMMM d, yyyy",
)
CLOCK = "[ H:m[:s]]"


def _read_date(text: Column, pattern: str | None) -> Column:
    """Timestamp of a date text, NULL where it does not fit. No pattern: ISO."""
    return F.try_to_timestamp(text) if pattern is None else F.try_to_timestamp(F.trim(text), F.lit(pattern + CLOCK))


def date_votes(df: DataFrame, date_column: str) -> DataFrame:
    """(place, pattern, n): texts that each pattern reads, in one pass; no pattern is ISO.

    A value over 12 is a day only, so a column that holds some is read by one of two patterns that differ in the order of
    day and month, and by the other only in part.
    """
    patterns = [None, *DATE_PATTERNS]
    text = F.col(date_column).cast("string")
    counted = df.agg(*[F.count(_read_date(text, p)).alias(f"n{i}") for i, p in enumerate(patterns)])
    rows = [F.struct(F.lit(i).alias("place"), F.lit(p).cast("string").alias("pattern"), F.col(f"n{i}").alias("n")) for i, p in enumerate(patterns)]
    return counted.select(F.inline(F.array(*rows)))


def date_pattern(df: DataFrame, date_column: str) -> str | None:
    """The pattern that reads most texts of the column; a text column is read once for it."""
    return date_votes(df, date_column).orderBy(F.desc("n"), "place").first()["pattern"]


def month_cohort(df: DataFrame, date_column: str, out: str = "cohort", pattern: str | None = None) -> DataFrame:
    """Month of the date as text; a missing or unreadable date gives NULL. Texts are read by ``pattern``, by default the
    one that reads most of them."""
    day = F.col(date_column)
    if isinstance(df.schema[date_column].dataType, T.StringType):
        day = _read_date(day, pattern or date_pattern(df, date_column))
    return df.withColumn(out, F.date_format(day.cast("date"), "yyyy-MM"))


def date_check(df: DataFrame, date_column: str, pattern: str | None = None) -> DataFrame:
    """One row: rows, missing dates, and texts that are no date, or none by the pattern that reads most."""
    found = month_cohort(df, date_column, "_month", pattern)
    return found.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(date_column).isNull()).alias("missing"),
        F.count_if(F.col(date_column).isNotNull() & F.col("_month").isNull()).alias("unreadable"),
    )


def choose_cohort(df: DataFrame, existing: str | None = None, date: str | None = None, custom: str | None = None,
                  out: str = "cohort") -> DataFrame:
    """Cohort from an existing column, else the month of a date column, else any column."""
    if existing:
        return df.withColumn(out, F.col(existing))
    if date:
        return month_cohort(df, date, out)
    if custom:
        return df.withColumn(out, F.col(custom))
    raise ValueError("a cohort needs an existing, date or custom column")


def time_range(df: DataFrame, time_column: str) -> DataFrame:
    """One row: distinct time values (counted up to one past the gate), largest value and bin width."""
    if not isinstance(df.schema[time_column].dataType, T.NumericType):
        raise TypeError(f"time column '{time_column}' must be numeric")
    values = df.select(F.col(time_column).alias("t")).where(F.col("t").isNotNull()).distinct()
    found = values.agg(
        F.least(F.count(F.lit(1)), F.lit(MAX_PERIOD_VALUES + 1)).alias("n_values"), F.floor(F.max("t")).alias("max_value")
    )
    width = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("max_value") / 10))
    return found.withColumn("bin_width", width)


def time_bins(df: DataFrame, time_column: str) -> DataFrame:
    """Add ``bin_lo`` and ``period``.

    Up to ten distinct values are kept as they are (``bin_lo`` is DOUBLE for a fractional column). Beyond that the axis is cut into right-closed
    intervals of one tenth of the largest value, the first one closed on both sides and each labelled
    ``lo-(lo+width-1)``. Values below zero and missing values get no bin.
    """
    span = time_range(df, time_column).select(F.struct("n_values", "bin_width").alias("span")).scalar()
    width = span["bin_width"]
    few = span["n_values"] <= MAX_PERIOD_VALUES
    time = F.col(time_column)
    exact = time.cast("double" if isinstance(df.schema[time_column].dataType, T.FractionalType) else "bigint")
    index = F.greatest(F.ceil(time / width) - 1, F.lit(0).cast("bigint"))
    lo = F.when(few, exact).when(time >= 0, index * width)
    binned = df.withColumn("bin_lo", lo)
    start = F.col("bin_lo").cast("bigint")
    label = F.when(few, F.col("bin_lo").cast("string")).otherwise(
        F.concat_ws("-", start.cast("string"), (start + width - 1).cast("string"))
    )
    return binned.withColumn("period", F.when(F.col("bin_lo").isNotNull(), label))


def bin_sizes(df: DataFrame, time_column: str) -> DataFrame:
    return (
        time_bins(df, time_column)
        .groupBy("bin_lo", "period")
        .agg(F.count(F.lit(1)).alias("n"), F.min(time_column).alias("min_value"), F.max(time_column).alias("max_value"))
    )


def top_cohorts(df: DataFrame, cohort: str, k: int = MAX_COHORTS) -> DataFrame:
    """The k largest cohorts, ties to the smaller name."""
    return (
        df.where(F.col(cohort).isNotNull())
        .groupBy(cohort)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(cohort))
        .limit(k)
    )


def keep_top_cohorts(df: DataFrame, cohort: str, k: int = MAX_COHORTS) -> DataFrame:
    """Rows of the k largest cohorts; with k cohorts or fewer every cohort stays. The kept list has k rows at most."""
    return df.join(F.broadcast(top_cohorts(df, cohort, k).select(cohort)), cohort, "left_semi")


def cohort_cells(df: DataFrame, cohort: str, label: str) -> DataFrame:
    """Churn per (cohort, period): the canonical long form. Rows need a cohort, a bin and a label."""
    kept = df.where(F.col(cohort).isNotNull() & F.col("bin_lo").isNotNull() & F.col(label).isNotNull())
    return (
        kept.groupBy(F.col(cohort).alias("cohort"), "bin_lo", "period")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("churned"))
        .withColumn("churn_rate", F.col("churned") / F.col("n"))
    )


def cohort_churn(df: DataFrame, cohort: str, time_column: str, label: str, k: int = MAX_COHORTS) -> DataFrame:
    """Bin the time axis over all rows, keep the k largest cohorts, and compute their cells."""
    return cohort_cells(keep_top_cohorts(time_bins(df, time_column), cohort, k), cohort, label)


def pattern_cells(df: DataFrame, cohort: str, time_column: str, label: str) -> DataFrame:
    """Cells of the five largest cohorts, as used for critical periods and the early/late pattern."""
    return cohort_churn(df, cohort, time_column, label, PATTERN_COHORTS)


def period_labels(cells: DataFrame) -> list[str]:
    """Period labels in time order: at most one per bin."""
    return [r.period for r in cells.select("bin_lo", "period").distinct().orderBy("bin_lo").collect()]


def churn_pivot(cells: DataFrame, value: Column | None = None) -> DataFrame:
    """Cohort rows by period columns in time order; an empty cell is NULL."""
    rate = F.col("churn_rate") if value is None else value
    return cells.groupBy("cohort").pivot("period", period_labels(cells)).agg(F.first(rate))


def retention_pivot(cells: DataFrame) -> DataFrame:
    return churn_pivot(cells, 1 - F.col("churn_rate"))


def cohort_trend(cells: DataFrame) -> DataFrame:
    """Every (cohort, period) pair in long form, empty cells kept as NULL.

    The period list (twenty entries at most) is unfolded against each cohort, so no two tables are multiplied.
    """
    periods = cells.agg(F.collect_set(F.struct("bin_lo", "period")).alias("p")).scalar()
    grid = cells.select("cohort").distinct().select("cohort", F.inline(periods))
    return grid.join(cells.select("cohort", "bin_lo", "churn_rate"), ["cohort", "bin_lo"], "left")


def avg_churn_by_cohort(cells: DataFrame) -> DataFrame:
    """Unweighted mean over a cohort's non-empty cells."""
    return cells.groupBy("cohort").agg(F.avg("churn_rate").alias("avg_churn_rate"))


def avg_churn_by_time(cells: DataFrame) -> DataFrame:
    return cells.groupBy("bin_lo", "period").agg(F.avg("churn_rate").alias("avg_churn_rate"))


def cohort_extremes(cells: DataFrame) -> DataFrame:
    """One row: cohorts with the highest and lowest average, period with the highest."""
    rate = F.round("avg_churn_rate", 12)  # so equal averages tie whatever order they were summed in
    cohorts = avg_churn_by_cohort(cells).agg(
        F.min(F.struct((-rate).alias("r"), F.col("cohort").alias("name"))).alias("high"),
        F.min(F.struct(rate.alias("r"), F.col("cohort").alias("name"))).alias("low"),
    )
    period = avg_churn_by_time(cells).agg(
        F.min(F.struct((-rate).alias("r"), F.col("bin_lo"), F.col("period").alias("name")))
    ).scalar()
    return cohorts.select(
        F.col("high.name").alias("highest_cohort"),
        (-F.col("high.r")).alias("highest_cohort_rate"),
        F.col("low.name").alias("lowest_cohort"),
        F.col("low.r").alias("lowest_cohort_rate"),
        period["name"].alias("highest_period"),
        (-period["r"]).alias("highest_period_rate"),
    )


def critical_periods(cells: DataFrame, k: int = CRITICAL_PERIODS) -> DataFrame:
    by_time = avg_churn_by_time(cells)
    return by_time.orderBy(F.desc(F.round("avg_churn_rate", 12)), "bin_lo").limit(k)


def period_half(cells: DataFrame) -> DataFrame:
    """Average churn per period with its half of the time axis; the middle one counts as late."""
    in_time = W.orderBy("bin_lo")  # one row per period here
    whole = W.partitionBy()
    ranked = avg_churn_by_time(cells).select(
        "*", F.row_number().over(in_time).alias("position"), F.count(F.lit(1)).over(whole).alias("n_periods")
    )
    early = F.col("position") <= F.floor(F.col("n_periods") / 2)
    return ranked.withColumn("half", F.when(early, "early").otherwise("late"))


def early_late_pattern(halves: DataFrame, band: float = PATTERN_BAND) -> DataFrame:
    """One row: mean churn of each half, the larger over the smaller, and the pattern with its band.

    ``halves`` is a (half, avg_churn_rate) table such as :func:`period_half` returns.
    """
    early, late = F.col("early_rate"), F.col("late_rate")
    return halves.agg(
        F.avg(F.when(F.col("half") == "early", F.col("avg_churn_rate"))).alias("early_rate"),
        F.avg(F.when(F.col("half") == "late", F.col("avg_churn_rate"))).alias("late_rate"),
    ).select(
        "early_rate",
        "late_rate",
        F.try_divide(F.greatest(early, late), F.least(early, late)).alias("ratio"),
        F.when(early > late * band, "early").when(late > early * band, "late").otherwise("consistent").alias("pattern"),
        F.when(early > late, "early").otherwise("late").alias("heavier_half"),
    )
