"""Classifier metrics from a score table (label 0/1, score, optional model column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.ranking import running_total
from ebbtide.functions.shaping import fan_out, number_cells, present, unfold
from ebbtide.operators.quantiles import at_rank, bracketed_runs
from ebbtide.session import stage

# Decision threshold, class names and the share of customers to reach first.
THRESHOLD = 0.5
CHURNED, NOT_CHURNED = "Churned", "Not Churned"
RISK_SHARE = 0.1

METRICS = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]
REPORT_METRICS = ["precision", "recall", "f1_score", "support"]


def threshold_prediction(scores: DataFrame, score: str = "score", threshold: float = THRESHOLD) -> DataFrame:
    p = present(scores, score)
    named = F.when(p >= threshold, CHURNED).when(p.isNotNull(), NOT_CHURNED)
    return scores.withColumn("prediction", named)


def _ratio(a: Column, b: Column) -> Column:
    """0 where the metric is undefined."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * precision * recall, precision + recall), F.lit(0.0))


def _scored(scores: DataFrame, label: str, score: str) -> DataFrame:
    """Rows with a label and a score; NaN is no score."""
    return scores.where(F.col(label).isNotNull() & present(scores, score).isNotNull())


def outcome_counts(scores: DataFrame, label: str, score: str, by: str | None = None,
                   threshold: float = THRESHOLD) -> DataFrame:
    """tn, fp, fn and tp in one pass, one row per model."""
    positive, flagged = F.col(label) == 1, F.col(score) >= threshold
    kept = _scored(scores, label, score)
    return kept.groupBy(*([by] if by else [])).agg(
        F.count_if(~positive & ~flagged).alias("tn"),
        F.count_if(~positive & flagged).alias("fp"),
        F.count_if(positive & ~flagged).alias("fn"),
        F.count_if(positive & flagged).alias("tp"),
    )


def confusion_matrix(scores: DataFrame, label: str, score: str, by: str | None = None,
                     threshold: float = THRESHOLD) -> DataFrame:
    """(actual, predicted, n) with all four cells, empty ones as 0."""
    cells = [
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
        for c, a, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    ]
    return fan_out(outcome_counts(scores, label, score, by, threshold), [by] if by else [], cells)


def roc_auc(scores: DataFrame, label: str, score: str, by: str | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties counted one half; NULL when a class is missing.

    Equal scores are counted first; the running count of negatives is found over ranges of scores, so no task sees all
    of them and nothing is read twice.
    """
    group = [by] if by else []
    kept = _scored(scores, label, score)
    kept = kept.select(*group, F.col(label).cast("int").alias("_y"), F.col(score).cast("double").alias("_s"))
    distinct = stage(kept.groupBy(*group, "_s").agg(
        F.count_if(F.col("_y") == 1).cast("double").alias("pos"),
        F.count_if(F.col("_y") == 0).cast("double").alias("neg"),
    ), "scores")
    ranked = running_total(distinct, group, ["_s"], F.col("neg"), "below")
    won = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return ranked.groupBy(*group).agg(F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def classification_metrics(scores: DataFrame, label: str, score: str, by: str | None = None,
                           threshold: float = THRESHOLD) -> DataFrame:
    """accuracy, precision, recall, f1_score and roc_auc of the positive class, one row per model."""
    group = [by] if by else []
    counts = outcome_counts(scores, label, score, by, threshold)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rates = counts.select(
        *group,
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
    ).withColumn("f1_score", _f1(F.col("precision"), F.col("recall")))
    area = roc_auc(scores, label, score, by)
    if by:
        return rates.join(area, by, "left")
    return rates.select("*", area.scalar().alias("roc_auc"))


def classification_report(scores: DataFrame, label: str, score: str, by: str | None = None,
                          threshold: float = THRESHOLD) -> DataFrame:
    """(class, precision, recall, f1_score, support) for 0, 1, accuracy, macro and weighted averages.

    The accuracy row carries the accuracy in every column, as the transposed report shows it.
    """
    group = [by] if by else []
    counts = outcome_counts(scores, label, score, by, threshold)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    parts = counts.select(
        *group,
        _ratio(tn, tn + fn).alias("p0"), _ratio(tn, tn + fp).alias("r0"), (tn + fp).cast("double").alias("s0"),
        _ratio(tp, tp + fp).alias("p1"), _ratio(tp, tp + fn).alias("r1"), (tp + fn).cast("double").alias("s1"),
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
    )
    parts = parts.withColumn("f0", _f1(F.col("p0"), F.col("r0"))).withColumn("f1", _f1(F.col("p1"), F.col("r1")))
    total = F.col("s0") + F.col("s1")

    def row(name, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1_score"), support.alias("support"),
        )

    def macro(m):
        return (F.col(f"{m}0") + F.col(f"{m}1")) / 2

    def weighted(m):
        return F.try_divide(F.col(f"{m}0") * F.col("s0") + F.col(f"{m}1") * F.col("s1"), total)

    accuracy = F.col("accuracy")
    return fan_out(parts, group, [
        row("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        row("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        row("accuracy", accuracy, accuracy, accuracy, accuracy),
        row("macro avg", macro("p"), macro("r"), macro("f"), total),
        row("weighted avg", weighted("p"), weighted("r"), weighted("f"), total),
    ])


def report_long(report: DataFrame) -> DataFrame:
    """(class, metric, value)."""
    return report.unpivot("class", REPORT_METRICS, "metric", "value")


def report_transpose(long_report: DataFrame) -> DataFrame:
    """Back to one row per class and one column per metric."""
    return long_report.groupBy("class").pivot("metric", REPORT_METRICS).agg(F.first("value"))


def metrics_comparison(*tables: DataFrame) -> DataFrame:
    """Stack the metric rows of several models."""
    stacked = tables[0]
    for table in tables[1:]:
        stacked = stacked.unionByName(table)
    return stacked


def metrics_long(metrics: DataFrame, model: str = "model") -> DataFrame:
    return metrics.unpivot(model, METRICS, "metric", "value")


def high_risk_customers(scores: DataFrame, score: str, share: float = RISK_SHARE) -> DataFrame:
    """Rows at or above the score that cuts off the given share; the cut is exact and nothing is sorted."""
    long = unfold(scores, number_cells(scores, [score]))
    rank = F.greatest(F.lit(0), F.ceil(F.round((1.0 - share) * F.col("total"), 6)) - 1)
    cut = at_rank(bracketed_runs(long, [1.0 - share], key="slot"), rank).select("value").scalar()
    return scores.where(present(scores, score) >= cut)
