"""Date texts: the pattern that reads most of a column wins."""

import pytest
from pyspark.sql import functions as F

from ebbtide.operators import cohort


def dates(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string")


@pytest.mark.parametrize("texts, pattern, months", [
    (["2024-01-31", "2024-02-01 10:00:00", None], None, ["2024-01", "2024-02", None]),
    (["1/31/2024", "2/3/2024", "x"], "M/d/yyyy", ["2024-01", "2024-02", None]),
    (["31/01/2024", "03/02/2024", "02/03/2024"], "d/M/yyyy", ["2024-01", "2024-02", "2024-03"]),
    (["01/02/2024", "03/04/2024"], "M/d/yyyy", ["2024-01", "2024-03"]),  # nothing over 12: months first
    (["31/01/2024", "28/02/2024", "05/13/2024"], "d/M/yyyy", ["2024-01", "2024-02", None]),
    (["31.1.2024 23:59", " 1.2.2024 "], "d.M.yyyy", ["2024-01", "2024-02"]),
    (["1/31/24", "12/5/23"], "M/d/yy", ["2024-01", "2023-12"]),
    (["20240131", "20231205"], "yyyyMMdd", ["2024-01", "2023-12"]),
    (["31 Jan 2024", "5 Dec 2023"], "d MMM yyyy", ["2024-01", "2023-12"]),
    (["January 31, 2024", "December 5, 2023"], "MMMM d, yyyy", ["2024-01", "2023-12"]),
    (["", "no date", None], None, [None, None, None]),
])
def test_the_pattern_that_reads_most_wins(spark, texts, pattern, months):
    rows = dates(spark, *texts)
    assert cohort.date_pattern(rows, "d") == pattern
    assert [r["cohort"] for r in cohort.month_cohort(rows, "d").orderBy("i").collect()] == months
    check = cohort.date_check(rows, "d").first()
    assert check["unreadable"] == sum(m is None and t is not None for m, t in zip(months, texts))


def test_a_named_pattern_and_an_empty_column(spark):
    rows = dates(spark, "01/02/2024")
    assert cohort.month_cohort(rows, "d", pattern="d/M/yyyy").first()["cohort"] == "2024-02"
    assert cohort.date_pattern(rows.where("false"), "d") is None
    assert cohort.month_cohort(rows.select(F.current_date().alias("d")), "d").where("cohort is null").count() == 0
