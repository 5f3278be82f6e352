"""Sources, label and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.operators import label, prep, profile
from ebbtide.plans.registry import BASE, base, customers, planted, query, rounded, PLANTED
from ebbtide.session import stage_path
from ebbtide.sources import csv, tables

COLUMNS = tables.CUSTOMER_COLUMNS
NUMERIC = [
    "customer_id", "tenure_days", "order_count", "total_charges", "monthly_charges", "urgent_orders",
    "support_events", "acct_balance",
]
MEASURES = NUMERIC[1:]
TEXTS = ["segment_name", "region", "signup_month", "contract_type", "churn"]
LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
LINE_COLUMNS = LINE_NUMBERS + ["l_returnflag", "l_linestatus", "l_shipdate"]


# --- SQL builders -----------------------------------------------------------------------------------


def _each(columns, row) -> str:
    return "\nUNION ALL\n".join(row(c) for c in columns)


def _profile_sql(table: str, columns) -> str:
    return _each(columns, lambda c: f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
  100.0 * (count(*) - count({c})) / count(*) AS missing_pct, count(DISTINCT {c}) AS distinct_values FROM {table}""")


def _describe_sql(table: str, columns) -> str:
    return _each(columns, lambda c: f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM {table}""")


def _correlation_sql(table: str, columns) -> str:
    pairs = [(a, b) for a in columns for b in columns]
    return _each(pairs, lambda p: f"""SELECT '{p[0]}' AS column_x, '{p[1]}' AS column_y,
  round(corr(CAST({p[0]} AS DOUBLE), CAST({p[1]} AS DOUBLE)), 6) + 0.0 AS correlation FROM {table}""")


def _top_sql(table: str, columns, k: int) -> str:
    counted = _each(columns, lambda c: f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n
  FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}""")
    return f"""SELECT "column", value, n, CAST(position AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS position FROM ({counted}))
WHERE position <= {k}"""


# --- sources ----------------------------------------------------------------------------------------


@query("customer_star_join", f"WITH {BASE} SELECT {', '.join(COLUMNS)} FROM star")
def customer_star_join(spark, folder):
    return tables.customer_table(spark, folder)


@query("parquet_source", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def parquet_source(spark, folder):
    return tables.read_table(spark, folder, "customer", ["c_custkey", "c_acctbal", "c_mktsegment"])


@query("parquet_sink", f"WITH {PLANTED} SELECT customer_id, order_count, churn, score, split FROM planted")
def parquet_sink(spark, folder):
    path = stage_path(spark, "sink")
    rows = planted(spark, folder).select("customer_id", "order_count", "churn", "score", "split")
    tables.write_parquet(rows, path, partition_by=["split", "churn"])
    return tables.read_parquet(spark, path, rows.columns)


_CSV_ROWS = """customer_id, segment_name, region,
  CAST(signup_date AS VARCHAR) AS signup_date, signup_month, CAST(tenure_days AS BIGINT) AS tenure_days, order_count,
  total_charges, monthly_charges, urgent_orders, contract_type, support_events, acct_balance, churn"""


@query("csv_ingest", f"WITH {BASE} SELECT {_CSV_ROWS} FROM base")
def csv_ingest(spark, folder):
    path = stage_path(spark, "csv")
    csv.write_csv(customers(spark, folder), path)
    return csv.read_csv(spark, path)


def dirty_files(spark, folder) -> str:
    """Customer files as they arrive: two column orders, gaps spelt out, unreadable dates, short and long lines."""
    path = stage_path(spark, "dirty")
    rows = customers(spark, folder)
    key = F.col("customer_id")
    rows = rows.withColumns({
        "signup_date": F.when(key % 19 == 0, F.concat(F.col("signup_date").cast("string"), F.lit("x"))).otherwise(
            F.col("signup_date").cast("string")),
        "acct_balance": F.coalesce(F.col("acct_balance").cast("string"), F.lit("NA")),
        "contract_type": F.coalesce("contract_type", F.lit("")),
    })
    csv.write_csv(rows.where(key % 2 == 0), f"{path}/even")
    csv.write_csv(rows.where(key % 2 == 1).select(*reversed(rows.columns)), f"{path}/odd")
    broken = rows.where(key % 29 == 0).select(F.concat_ws(",", key.cast("string"), F.lit("short")).alias("line"))
    broken = broken.unionByName(rows.where(key % 31 == 0).select(F.repeat(F.lit("9,"), 20).alias("line")))
    broken = broken.unionByName(spark.createDataFrame([(",".join(rows.columns),)], "line string"))
    broken.coalesce(1).sortWithinPartitions(F.desc("line")).write.text(f"{path}/broken")  # letters sort behind digits
    return path


@query("csv_quoted_breaks", """SELECT c_custkey, c_name || chr(10) || '"' || c_mktsegment || '",' || chr(10) || chr(10) || c_acctbal AS note,
  c_acctbal FROM customer""")
def csv_quoted_breaks(spark, folder):
    """Line breaks, quotes and commas inside cells; the files are split among tasks like any other."""
    rows = tables.read_table(spark, folder, "customer", ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])
    note = F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('",\n\n'), F.col("c_acctbal").cast("string"))
    path = stage_path(spark, "csv")
    csv.write_csv(rows.select("c_custkey", note.alias("note"), "c_acctbal"), path)
    return csv.read_csv(spark, path, multi_line=True)


@query("csv_rows", f"""WITH {BASE}, t AS (SELECT * REPLACE (
  CASE WHEN customer_id % 19 = 0 THEN CAST(signup_date AS VARCHAR) || 'x' ELSE CAST(signup_date AS VARCHAR) END AS signup_date) FROM base)
SELECT {_CSV_ROWS} FROM t""")
def csv_rows(spark, folder):
    return csv.ingest_csv(spark, dirty_files(spark, folder))[0]


@query("csv_checks", f"""WITH {BASE}, n AS (
  SELECT count(*) FILTER (WHERE customer_id % 29 = 0) + count(*) FILTER (WHERE customer_id % 31 = 0) AS bad FROM base)
SELECT 'min_rows' AS "check", true AS passed, 'at least 10 rows' AS detail
UNION ALL SELECT 'target_column', true, 'churn'
UNION ALL SELECT 'well_formed', bad = 0, bad || ' malformed lines' FROM n
UNION ALL SELECT 'label_values', true, '2 distinct values'""")
def csv_checks(spark, folder):
    return csv.ingest_csv(spark, dirty_files(spark, folder))[1]


@query("csv_bad_lines", f"""WITH {BASE} SELECT customer_id || ',short' AS line FROM base WHERE customer_id % 29 = 0
UNION ALL SELECT repeat('9,', 20) FROM base WHERE customer_id % 31 = 0""")
def csv_bad_lines(spark, folder):
    return csv.bad_lines(spark, dirty_files(spark, folder)).select("line")


@query("validate_table", f"""WITH {BASE}, counted AS (SELECT least(count(*), 10) AS n FROM base)
SELECT 'min_rows' AS "check", n >= 10 AS passed,
       CASE WHEN n >= 10 THEN 'at least 10 rows' ELSE n || ' rows, 10 needed' END AS detail FROM counted
UNION ALL SELECT 'target_column', true, 'churn' FROM counted
UNION ALL SELECT 'numeric_time', true, 'tenure_days int' FROM counted""")
def validate_table(spark, folder):
    return profile.validate_table(customers(spark, folder), time_column="tenure_days")


# --- label ------------------------------------------------------------------------------------------


@query("feature_projection", f"WITH {BASE} SELECT customer_id, {', '.join(MEASURES)}, region, churned FROM base")
def feature_projection(spark, folder):
    return prep.feature_projection(base(spark, folder), "customer_id", [*MEASURES, "region"], "churned")


@query("label_normalize", f"WITH {BASE} SELECT customer_id, churn, CAST(churned AS INTEGER) AS label FROM base")
def label_normalize(spark, folder):
    return label.normalize_label(customers(spark, folder).select("customer_id", "churn"), "churn", "label")


@query("label_check", f"""WITH {BASE}, v AS (SELECT least(count(DISTINCT lower(churn)), 3) AS n FROM base)
SELECT 'label_values' AS "check", n <= 2 AS passed,
       CASE WHEN n <= 2 THEN n || ' distinct values' ELSE 'more than two distinct values' END AS detail FROM v""")
def label_check(spark, folder):
    return label.label_check(customers(spark, folder), "churn")


@query("label_domain", f"""WITH {BASE}, v AS (SELECT DISTINCT lower(churn) AS v FROM base)
SELECT 'no/yes' AS domain, count(*) FILTER (WHERE v NOT IN ('no', 'yes')) AS n_outside,
       count(*) FILTER (WHERE v NOT IN ('no', 'yes')) = 0 AS passed FROM v
UNION ALL SELECT 'false/true', count(*) FILTER (WHERE v NOT IN ('false', 'true')),
       count(*) FILTER (WHERE v NOT IN ('false', 'true')) = 0 FROM v
UNION ALL SELECT '0/1', count(*) FILTER (WHERE v NOT IN ('0', '1')),
       count(*) FILTER (WHERE v NOT IN ('0', '1')) = 0 FROM v""")
def label_domain(spark, folder):
    return label.label_domain(customers(spark, folder), "churn")


@query("target_distribution", f"WITH {BASE} SELECT churn AS class, count(*) AS n FROM base GROUP BY churn")
def target_distribution(spark, folder):
    return label.target_distribution(customers(spark, folder), "churn")


@query("churn_overview", f"""WITH {BASE} SELECT count(*) AS customers, CAST(sum(churned) AS BIGINT) AS churned,
  100.0 * avg(churned) AS churn_rate_pct, CAST(0 AS BIGINT) AS unlabelled FROM base""")
def churn_overview(spark, folder):
    return profile.churn_overview(base(spark, folder), "churned")


# --- profile ----------------------------------------------------------------------------------------

# name, type, role, and whether the name suits a cohort axis, a time axis, a segment
_SHAPE = (
    ("customer_id", "bigint", "numeric", 0, 0, 0), ("segment_name", "string", "categorical", 0, 0, 0),
    ("region", "string", "categorical", 0, 0, 0), ("signup_date", "date", "date", 1, 0, 0),
    ("signup_month", "string", "categorical", 1, 1, 0), ("tenure_days", "int", "numeric", 0, 1, 1),
    ("order_count", "bigint", "numeric", 0, 0, 0), ("total_charges", "double", "numeric", 0, 0, 1),
    ("monthly_charges", "double", "numeric", 1, 1, 1), ("urgent_orders", "bigint", "numeric", 0, 0, 0),
    ("contract_type", "string", "categorical", 0, 0, 0), ("support_events", "bigint", "numeric", 0, 0, 0),
    ("acct_balance", "double", "numeric", 0, 0, 0), ("churn", "string", "target", 0, 0, 0),
)
_SHAPE_SQL = ", ".join(
    f"({i}, '{c}', '{t}', '{r}', {bool(a)}, {bool(b)}, {bool(s)})" for i, (c, t, r, a, b, s) in enumerate(_SHAPE)
)


@query("table_shape", f"""WITH {BASE}, counted AS (SELECT count(*) AS n_rows FROM base)
SELECT n_rows, {len(_SHAPE)} AS n_columns, s.* FROM counted, (VALUES {_SHAPE_SQL})
  AS s(ordinal, "column", type, role, cohort_like, time_like, segmentation_default)""")
def table_shape(spark, folder):
    return profile.table_shape(customers(spark, folder))


@query("column_profile", f"WITH {BASE} {_profile_sql('base', COLUMNS)}")
def column_profile(spark, folder):
    return profile.column_profile(customers(spark, folder))


@query("column_profile_lineitem", _profile_sql("lineitem", LINE_COLUMNS))
def column_profile_lineitem(spark, folder):
    return profile.column_profile(tables.read_table(spark, folder, "lineitem"))


@query("missing_columns", f"""WITH {BASE} SELECT "column", missing, missing_pct
FROM ({_profile_sql('base', COLUMNS)}) WHERE missing > 0""")
def missing_columns(spark, folder):
    return profile.missing_columns(customers(spark, folder))


_NARROW = ["segment_name", "region", "contract_type", "order_count", "churn"]


@query("duplicate_rows", f"""WITH {BASE}, kinds AS (SELECT DISTINCT {', '.join(_NARROW)} FROM base)
SELECT (SELECT count(*) FROM base) AS n_rows, (SELECT count(*) FROM base) - (SELECT count(*) FROM kinds) AS duplicates,
  100.0 * ((SELECT count(*) FROM base) - (SELECT count(*) FROM kinds)) / (SELECT count(*) FROM base) AS duplicate_pct""")
def duplicate_rows(spark, folder):
    return profile.duplicate_rows(customers(spark, folder).select(*_NARROW))


@query("duplicate_rows_lineitem", """WITH kinds AS (SELECT DISTINCT * FROM lineitem)
SELECT (SELECT count(*) FROM lineitem) AS n_rows,
  (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM kinds) AS duplicates,
  100.0 * ((SELECT count(*) FROM lineitem) - (SELECT count(*) FROM kinds)) / (SELECT count(*) FROM lineitem) AS duplicate_pct""")
def duplicate_rows_lineitem(spark, folder):
    return profile.duplicate_rows(tables.read_table(spark, folder, "lineitem"))


@query("numeric_describe", f"WITH {BASE} {_describe_sql('base', NUMERIC)}")
def numeric_describe(spark, folder):
    described = profile.numeric_describe(customers(spark, folder), NUMERIC)
    return rounded(rounded(described, 4, "mean", "std"), 6, "q25", "q50", "q75")


@query("numeric_describe_lineitem", _describe_sql("lineitem", LINE_NUMBERS))
def numeric_describe_lineitem(spark, folder):
    described = profile.numeric_describe(tables.read_table(spark, folder, "lineitem", LINE_NUMBERS), LINE_NUMBERS)
    return rounded(rounded(described, 4, "mean", "std"), 6, "q25", "q50", "q75")


@query("top_values", f"WITH {BASE} {_top_sql('base', TEXTS, 5)}")
def top_values(spark, folder):
    return profile.top_values(customers(spark, folder), TEXTS)


_ORDER_TEXTS = ["o_orderstatus", "o_orderpriority"]


@query("top_values_orders", _top_sql("orders", _ORDER_TEXTS, 5))
def top_values_orders(spark, folder):
    return profile.top_values(tables.read_table(spark, folder, "orders", _ORDER_TEXTS), _ORDER_TEXTS)


_COUNTED = ["segment_name", "contract_type", "signup_month", "tenure_days"]


@query("distinct_counts", "WITH " + BASE + " " + _each(
    _COUNTED, lambda c: f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values FROM base"""))
def distinct_counts(spark, folder):
    return profile.distinct_counts(customers(spark, folder), _COUNTED)


@query("value_distribution", f"""WITH {BASE} SELECT contract_type AS value, count(*) AS n FROM base
WHERE contract_type IS NOT NULL GROUP BY contract_type""")
def value_distribution(spark, folder):
    return profile.value_distribution(customers(spark, folder), "contract_type")


@query("category_by_target", f"""WITH {BASE} SELECT contract_type AS category, churn AS class, count(*) AS n FROM base
WHERE contract_type IS NOT NULL GROUP BY contract_type, churn""")
def category_by_target(spark, folder):
    return profile.category_by_target(customers(spark, folder), "contract_type", "churn")


@query("histogram", f"""WITH {BASE},
ends AS (SELECT min(total_charges) AS lo, (max(total_charges) - min(total_charges)) / 30 AS w FROM base),
b AS (SELECT CAST(least(floor((total_charges - lo) / w), 29) AS INTEGER) AS bin, churn, lo, w FROM base, ends)
SELECT bin, round(lo + bin * w, 6) AS bin_lo, round(lo + (bin + 1) * w, 6) AS bin_hi, churn, count(*) AS n
FROM b GROUP BY bin, lo, w, churn""")
def histogram(spark, folder):
    return rounded(profile.histogram(customers(spark, folder), "total_charges", "churn"), 6, "bin_lo", "bin_hi")


def _box_sql(table: str, column: str, by: str) -> str:
    return f"""q AS (
  SELECT {by} AS "group", quantile_cont({column}, 0.25) AS q25, quantile_cont({column}, 0.5) AS q50,
         quantile_cont({column}, 0.75) AS q75 FROM {table} WHERE {column} IS NOT NULL GROUP BY {by}),
f AS (SELECT *, q25 - 1.5 * (q75 - q25) AS lf, q75 + 1.5 * (q75 - q25) AS hf FROM q)
SELECT f."group", round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, count(*) AS n,
  min({column}) FILTER (WHERE {column} BETWEEN lf AND hf) AS low_whisker,
  max({column}) FILTER (WHERE {column} BETWEEN lf AND hf) AS high_whisker,
  count(*) FILTER (WHERE NOT {column} BETWEEN lf AND hf) AS outliers
FROM {table} JOIN f ON f."group" = {by} WHERE {column} IS NOT NULL GROUP BY f."group", q25, q50, q75"""


@query("box_stats", f"WITH {BASE}, {_box_sql('base', 'acct_balance', 'churn')}")
def box_stats(spark, folder):
    return rounded(profile.box_stats(customers(spark, folder), "acct_balance", "churn"), 6, "q25", "q50", "q75")


@query("box_stats_lineitem", f"WITH {_box_sql('lineitem', 'l_extendedprice', 'l_returnflag')}")
def box_stats_lineitem(spark, folder):
    lines = tables.read_table(spark, folder, "lineitem", ["l_extendedprice", "l_returnflag"])
    return rounded(profile.box_stats(lines, "l_extendedprice", "l_returnflag"), 6, "q25", "q50", "q75")


@query("correlation_matrix", f"WITH {BASE} {_correlation_sql('base', MEASURES)}")
def correlation_matrix(spark, folder):
    return rounded(profile.correlation_matrix(customers(spark, folder), MEASURES), 6, "correlation")


@query("correlation_matrix_lineitem", _correlation_sql("lineitem", LINE_NUMBERS))
def correlation_matrix_lineitem(spark, folder):
    lines = tables.read_table(spark, folder, "lineitem", LINE_NUMBERS)
    return rounded(profile.correlation_matrix(lines, LINE_NUMBERS), 6, "correlation")


_GAPPED = [f"{c}_{i}" for c in LINE_NUMBERS[3:] for i in (2, 3, 7)]
_GAPS = ", ".join(f"CASE WHEN l_orderkey % {c[-1]} <> 1 THEN CAST({c[:-2]} AS DOUBLE) END AS {c}" for c in _GAPPED)


@query("correlation_matrix_gapped", f"WITH gapped AS (SELECT {_GAPS} FROM lineitem) " + _correlation_sql("gapped", _GAPPED))
def correlation_matrix_gapped(spark, folder):
    """Fifteen columns, each with its own gaps."""
    rows = tables.read_table(spark, folder, "lineitem", LINE_NUMBERS)
    cells = [F.when(F.col("l_orderkey") % int(c[-1]) != 1, F.col(c[:-2])).alias(c) for c in _GAPPED]
    return rounded(profile.correlation_matrix(rows.select(*cells), _GAPPED), 6, "correlation")


@query("preview", f"WITH {BASE} SELECT {', '.join(COLUMNS)} FROM base ORDER BY customer_id LIMIT 10")
def preview(spark, folder):
    return profile.preview(customers(spark, folder), "customer_id")
