"""Named queries over a table folder, each with its SQL twin where one exists, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.operators.label import normalize_label
from ebbtide.plans import fixtures
from ebbtide.session import stage
from ebbtide.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SHARED: dict[tuple, object] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


SHARED_TABLES = ["customer", "nation", "region", "orders", "events"]


def version(spark: SparkSession, folder: str) -> tuple:
    """Paths, sizes and times of the files behind the shared results; only the listing is read."""
    paths = [f"{folder}/{t}.parquet" for t in SHARED_TABLES]
    files = spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")
    return tuple(sorted((r["path"], r["length"], str(r["modificationTime"])) for r in files.collect()))


def shared(spark: SparkSession, folder: str, name: str, build: Callable[[], object]):
    """Result of ``build``, made once per application and state of the table files."""
    slot = (spark.sparkContext.applicationId, version(spark, folder), name)
    if slot not in _SHARED:
        _SHARED[slot] = build()
    return _SHARED[slot]


def forget() -> None:
    """Build shared results anew from now on."""
    _SHARED.clear()


def base(spark: SparkSession, folder: str) -> DataFrame:
    """Stage table of customers with the label normalised once, at ingest."""
    return shared(
        spark, folder, "customers",
        lambda: stage(normalize_label(fixtures.with_gaps(tables.customer_table(spark, folder)), "churn"), "customers"),
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return base(spark, folder).select(*tables.CUSTOMER_COLUMNS)


def planted(spark: SparkSession, folder: str) -> DataFrame:
    return shared(spark, folder, "planted", lambda: stage(fixtures.planted_signal(base(spark, folder)), "planted"))


def segments(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.fixed_segments(base(spark, folder))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round doubles whose last digits depend on the order of summation."""
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


# --- SQL twins of the shared tables -----------------------------------------------------------------

BASE = """
pre AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2001-02-01'),
history AS (
  SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS signup_date, count(*) AS order_count,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS total_charges,
         count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent_orders
  FROM pre GROUP BY o_custkey),
priority AS (
  SELECT o_custkey, o_orderpriority,
         row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn
  FROM pre GROUP BY o_custkey, o_orderpriority),
later AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-02-01'),
errors AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id),
star AS (
  SELECT c.c_custkey AS customer_id, c.c_mktsegment AS segment_name, r.r_name AS region, h.signup_date,
         strftime(h.signup_date, '%Y-%m') AS signup_month,
         CAST(date_diff('day', h.signup_date, DATE '2001-02-01') AS INTEGER) AS tenure_days,
         h.order_count, h.total_charges,
         h.total_charges * 30.0 / date_diff('day', h.signup_date, DATE '2001-02-01') AS monthly_charges,
         h.urgent_orders,
         p.o_orderpriority AS contract_type, coalesce(e.n, 0) AS support_events, c.c_acctbal AS acct_balance,
         CASE WHEN l.o_custkey IS NULL THEN 'Yes' ELSE 'No' END AS churn
  FROM customer c
  JOIN history h ON h.o_custkey = c.c_custkey
  JOIN priority p ON p.o_custkey = c.c_custkey AND p.rn = 1
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey
  LEFT JOIN later l ON l.o_custkey = c.c_custkey
  LEFT JOIN errors e ON e.user_id = c.c_custkey),
base AS (
  SELECT * REPLACE (CASE WHEN customer_id % 23 <> 0 THEN contract_type END AS contract_type,
                    CASE WHEN customer_id % 17 <> 0 THEN acct_balance END AS acct_balance),
         acct_balance AS raw_balance, CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END AS churned
  FROM star)"""


def unit(salt: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5(CAST(customer_id AS VARCHAR) || '{salt}'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0)"


PLANTED = BASE + f""",
signal AS (
  SELECT customer_id, order_count, raw_balance AS acct_balance_raw,
         CASE WHEN segment_name = 'MACHINERY' THEN 1 ELSE 0 END AS is_machinery, segment_name, region,
         (9 - order_count) + (CASE WHEN segment_name = 'MACHINERY' THEN 1 ELSE 0 END)
           - (raw_balance / 5000.0 - 1.0) AS z
  FROM base),
planted AS (
  SELECT *, CASE WHEN {unit('-7')} < 1.0 / (1.0 + exp(-z)) THEN 1 ELSE 0 END AS churn,
         round(1.0 / (1.0 + exp(-(z + {unit('-9')} - 0.5))), 6) AS score,
         CASE WHEN {unit('-42')} < 0.25 THEN 'test' ELSE 'train' END AS split
  FROM signal)"""

SEGMENTS = BASE + """,
seg AS (
  SELECT *, CASE WHEN raw_balance < 3000 THEN 'Segment 1' WHEN raw_balance < 6000 THEN 'Segment 2'
                 ELSE 'Segment 3' END AS segment
  FROM base),
summary AS (
  SELECT segment, count(*) AS size, count(*) / (sum(count(*)) OVER ()) AS proportion, avg(churned) AS churn_rate
  FROM seg GROUP BY segment)"""

BINS = BASE + """,
span AS (
  SELECT count(DISTINCT tenure_days) AS n, CAST(max(tenure_days) AS BIGINT) AS mx,
         greatest(1, CAST(max(tenure_days) AS BIGINT) // 10) AS w
  FROM base),
lows AS (
  SELECT base.*, w, n AS n_values,
         CASE WHEN n <= 10 THEN CAST(tenure_days AS BIGINT)
              WHEN tenure_days >= 0 THEN greatest(CAST(ceil(tenure_days / w) AS BIGINT) - 1, 0) * w END AS bin_lo
  FROM base, span),
binned AS (
  SELECT *, CASE WHEN n_values <= 10 THEN CAST(bin_lo AS VARCHAR)
                 ELSE CAST(bin_lo AS VARCHAR) || '-' || CAST(bin_lo + w - 1 AS VARCHAR) END AS period
  FROM lows)"""


def cells(k: int) -> str:
    return BINS + f""",
top AS (SELECT signup_month, count(*) AS n FROM base GROUP BY signup_month ORDER BY count(*) DESC, signup_month LIMIT {k}),
cells AS (
  SELECT signup_month AS cohort, bin_lo, period, count(*) AS n, CAST(sum(churned) AS BIGINT) AS churned,
         CAST(sum(churned) AS DOUBLE) / count(*) AS churn_rate
  FROM binned WHERE signup_month IN (SELECT signup_month FROM top) AND bin_lo IS NOT NULL
  GROUP BY signup_month, bin_lo, period),
by_cohort AS (SELECT cohort, avg(churn_rate) AS avg_churn_rate FROM cells GROUP BY cohort),
by_time AS (SELECT bin_lo, period, avg(churn_rate) AS avg_churn_rate FROM cells GROUP BY bin_lo, period)"""
