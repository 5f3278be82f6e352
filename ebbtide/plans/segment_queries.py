"""Segment report and return queries on balance-band segments, and k-means segments."""

from __future__ import annotations

from ebbtide.operators import clustering, roi
from ebbtide.operators import segments as report
from ebbtide.plans.registry import SEGMENTS, BASE, base, query, rounded, segments, shared
from ebbtide.session import stage

FEATURES = ["tenure_days", "monthly_charges", "total_charges", "acct_balance"]
CLUSTER_FEATURES = ["tenure_days", "monthly_charges", "total_charges", "contract_type"]


def _summary(spark, folder):
    return report.segment_summary(segments(spark, folder), "segment", "churned")


@query("segment_distribution", f"WITH {SEGMENTS} SELECT segment, count(*) AS n FROM seg GROUP BY segment")
def segment_distribution(spark, folder):
    return report.segment_distribution(segments(spark, folder))


@query("churn_rate_by_group", f"""WITH {BASE} SELECT region, count(*) AS n, avg(churned) AS churn_rate
FROM base GROUP BY region""")
def churn_rate_by_group(spark, folder):
    return report.churn_rate_by_group(base(spark, folder), "region", "churned")


@query("segment_summary", f"WITH {SEGMENTS} SELECT segment, size, proportion, churn_rate FROM summary")
def segment_summary(spark, folder):
    return _summary(spark, folder)


@query("share_of_total", f"WITH {SEGMENTS} SELECT segment, size AS n, proportion FROM summary")
def share_of_total(spark, folder):
    return report.share_of_total(report.segment_distribution(segments(spark, folder)), "n")


@query("segment_bubble", f"WITH {SEGMENTS} SELECT segment, churn_rate, size FROM summary")
def segment_bubble(spark, folder):
    return report.segment_bubble(segments(spark, folder), "segment", "churned")


_MEANS = ", ".join(f"round(avg({f}), 4) AS {f}" for f in FEATURES)


@query("segment_profile", f"""WITH {SEGMENTS},
ranked AS (SELECT segment, contract_type, row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, contract_type) AS rn
           FROM seg WHERE contract_type IS NOT NULL GROUP BY segment, contract_type)
SELECT seg.segment, {_MEANS}, max(r.contract_type) AS contract_type
FROM seg JOIN ranked r ON r.segment = seg.segment AND r.rn = 1 GROUP BY seg.segment""")
def segment_profile(spark, folder):
    found = report.segment_profile(segments(spark, folder), "segment", [*FEATURES, "contract_type"])
    return rounded(found, 4, *FEATURES)


@query("segment_filter", f"""WITH {SEGMENTS} SELECT segment, round(avg(order_count), 6) AS order_count,
  round(avg(support_events), 6) AS support_events FROM seg GROUP BY segment""")
def segment_filter(spark, folder):
    """Feature means of every segment: one grouping instead of one filter per segment."""
    wanted = ["order_count", "support_events"]
    return rounded(report.segment_profile(segments(spark, folder), "segment", wanted), 6, *wanted)


@query("segment_profile_long", f"WITH {SEGMENTS} " + " UNION ALL ".join(
    f"SELECT segment, '{f}' AS feature, round(avg({f}), 4) AS value FROM seg GROUP BY segment" for f in FEATURES))
def segment_profile_long(spark, folder):
    return rounded(report.segment_profile_long(segments(spark, folder), "segment", FEATURES), 4, "value")


@query("segment_centroids", f"""WITH {SEGMENTS} SELECT segment,
  round(avg(tenure_days) - 0.5, 4) AS x_min, round(avg(acct_balance) - 0.5, 4) AS y_min,
  round(avg(tenure_days) + 0.5, 4) AS x_max, round(avg(acct_balance) + 0.5, 4) AS y_max FROM seg GROUP BY segment""")
def segment_centroids(spark, folder):
    found = report.segment_centroids(segments(spark, folder), "segment", "tenure_days", "acct_balance")
    return rounded(found, 4, "x_min", "y_min", "x_max", "y_max")


@query("segment_risk_tier", f"""WITH {SEGMENTS} SELECT segment, size, proportion, churn_rate,
  CASE WHEN churn_rate > 0.30 THEN 'high' WHEN churn_rate > 0.15 THEN 'medium' ELSE 'low' END AS tier FROM summary""")
def segment_risk_tier(spark, folder):
    return report.segment_risk_tier(_summary(spark, folder))


@query("segment_priority", f"""WITH {SEGMENTS}, r AS (
  SELECT *, CAST(row_number() OVER (ORDER BY churn_rate DESC, segment) AS INTEGER) AS top_rank,
         CAST(row_number() OVER (ORDER BY churn_rate, segment DESC) AS INTEGER) AS low_rank FROM summary)
SELECT segment, size, proportion, churn_rate, 'high_risk' AS list, top_rank AS position,
  CASE WHEN churn_rate > 0.40 THEN 'critical' WHEN churn_rate > 0.25 THEN 'high' ELSE 'moderate' END AS priority
FROM r WHERE top_rank <= 2
UNION ALL
SELECT segment, size, proportion, churn_rate, 'low_risk', low_rank, 'expansion' FROM r WHERE low_rank <= 2""")
def segment_priority(spark, folder):
    return report.segment_priority(_summary(spark, folder))


_SCENARIOS = ", ".join(
    f"('{s.name}', CAST({s.churn_reduction_pct} AS DOUBLE), CAST({s.customer_value} AS DOUBLE), CAST({s.program_cost} AS DOUBLE))"
    for s in roi.SCENARIOS
)


@query("roi_scenarios", f"""WITH {SEGMENTS},
s AS (SELECT * FROM (VALUES {_SCENARIOS}) AS v(scenario, churn_reduction_pct, customer_value, program_cost)),
t AS (SELECT segment, size, churn_rate, s.*,
        size * (churn_rate - churn_rate * (1 - churn_reduction_pct / 100)) AS saved FROM summary, s)
SELECT segment, size, churn_rate, scenario, churn_reduction_pct, customer_value, program_cost,
  round(saved, 6) AS customers_saved, round(saved * customer_value, 4) AS revenue_protected,
  round(saved * customer_value - program_cost, 4) AS net_benefit,
  CASE WHEN program_cost > 0 THEN round((saved * customer_value - program_cost) / program_cost * 100, 6) END AS roi_pct,
  program_cost <= 0 AS free FROM t""")
def roi_scenarios(spark, folder):
    found = roi.roi_scenarios(_summary(spark, folder))
    found = rounded(found, 6, "customers_saved", "roi_pct")
    return rounded(found, 4, "revenue_protected", "net_benefit")


def clustered(spark, folder):
    return shared(
        spark, folder, "clusters",
        lambda: stage(clustering.kmeans_segments(base(spark, folder), "customer_id", CLUSTER_FEATURES), "clusters"),
    )


@query("kmeans_segments")
def kmeans_segments(spark, folder):
    return clustered(spark, folder).select("customer_id", *CLUSTER_FEATURES, "segment")


@query("kmeans_summary")
def kmeans_summary(spark, folder):
    return report.segment_risk_tier(report.segment_summary(clustered(spark, folder), "segment", "churned"))
