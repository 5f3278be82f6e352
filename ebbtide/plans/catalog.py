"""All registered queries and their SQL twins."""

from __future__ import annotations

from ebbtide.plans import (  # noqa: F401
    advice_queries, boosting_queries, check_queries, cohort_queries, flow_queries, model_queries, segment_queries, table_queries,
)
from ebbtide.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
