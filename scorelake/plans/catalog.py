"""All registered queries and oracles."""

from __future__ import annotations

from scorelake.plans import binning_queries, fit_queries, metric_queries, model_queries, prep_queries, stream_queries  # noqa: F401
from scorelake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
