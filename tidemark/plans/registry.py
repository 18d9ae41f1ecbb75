"""Queries by the id of the operator they show, and the same in SQL where SQL can express it."""

from __future__ import annotations

from tidemark.plans import analytics_queries, forecast_queries, model_queries, more_queries, protocol_queries, runner_queries, shaping_queries  # noqa: F401
from tidemark.plans.core import QUERIES, SQL  # noqa: F401

FLAGSHIP = "J02_rolling_metrics"
