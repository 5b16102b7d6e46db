"""Loads every query module so that the registry is complete."""

from weatherlake.plans import backtest_queries, climate_queries, hazard_queries, model_queries, pit_queries, score_queries, series_queries, signal_queries, source_queries, spatial_queries, store_queries, stream_queries  # noqa: F401
from weatherlake.plans.registry import COVERS, QUERIES, SQL

__all__ = ["COVERS", "QUERIES", "SQL"]
