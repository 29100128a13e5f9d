"""All queries of the library: importing a module of this folder registers its queries."""

from gaugeflow.plans import export_queries, fleet_queries, metric_queries, series_queries, slice_queries, store_queries, stream_queries
from gaugeflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "export_queries", "fleet_queries", "metric_queries", "series_queries", "slice_queries", "store_queries", "stream_queries"]
