"""Imports every query module, which fills the registry."""

from workload import job_queries, scalar_queries, series_queries, source_queries, spatial_queries
from workload.registry import QUERIES

__all__ = ["FLAGSHIP", "job_queries", "scalar_queries", "series_queries", "source_queries", "spatial_queries"]

FLAGSHIP = QUERIES["tk02_driest_zones"]
