"""All registered queries of the library proper."""

from ..registry import QUERIES, SQL
from . import metric_queries, polygon_queries, raster_queries, sample_queries, spatial_queries, study_queries, table_queries

__all__ = ["QUERIES", "SQL", "metric_queries", "polygon_queries", "raster_queries", "sample_queries", "spatial_queries", "study_queries", "table_queries"]
