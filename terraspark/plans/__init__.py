"""Plans of whole queries over the driver's tables."""

from . import geo_queries, more_queries, road_queries, route_queries, text_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "geo_queries", "more_queries", "road_queries", "route_queries", "text_queries"]
