"""Positions along lines of ordered points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import bearing, haversine_m


def measured(points: DataFrame, by: str) -> DataFrame:
    """points (by, seq, lat, lon) with leg, the metres from the point before, and upto and before: the metres to each point, and to the one before it."""
    w = W.partitionBy(by).orderBy("seq")
    leg = F.coalesce(haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon"), F.lit(0.0))
    upto, before = (F.sum("leg").over(w.rowsBetween(W.unboundedPreceding, k)) for k in (0, -1))
    return points.withColumn("leg", leg).withColumns({"upto": upto, "before": F.coalesce(before, F.lit(0.0))})


def interpolate(points: DataFrame, by: str, fraction: float) -> DataFrame:
    """(by, lat, lon, bearing) at a share of the length of each line of points (by, seq, lat, lon)."""
    w = W.partitionBy(by).orderBy("seq")
    legs = points.withColumns({"to_lat": F.lead("lat").over(w), "to_lon": F.lead("lon").over(w)}).where("to_lat IS NOT NULL").withColumn("leg", haversine_m("lat", "lon", "to_lat", "to_lon"))
    whole = legs.withColumns({"before": F.coalesce(F.sum("leg").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)), "total": F.sum("leg").over(W.partitionBy(by))})
    at = F.col("total") * fraction
    hit = whole.where((F.col("before") <= at) & (at <= F.col("before") + F.col("leg"))).groupBy(by).agg(F.min_by(F.struct("lat", "lon", "to_lat", "to_lon", "leg", "before", "total"), "seq").alias("s"))
    share = F.when(F.col("s.leg") > 0, (F.col("s.total") * fraction - F.col("s.before")) / F.col("s.leg")).otherwise(0.0)
    mid = lambda a: F.col(f"s.{a}") + (F.col(f"s.to_{a}") - F.col(f"s.{a}")) * share
    return hit.select(by, mid("lat").alias("lat"), mid("lon").alias("lon"), bearing("s.lat", "s.lon", "s.to_lat", "s.to_lon").alias("bearing"))
