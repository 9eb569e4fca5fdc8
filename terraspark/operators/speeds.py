"""Speeds of road segments learned from trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from . import roads

SLOWEST, FASTEST, SHORTEST_M, LEAST_SAMPLES = 1.0, 200.0, 10.0, 3


def steps(waypoints: DataFrame) -> DataFrame:
    """Consecutive waypoints of each trip in their order of arrival, with metres and seconds between."""
    w = W.partitionBy("trip_id").orderBy("seq")
    follow = {f"to_{c}": F.lead(c).over(w) for c in waypoints.columns if c not in ("trip_id", "seq")}
    rows = waypoints.withColumns(follow).where(F.col("to_lat").isNotNull())
    return rows.withColumns({"metres": haversine_m("lat", "lon", "to_lat", "to_lon"), "seconds": F.col("to_t_sec") - F.col("t_sec")})


def trip_stats(waypoints: DataFrame) -> DataFrame:
    """(trip_id, distance_m, duration_s), both cut off; 0 for trips of one point, and no time backwards."""
    w = W.partitionBy("trip_id").orderBy("seq")
    leg = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")
    rows = waypoints.withColumn("leg", F.coalesce(leg, F.lit(0.0)))
    span = F.max_by("t_sec", "seq") - F.min_by("t_sec", "seq")
    return rows.groupBy("trip_id").agg(F.floor(F.sum("leg")).cast("long").alias("distance_m"), F.greatest(span, F.lit(0)).cast("long").alias("duration_s"))


def plausible(kmh):
    return kmh.between(SLOWEST, FASTEST)


def samples(snapped: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, kmh) of consecutive waypoints snapped to the ends (node_id) of an edge, where the step is long, lasting and plausible."""
    rows = steps(snapped).where((F.col("node_id") != F.col("to_node_id")) & (F.col("metres") >= SHORTEST_M) & (F.col("seconds") > 0))
    fast = rows.select(F.col("node_id").alias("src"), F.col("to_node_id").alias("dst"), (F.col("metres") / F.col("seconds") * 3.6).alias("kmh"))
    return roads.along_edges(fast.where(plausible(F.col("kmh"))), edges, "src", "dst")


def p85(values):
    """Of a sorted array: the element at ceil(0.85 n), counted from 0, or the last."""
    n = F.size(values)
    return F.get(values, F.least(F.ceil(n * 0.85).cast("int"), n - 1))


def segment_speeds(found: DataFrame, least: int = LEAST_SAMPLES) -> DataFrame:
    """(src, dst, sample_count, avg_kmh, median_kmh, p85_kmh) of segments with enough samples.

    The 85th percentile is an order statistic by rank within the segment (no list is gathered): rank and count come
    from windows over the segment, and the sort spills.
    """
    w = W.partitionBy("src", "dst")
    ranked = found.withColumns({"n": F.count("kmh").over(w), "rank": F.row_number().over(w.orderBy("kmh"))}).where(F.col("n") >= least)
    at = F.least(F.ceil(F.col("n") * 0.85), F.col("n") - 1) + 1
    middle = F.when((F.col("rank") == F.floor((F.col("n") + 1) / 2)) | (F.col("rank") == F.floor(F.col("n") / 2) + 1), F.col("kmh"))
    return ranked.groupBy("src", "dst").agg(F.count("kmh").alias("sample_count"), F.avg("kmh").alias("avg_kmh"), F.avg(middle).alias("median_kmh"), F.max(F.when(F.col("rank") == at, F.col("kmh"))).alias("p85_kmh"))


def restored(speeds: DataFrame) -> DataFrame:
    """Samples that stand for saved speeds: each segment's average as often as it was sampled."""
    return speeds.select("src", "dst", F.explode(F.array_repeat("avg_kmh", F.col("sample_count").cast("int"))).alias("kmh"))


def counters(found: DataFrame, least: int = LEAST_SAMPLES) -> DataFrame:
    n = found.groupBy("src", "dst").agg(F.count("kmh").alias("n"))
    return n.agg(F.count("n").alias("segments"), F.count_if(F.col("n") >= least).alias("with_enough"))
