"""Range and nearest-neighbour joins on a grid of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import METRES_PER_DEGREE
from ..functions.geo import haversine_m

EARTH_M = 6_371_000.0


def range_join(left: DataFrame, right: DataFrame, radius_m: float, boxed: bool = True, merge: bool = False) -> DataFrame:
    """Pairs of left and right rows at most radius_m apart, with distance_m. Both have lat and lon; right's come as r_lat and r_lon.

    Cells are as wide as the box of the radius in degrees. boxed asks for the box itself, whose partners lie in the nine
    cells around a point. Without it the circle decides alone: it reaches further east and west the further a point is
    from the equator, and left rows are sent to as many cells as that takes. The join is an equi join on cells whose
    large partitions Spark can split; with merge no side is broadcast. Points on both sides of the date line are no partners.
    """
    size = radius_m / (METRES_PER_DEGREE if boxed else METRES_PER_DEGREE - 200)
    cell = lambda v: F.floor(F.col(v) / size)
    around = lambda b: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.struct((cell("lat") + i).alias("a"), b.alias("b")))
    angle = F.least(F.lit(1.0), F.sin(F.lit(radius_m / EARTH_M)) / F.greatest(F.cos(F.radians("lat")), F.lit(1e-12)))
    reach = F.degrees(F.asin(angle)) + 1e-9
    low, high = (cell("lon") - 1, cell("lon") + 1) if boxed else (F.floor((F.col("lon") - reach) / size), F.floor((F.col("lon") + reach) / size))
    sent = left.withColumn("__cell", F.explode(F.flatten(F.transform(F.sequence(low, high), around))))
    dealt = right.withColumnsRenamed({"lat": "r_lat", "lon": "r_lon"}).withColumn("__cell", F.struct(F.floor(F.col("r_lat") / size).alias("a"), F.floor(F.col("r_lon") / size).alias("b")))
    pairs = sent.join(dealt.hint("merge") if merge else dealt, "__cell").drop("__cell")
    if boxed:
        pairs = pairs.where((F.abs(F.col("lat") - F.col("r_lat")) <= size) & (F.abs(F.col("lon") - F.col("r_lon")) <= size))
    return pairs.withColumn("distance_m", haversine_m("lat", "lon", "r_lat", "r_lon")).where(F.col("distance_m") <= radius_m)


def nearest(left: DataFrame, right: DataFrame, by: list[str], ties: list[str], radius_m: float, k: int) -> DataFrame:
    """The k nearest right rows of each left row (known by the columns `by`) within the radius; equal distances in the order of `ties`."""
    order = W.partitionBy(*by).orderBy("distance_m", *ties)
    return range_join(left, right, radius_m).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def snap(points: DataFrame, nodes: DataFrame, by: list[str], radius_m: float = 1000.0) -> DataFrame:
    """points with the nearest node (node_id) within the radius; points without one are dropped. The smaller node id wins ties.

    The nearest is taken by a minimum over (distance, node), which is combined before its shuffle.
    """
    pairs = range_join(points, nodes.select("node_id", "lat", "lon"), radius_m)
    best = pairs.groupBy(*by).agg(F.min(F.struct("distance_m", "node_id")).alias("best"))
    return best.select(*by, F.col("best.node_id").alias("node_id"), F.col("best.distance_m").alias("distance_m"))
