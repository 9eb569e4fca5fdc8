"""Road graph construction from ways and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, road


def parse_ways(ways: DataFrame) -> DataFrame:
    """Road ways of raw ways (way_id, refs, tags map): those whose highway is a road and that have two refs at least."""
    t = F.col("tags")
    cls = road.road_class(t["highway"])
    around = F.coalesce(t["junction"].isin("roundabout", "circular"), F.lit(False))
    return ways.withColumn("road_class", cls).where(F.col("road_class").isNotNull() & (F.size("refs") >= 2)).select(
        "way_id", "refs", "road_class", road.surface_class(t["surface"]).alias("surface"), road.direction(t["oneway"], F.col("road_class"), around).alias("direction"),
        road.access_class(t["foot"]).alias("foot"), road.access_class(t["bicycle"]).alias("bicycle"), around.cast("int").alias("roundabout"), t["name"].alias("road_name"))


def reference_counts(ways: DataFrame) -> DataFrame:
    """How often each node is named by the ways."""
    return ways.select(F.explode("refs").alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


def referenced(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    return nodes.join(ways.select(F.explode("refs").alias("node_id")).distinct(), "node_id", "left_semi")


def along_edges(pairs: DataFrame, edges: DataFrame, src: str, dst: str) -> DataFrame:
    """pairs whose nodes (columns src and dst) an edge joins in that direction."""
    return pairs.join(edges.select(F.col("src").alias(src), F.col("dst").alias(dst)).distinct(), [src, dst], "left_semi")


def build_edges(ways: DataFrame, nodes: DataFrame, order: str = "way_id") -> DataFrame:
    """Directed edges (src, dst, way_id, segment, distance_m, time_ds, flags, road_name, geometry) of parsed ways.

    A way is cut at its ends and at nodes that ways name twice or more. A piece with a node without a position is
    dropped, and so is one without length. Pieces run forward, backward or both ways (loops only forward); backward
    ones have their geometry reversed. Ways are handled whole in their windows, which one way's length bounds.
    """
    parts = ways.select("way_id", F.size("refs").alias("n"), F.posexplode("refs").alias("pos", "node_id"))
    at = parts.join(reference_counts(ways).withColumnRenamed("n", "used"), "node_id").join(nodes.select("node_id", "lat", "lon"), "node_id", "left")
    w = W.partitionBy("way_id").orderBy("pos")
    cut = (F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1) | (F.col("used") >= 2)
    step = at.withColumn("cut", cut.cast("int")).withColumns({"to": F.lead("node_id").over(w), "to_lat": F.lead("lat").over(w), "to_lon": F.lead("lon").over(w), "segment": F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1})
    legs = step.where(F.col("to").isNotNull())
    point = lambda a, b: F.struct(F.col(a).alias("lat"), F.col(b).alias("lon"))
    pieces = legs.groupBy("way_id", "segment").agg(
        F.min_by("node_id", "pos").alias("src"), F.max_by("to", "pos").alias("dst"),
        F.sum(geo.edge_length_m("lat", "lon", "to_lat", "to_lon")).alias("length"), F.bool_or(F.col("lat").isNull() | F.col("to_lat").isNull()).alias("lost"),
        F.sort_array(F.collect_list(F.struct("pos", point("lat", "lon").alias("a"), point("to_lat", "to_lon").alias("b")))).alias("legs"))
    whole = pieces.where(~F.col("lost") & (F.col("length") > 0)).join(ways, "way_id")
    geometry = F.concat(F.array(F.col("legs")[0]["a"]), F.transform("legs", lambda x: x["b"]))
    length = F.floor("length").cast("long")
    base = whole.select("src", "dst", "way_id", F.col("segment").cast("long").alias("segment"), length.alias("distance_m"), road.default_ds(F.col("length"), F.col("road_class")).alias("time_ds"), "direction", "road_name", geometry.alias("geometry"),
        road.pack_flags(road_class=F.col("road_class"), surface=F.col("surface"), oneway=(F.col("direction") != 0).cast("int"), foot=F.col("foot"), bicycle=F.col("bicycle"), roundabout=F.col("roundabout")).alias("flags"))
    ways_on = F.filter(F.array(F.when(F.col("direction") >= 0, False), F.when((F.col("direction") <= 0) & ((F.col("src") != F.col("dst")) | (F.col("direction") < 0)), True)), lambda x: x.isNotNull())
    both = base.withColumn("back", F.explode(ways_on))
    return both.select(F.when(F.col("back"), F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(F.col("back"), F.col("src")).otherwise(F.col("dst")).alias("dst"), "way_id", "segment", "distance_m", "time_ds", "flags", "road_name", F.when(F.col("back"), F.reverse("geometry")).otherwise(F.col("geometry")).alias("geometry"))
