"""Penalties on edges, from contributions and from learned speeds. Edges without one have penalty 1; infinity blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOW_BELOW, MOST, LEAST_SAMPLES = 0.6, 5.0, 3


def from_contributions(reports: DataFrame) -> DataFrame:
    """(src, dst, penalty) of reports (id, src_node, dst_node, issue_type, created_at). Of several on one edge the last by (created_at, id) holds."""
    kind = F.col("issue_type")
    value = F.when(kind == "road_closed", F.lit(float("inf"))).when(kind == "speed_wrong", 1.5).when(kind.isin("wrong_turn", "roundabout_error"), 1.2)
    rows = reports.withColumn("penalty", value).where("penalty IS NOT NULL AND src_node IS NOT NULL AND dst_node IS NOT NULL")
    ends = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    sides = F.when(kind.isin("road_closed", "speed_wrong"), F.array(ends("src_node", "dst_node"), ends("dst_node", "src_node"))).otherwise(F.array(ends("src_node", "dst_node")))
    each = rows.select(F.explode(sides).alias("e"), "penalty", "created_at", "id").select("e.src", "e.dst", "penalty", "created_at", "id")
    return each.groupBy("src", "dst").agg(F.max_by("penalty", F.struct("created_at", "id")).alias("penalty"))


def merge(mine: DataFrame, other: DataFrame) -> DataFrame:
    """The greater penalty of each edge; an edge that only the other has gets 1 at least."""
    rows = mine.withColumn("penalty", F.col("penalty")).unionByName(other.withColumn("penalty", F.greatest(F.lit(1.0), "penalty")))
    return rows.groupBy("src", "dst").agg(F.max("penalty").alias("penalty"))


def from_speeds(speeds: DataFrame, expected: DataFrame) -> DataFrame:
    """Penalties of segments (src, dst, sample_count, avg_kmh) that are much slower than expected (src, dst, expected_kmh)."""
    joined = speeds.where(F.col("sample_count") >= LEAST_SAMPLES).join(expected.where("expected_kmh > 0"), ["src", "dst"])
    slow = joined.where(F.col("avg_kmh") < SLOW_BELOW * F.col("expected_kmh"))
    return slow.select("src", "dst", F.least(F.col("expected_kmh") / F.col("avg_kmh"), F.lit(MOST)).alias("penalty"))


def applied(edges: DataFrame, penalties: DataFrame) -> DataFrame:
    """edges with penalty (1 where there is none) and blocked."""
    return edges.join(penalties, ["src", "dst"], "left").withColumn("penalty", F.coalesce("penalty", F.lit(1.0))).withColumn("blocked", F.col("penalty") == float("inf"))
