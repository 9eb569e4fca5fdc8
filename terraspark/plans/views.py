"""Geographic tables derived from the star schema by integer arithmetic, the same in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .registry import table


def places(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as the first source and customers as the second; every third customer is a near copy of a supplier."""
    s = table(spark, d, "supplier")
    sup = s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation_key"), (F.lit(4.5) + (F.col("s_suppkey") * 37 % 650) / 100).alias("lat"), (F.lit(-3.0) + (F.col("s_suppkey") * 53 % 420) / 100).alias("lon"))
    near = sup.select(F.col("key").alias("skey"), F.col("name").alias("sname"), F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    c = table(spark, d, "customer").crossJoin(F.broadcast(s.agg(F.count(F.lit(1)).alias("n"))))
    k = F.col("c_custkey")
    copy = k % 3 == 0
    cus = c.withColumn("skey", k % F.col("n")).join(near, "skey").select(
        k.alias("key"), F.when(copy, F.concat("sname", F.lit("x"))).otherwise(F.col("c_name")).alias("name"), F.col("c_nationkey").alias("nation_key"),
        F.when(copy, F.col("slat") + 0.0002).otherwise(F.lit(4.5) + (k * 41 % 6500) / 1000).alias("lat"), F.when(copy, F.col("slon")).otherwise(F.lit(-3.0) + (k * 59 % 4200) / 1000).alias("lon"))
    both = sup.select(F.lit("overture").alias("source"), "*").unionByName(cus.select(F.lit("osm").alias("source"), "*"))
    return both.withColumn("category_ord", F.col("key") % 15)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    row = F.floor(k / 20)
    return table(spark, d, "part").select(k.alias("node_id"), (k % 20).alias("col"), row.alias("row_no"), (F.lit(5.0) + row * F.lit(0.002)).alias("lat"), (F.lit(-0.5) + (k % 20) * F.lit(0.002)).alias("lon"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").select(F.col("p_partkey").alias("src"))
    to = n.withColumnRenamed("src", "dst")
    right = n.where(F.col("src") % 20 < 19).withColumn("dst", F.col("src") + 1).join(to, "dst")
    up = n.withColumn("dst", F.col("src") + 20).join(to, "dst")
    s, t = F.col("src"), F.col("dst")
    base = right.unionByName(up).select("src", "dst", (100 + (s * 7 + t * 11) % 900).alias("distance_m"), ((s * 5 + t) % 8).alias("road_class"), ((s + t * 3) % 4).alias("surface"), ((s * 3 + t) % 11 == 0).cast("int").alias("oneway"), ((s + t) % 17 == 0).cast("int").alias("roundabout"))
    back = base.where("oneway = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *base.columns[2:])
    return base.unionByName(back)


def waypoints(spark: SparkSession, d: str) -> DataFrame:
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    e = table(spark, d, "events").select(F.col("user_id").alias("trip_id"), "event_id", seq.alias("seq"))
    col, row = (F.col("seq") - 1) % 20, F.floor((F.col("seq") - 1) / 20) % 5
    return e.select("trip_id", "seq", (F.lit(5.0) + row * F.lit(0.002) + (F.col("event_id") % 7 - 3) * F.lit(0.00001)).alias("lat"), (F.lit(-0.5) + col * F.lit(0.002)).alias("lon"), (F.lit(1704067200) + F.col("seq") * 30 + F.col("event_id") % 11).alias("t_sec"))


def contributions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("wrong_turn", "road_closed", "better_route", "roundabout_error", "missing_road", "speed_wrong", "other")]), (k % 7 + 1).cast("int"))
    at = k % 200
    return table(spark, d, "orders").select(k.alias("id"), at.alias("src_node"), F.when(at % 20 < 19, at + 1).otherwise(at - 1).alias("dst_node"), kind.alias("issue_type"), F.col("o_orderdate").alias("created_at"))


PLACES = """sup AS (
  SELECT s_suppkey AS k, s_name AS nm, s_nationkey AS nk,
         CAST(4.5 AS DOUBLE) + CAST((s_suppkey * 37) % 650 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat,
         CAST(-3.0 AS DOUBLE) + CAST((s_suppkey * 53) % 420 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon
  FROM supplier),
cus AS (
  SELECT c.c_custkey AS k,
         CASE WHEN c.c_custkey % 3 = 0 THEN concat(s.nm, 'x') ELSE c.c_name END AS nm,
         c.c_nationkey AS nk,
         CASE WHEN c.c_custkey % 3 = 0 THEN s.lat + CAST(0.0002 AS DOUBLE)
              ELSE CAST(4.5 AS DOUBLE) + CAST((c.c_custkey * 41) % 6500 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS lat,
         CASE WHEN c.c_custkey % 3 = 0 THEN s.lon
              ELSE CAST(-3.0 AS DOUBLE) + CAST((c.c_custkey * 59) % 4200 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS lon
  FROM customer c JOIN sup s ON s.k = c.c_custkey % (SELECT count(*) FROM supplier)),
places AS (
  SELECT 'overture' AS source, k AS key, nm AS name, k % 15 AS category_ord, nk AS nation_key, lat, lon FROM sup
  UNION ALL
  SELECT 'osm' AS source, k AS key, nm AS name, k % 15 AS category_ord, nk AS nation_key, lat, lon FROM cus)"""

NODES = """nodes AS (
  SELECT p_partkey AS node_id, p_partkey % 20 AS col, CAST(floor(p_partkey / CAST(20 AS DOUBLE)) AS BIGINT) AS row_no,
         CAST(5.0 AS DOUBLE) + floor(p_partkey / CAST(20 AS DOUBLE)) * CAST(0.002 AS DOUBLE) AS lat,
         CAST(-0.5 AS DOUBLE) + CAST(p_partkey % 20 AS DOUBLE) * CAST(0.002 AS DOUBLE) AS lon
  FROM part)"""

EDGES = """n0 AS (SELECT p_partkey AS id FROM part),
b0 AS (
  SELECT n.id AS src, m.id AS dst FROM n0 n JOIN n0 m ON m.id = n.id + 1 WHERE n.id % 20 < 19
  UNION ALL
  SELECT n.id AS src, m.id AS dst FROM n0 n JOIN n0 m ON m.id = n.id + 20),
a0 AS (
  SELECT src, dst, 100 + ((src * 7 + dst * 11) % 900) AS distance_m,
         (src * 5 + dst) % 8 AS road_class, (src + dst * 3) % 4 AS surface,
         CASE WHEN (src * 3 + dst) % 11 = 0 THEN 1 ELSE 0 END AS oneway,
         CASE WHEN (src + dst) % 17 = 0 THEN 1 ELSE 0 END AS roundabout
  FROM b0),
edges AS (
  SELECT src, dst, distance_m, road_class, surface, oneway, roundabout FROM a0
  UNION ALL
  SELECT dst AS src, src AS dst, distance_m, road_class, surface, oneway, roundabout FROM a0 WHERE oneway = 0)"""

WAYPOINTS = """e0 AS (
  SELECT user_id AS trip_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
w0 AS (
  SELECT trip_id, event_id, seq, (seq - 1) % 20 AS col, CAST(floor((seq - 1) / CAST(20 AS DOUBLE)) AS BIGINT) % 5 AS row_no FROM e0),
waypoints AS (
  SELECT trip_id, seq,
         CAST(5.0 AS DOUBLE) + CAST(row_no AS DOUBLE) * CAST(0.002 AS DOUBLE) + CAST(event_id % 7 - 3 AS DOUBLE) * CAST(0.00001 AS DOUBLE) AS lat,
         CAST(-0.5 AS DOUBLE) + CAST(col AS DOUBLE) * CAST(0.002 AS DOUBLE) AS lon,
         1704067200 + seq * 30 + event_id % 11 AS t_sec
  FROM w0)"""

CONTRIBUTIONS = """contributions AS (
  SELECT o_orderkey AS id, o_orderkey % 200 AS src_node,
         CASE WHEN (o_orderkey % 200) % 20 < 19 THEN o_orderkey % 200 + 1 ELSE o_orderkey % 200 - 1 END AS dst_node,
         CASE o_orderkey % 7 WHEN 0 THEN 'wrong_turn' WHEN 1 THEN 'road_closed' WHEN 2 THEN 'better_route'
              WHEN 3 THEN 'roundabout_error' WHEN 4 THEN 'missing_road' WHEN 5 THEN 'speed_wrong' ELSE 'other' END AS issue_type,
         o_orderdate AS created_at
  FROM orders)"""


def haversine_sql(a: str, b: str) -> str:
    h = f"(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))"
    return f"(6371000.0::DOUBLE * 2 * atan2(sqrt({h}), sqrt(1 - {h})))"
