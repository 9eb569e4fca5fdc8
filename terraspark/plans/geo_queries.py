"""Queries of the geometry, filter and spatial join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import AFRICA, CATEGORIES, LANDMARKS
from ..functions import geo
from ..operators import spatial
from .registry import query
from .views import NODES, PLACES, WAYPOINTS, haversine_sql, nodes, places, waypoints

_PAIR = f"WITH {PLACES}, p AS (SELECT a.key, a.source, a.lat, a.lon, b.lat AS blat, b.lon AS blon FROM places a JOIN sup b ON b.k = a.key % (SELECT count(*) FROM supplier)), a AS (SELECT key, source, lat, lon FROM p) "


def _pairs(spark, d):
    """Every place with a supplier's position."""
    p = places(spark, d)
    sup = p.where("source = 'overture'").select(F.col("key").alias("k"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    n = sup.agg(F.count(F.lit(1)).alias("n"))
    return p.crossJoin(F.broadcast(n)).withColumn("k", F.col("key") % F.col("n")).join(sup, "k")


_H = "(pow(sin(radians(blat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(blat)) * pow(sin(radians(blon - lon) / 2), 2))"


@query("geo_01_haversine_m", f"{_PAIR} SELECT source, key, round(6371000.0::DOUBLE * 2 * atan2(sqrt({_H}), sqrt(1 - {_H})), 3) AS metres FROM p")
def haversine(spark, d):
    return _pairs(spark, d).select("source", "key", F.round(geo.haversine_m("lat", "lon", "blat", "blon"), 3).alias("metres"))


@query("geo_02_haversine_km", f"{_PAIR} SELECT source, key, round(6371.0::DOUBLE * 2 * atan2(sqrt({_H}), sqrt(1 - {_H})), 6) AS km FROM p")
def haversine_km(spark, d):
    return _pairs(spark, d).select("source", "key", F.round(geo.haversine_km("lat", "lon", "blat", "blon"), 6).alias("km"))


@query("geo_03_edge_length", f"{_PAIR} SELECT source, key, round(12742000.0::DOUBLE * asin(sqrt({_H})), 3) AS metres FROM p")
def edge_length(spark, d):
    return _pairs(spark, d).select("source", "key", F.round(geo.edge_length_m("lat", "lon", "blat", "blon"), 3).alias("metres"))


@query("geo_04_travel_bound", f"{_PAIR} SELECT source, key, CAST(floor(12742000.0::DOUBLE * asin(sqrt({_H})) / (120.0 * 1000 / 3600) * 10 + 1e-9) AS BIGINT) AS bound_ds FROM p")
def travel_bound(spark, d):
    """Least possible travel time along the straight line at 120 km/h."""
    return _pairs(spark, d).select("source", "key", F.floor(geo.edge_length_m("lat", "lon", "blat", "blon") / F.lit(120.0 * 1000 / 3600) * 10 + 1e-9).alias("bound_ds"))


@query("geo_05_degrees", "SELECT o_orderkey, round(o_totalprice / 111320.0::DOUBLE, 9) AS degrees FROM orders")
def degrees(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.round(geo.metres_to_degrees("o_totalprice"), 9).alias("degrees"))


_BEARING = "degrees(atan2(sin(radians(blon - lon)) * cos(radians(blat)), cos(radians(lat)) * sin(radians(blat)) - sin(radians(lat)) * cos(radians(blat)) * cos(radians(blon - lon))))"


@query("geo_06_bearing", f"{_PAIR} SELECT source, key, round(({_BEARING} + 360) % 360, 6) AS bearing FROM p")
def bearing(spark, d):
    return _pairs(spark, d).select("source", "key", F.round(geo.bearing("lat", "lon", "blat", "blon"), 6).alias("bearing"))


_DELTA = "(((x % 360) + 360) % 360)"


@query("geo_08_bearing_delta", f"SELECT event_id, CASE WHEN {_DELTA} > 180 THEN {_DELTA} - 360 ELSE {_DELTA} END AS delta FROM (SELECT event_id, event_id * 7 % 1441 - 720 AS x FROM events)")
def bearing_delta(spark, d):
    x = F.col("event_id") * 7 % 1441 - 720
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", geo.bearing_delta(x).cast("long").alias("delta"))


@query("geo_09_turn_class", """SELECT event_id, CASE WHEN abs(x) <= 15 THEN 'straight' WHEN abs(x) <= 45 THEN 'slight_' || s WHEN abs(x) <= 135 THEN 'turn_' || s WHEN abs(x) <= 170 THEN 'sharp_' || s ELSE 'u_turn' END AS turn
FROM (SELECT event_id, event_id * 7 % 361 - 180 AS x, CASE WHEN event_id * 7 % 361 - 180 > 0 THEN 'right' ELSE 'left' END AS s FROM events)""")
def turn_class(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", geo.turn_class(F.col("event_id") * 7 % 361 - 180).alias("turn"))


_TILE = "SELECT source, key, lat, lon, z, CAST(least(greatest(floor((lon + 180) / 360 * pow(2, z)), 0), pow(2, z) - 1) AS BIGINT) AS x, CAST(least(greatest(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, z)), 0), pow(2, z) - 1) AS BIGINT) AS y FROM places, (SELECT unnest([0, 5, 10, 14, 18]) AS z)"


def _tiles(spark, d):
    z = F.explode(F.array(*[F.lit(v) for v in (0, 5, 10, 14, 18)]))
    p = places(spark, d).select("source", "key", "lat", "lon", z.alias("z"))
    x, y = geo.tile_xy("lat", "lon", F.col("z"))
    return p.withColumns({"x": x, "y": y})


@query("geo_10_tile_of_point", f"WITH {PLACES} SELECT source, key, z, x, y FROM ({_TILE})")
def tile_of_point(spark, d):
    return _tiles(spark, d).select("source", "key", "z", "x", "y")


@query("geo_11_tile_local", f"WITH {PLACES}, t AS ({_TILE}) SELECT source, key, z, CAST(round(((lon + 180) / 360 * pow(2, z) - x) * 4096) AS INTEGER) AS px, CAST(round(((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, z) - y) * 4096) AS INTEGER) AS py FROM t")
def tile_local(spark, d):
    t = _tiles(spark, d)
    px, py = geo.tile_local("lat", "lon", F.col("z"), F.col("x"), F.col("y"))
    return t.select("source", "key", "z", px.alias("px"), py.alias("py"))


_REL = "CASE key % 6 WHEN 0 THEN 'near' WHEN 1 THEN 'behind' WHEN 2 THEN 'past' WHEN 3 THEN 'beside' WHEN 4 THEN 'opposite' ELSE 'between' END"


@query("geo_07_relation_box", f"""{_PAIR}, r AS (SELECT source, key, {_REL} AS rel, lat, lon, blat, blon, sqrt(pow(lat - blat, 2) + pow(lon - blon, 2)) AS s FROM p),
c AS (SELECT source, key, rel, CASE WHEN rel IN ('behind', 'past', 'opposite') THEN CASE WHEN s > 0 THEN lat + (lat - blat) / s * 150.0 / 111320.0 ELSE lat + 150.0 / 111320.0 END WHEN rel = 'between' THEN (lat + blat) / 2 ELSE lat END AS y,
 CASE WHEN rel IN ('behind', 'past', 'opposite') THEN CASE WHEN s > 0 THEN lon + (lon - blon) / s * 150.0 / 111320.0 ELSE lon END WHEN rel = 'between' THEN (lon + blon) / 2 ELSE lon END AS x,
 CASE WHEN rel = 'beside' THEN 50.0 WHEN rel = 'near' THEN 200.0 ELSE 100.0 END / 111320.0 AS h FROM r)
SELECT source, key, rel, round(x - h, 7) AS min_lon, round(y - h, 7) AS min_lat, round(x + h, 7) AS max_lon, round(y + h, 7) AS max_lat FROM c""")
def relation_box(spark, d):
    rel = F.element_at(F.array(*[F.lit(x) for x in ("near", "behind", "past", "beside", "opposite", "between")]), (F.col("key") % 6 + 1).cast("int"))
    b = geo.relation_box(F.col("rel"), "lat", "lon", "blat", "blon", "blat", "blon")
    p = _pairs(spark, d).withColumn("rel", rel).withColumn("b", b)
    return p.select("source", "key", "rel", *[F.round(f"b.{c}", 7).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])


@query("flt_01_bbox", f"WITH {PLACES} SELECT source, key FROM places WHERE lon BETWEEN -2.0 AND -1.0 AND lat BETWEEN 5.0 AND 8.0")
def bbox(spark, d):
    return places(spark, d).where(geo.in_box("lat", "lon", (-2.0, 5.0, -1.0, 8.0))).select("source", "key")


@query("flt_02_region", f"WITH {PLACES} SELECT source, count(*) AS n FROM places WHERE lon BETWEEN -25 AND 55 AND lat BETWEEN -35 AND 38 GROUP BY source")
def region(spark, d):
    return places(spark, d).where(geo.in_box("lat", "lon", AFRICA)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


_ODD = "SELECT event_id, value - 90 AS lat, value * 3 - 180 AS lon FROM events"


@query("flt_03_valid_position", f"SELECT event_id, coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false) AS ok FROM ({_ODD})")
def valid_position(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", geo.valid_position(F.col("value") - 90, F.col("value") * 3 - 180).alias("ok"))


@query("flt_04_box_or_null", "SELECT event_id, event_id % 5 < event_id % 7 AND event_id % 3 < event_id % 11 AS has_extent FROM events")
def box_or_null(spark, d):
    k = F.col("event_id")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", geo.box_or_null(k % 5, k % 3, k % 7, k % 11).isNotNull().alias("has_extent"))


@query("flt_05_valid_tile", "SELECT event_id, event_id % 25 <= 22 AND event_id % 1031 < pow(2, event_id % 25) AND event_id % 517 < pow(2, event_id % 25) AS ok FROM events")
def valid_tile(spark, d):
    k = F.col("event_id")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", geo.valid_tile(k % 25, k % 1031, k % 517).alias("ok"))


def _categories(p):
    return p.withColumn("category", F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("category_ord") + 1).cast("int")))


_CAT = f"WITH {PLACES}, c AS (SELECT *, [{', '.join(repr(c) for c in CATEGORIES)}][category_ord + 1] AS category FROM places)"


@query("flt_06_country", f"WITH {PLACES} SELECT source, key, n_name AS country FROM places JOIN nation ON n_nationkey = nation_key WHERE n_name = 'NATION_7'")
def country(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").where("n_name = 'NATION_7'")
    return places(spark, d).join(F.broadcast(n), F.col("nation_key") == F.col("n_nationkey")).select("source", "key", F.col("n_name").alias("country"))


@query("flt_07_category", f"{_CAT} SELECT source, key, category FROM c WHERE category = 'hospital'")
def category(spark, d):
    return _categories(places(spark, d)).where("category = 'hospital'").select("source", "key", "category")


@query("flt_08_radius", f"WITH {PLACES}, q AS (SELECT 6.0::DOUBLE AS lat, -1.5::DOUBLE AS lon) SELECT source, key, round({haversine_sql('q', 'p')} / 1000, 6) AS km FROM places p, q WHERE {haversine_sql('q', 'p')} / 1000 <= 50")
def radius(spark, d):
    km = geo.haversine_km(6.0, -1.5, "lat", "lon")
    return places(spark, d).where(km <= 50).select("source", "key", F.round(km, 6).alias("km"))


@query("flt_09_landmarks", f"{_CAT} SELECT source, key, category FROM c WHERE category IN {LANDMARKS}")
def landmarks(spark, d):
    return _categories(places(spark, d)).where(F.col("category").isin(*LANDMARKS)).select("source", "key", "category")


@query("flt_10_place_points", f"{_CAT} SELECT source, key, name, category, n_name || ', ' || r_name AS address, lat, lon FROM c JOIN nation ON n_nationkey = nation_key JOIN region ON r_regionkey = n_regionkey")
def place_points(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").join(spark.read.parquet(f"{d}/region.parquet"), F.col("r_regionkey") == F.col("n_regionkey"))
    p = _categories(places(spark, d)).join(F.broadcast(n), F.col("nation_key") == F.col("n_nationkey"))
    return p.select("source", "key", "name", "category", F.concat_ws(", ", "n_name", "r_name").alias("address"), "lat", "lon")


@query("flt_11_landmark_by_name", f"{_CAT} SELECT source, key FROM c WHERE category IN {LANDMARKS} AND contains(lower(name), 'r#00000001') AND lon BETWEEN -3 AND 0 AND lat BETWEEN 4 AND 9")
def landmark_by_name(spark, d):
    names = F.array(F.struct(F.lit("en").alias("lang"), F.col("name").alias("name")))
    p = _categories(places(spark, d)).withColumn("names", names).where(F.col("category").isin(*LANDMARKS))
    return p.where(F.exists("names", lambda n: F.lower(n["name"]).contains("r#00000001")) & geo.in_box("lat", "lon", (-3.0, 4.0, 0.0, 9.0))).select("source", "key")


@query("join_04_reverse_geocode", f"""WITH {PLACES}, r AS (SELECT k AS request, lat + 0.001 AS lat, lon - 0.001 AS lon FROM cus),
c AS (SELECT r.request, p.source, p.key, p.name, {haversine_sql('r', 'p')} AS dist FROM r JOIN places p ON p.lat BETWEEN r.lat - 500 / 111320.0 AND r.lat + 500 / 111320.0 AND p.lon BETWEEN r.lon - 500 / 111320.0 AND r.lon + 500 / 111320.0),
k AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY round(dist, 6), source, key) AS rank FROM c WHERE dist <= 500)
SELECT request, rank, source, key, name, round(dist, 3) AS distance_m FROM k WHERE rank <= 5""")
def reverse_geocode(spark, d):
    """For a request beside every customer, the five nearest places within 500 m."""
    p = places(spark, d)
    r = p.where("source = 'osm'").select(F.col("key").alias("request"), (F.col("lat") + 0.001).alias("lat"), (F.col("lon") - 0.001).alias("lon"))
    pairs = spatial.range_join(r, p.select("source", "key", "name", "lat", "lon"), 500.0)
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("request").orderBy(F.round("distance_m", 6), "source", "key")).cast("long")
    return pairs.withColumn("rank", rank).where("rank <= 5").select("request", "rank", "source", "key", "name", F.round("distance_m", 3).alias("distance_m"))


_SNAP = f"""WITH {NODES}, {WAYPOINTS}, c AS (SELECT w.trip_id, w.seq, n.node_id, {haversine_sql('w', 'n')} AS dist FROM waypoints w JOIN nodes n ON abs(n.lat - w.lat) <= 1000 / 111320.0 AND abs(n.lon - w.lon) <= 1000 / 111320.0),
s AS (SELECT trip_id, seq, node_id, dist, row_number() OVER (PARTITION BY trip_id, seq ORDER BY dist, node_id) AS rn FROM c WHERE dist <= 1000)"""


@query("join_05_snap", f"{_SNAP} SELECT trip_id, seq, node_id, round(dist, 3) AS distance_m FROM s WHERE rn = 1")
def snap(spark, d):
    return spatial.snap(waypoints(spark, d), nodes(spark, d), ["trip_id", "seq"]).select("trip_id", "seq", "node_id", F.round("distance_m", 3).alias("distance_m"))


@query("ord_01_nearest_limit", f"WITH {PLACES}, q AS (SELECT 6.0::DOUBLE AS lat, -1.5::DOUBLE AS lon) SELECT source, key, round({haversine_sql('q', 'p')}, 3) AS metres FROM places p, q ORDER BY round({haversine_sql('q', 'p')}, 6), source, key LIMIT 20")
def nearest_limit(spark, d):
    m = geo.haversine_m(6.0, -1.5, "lat", "lon")
    return places(spark, d).orderBy(F.round(m, 6), "source", "key").limit(20).select("source", "key", F.round(m, 3).alias("metres"))
