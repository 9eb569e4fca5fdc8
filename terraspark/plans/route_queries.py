"""Queries of the ingest, routing, tile, request and state operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import ISSUE_TYPES, PROFILE_SPEEDS, SURFACE_FACTORS, TAG_CATEGORIES, TAG_PRIORITY
from ..functions import requests, road, text
from ..operators import ingest, instructions, penalties, routing, spatial, tiles
from ..streaming import ratelimit, trips
from .registry import query, table
from .views import EDGES, NODES, PLACES, WAYPOINTS, contributions, edges, nodes, places, waypoints

_NAMES = "array<struct<lang:string,name:string>>"


def _sources(spark, d):
    """The places view as two sources of whole places; every fourth row lacks its address, some names are French."""
    p = places(spark, d)
    k = F.col("key")
    lang = F.when(k % 5 == 0, "fr").otherwise("en")
    street = F.when(k % 2 == 0, F.concat(k, F.lit(" Main St")))
    addr = F.when(k % 4 != 0, ingest.address(street, F.when(k % 3 == 0, "Accra"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("Ghana"))).cast(ingest.ADDRESS)
    rows = p.select(F.concat("source", F.lit(":"), F.lpad(k.cast("string"), 12, "0")).alias("place_id"), F.array(F.struct(lang.alias("lang"), F.col("name").alias("name"))).cast(_NAMES).alias("names"), F.col("category_ord").cast("string").alias("category"), "lat", "lon", addr.alias("address"), "source")
    return rows.where("source = 'overture'"), rows.where("source = 'osm'")


_WITHIN = "(6371000.0::DOUBLE * 2 * atan2(sqrt(h), sqrt(1 - h)))"


@query("join_01_dedup_candidates", f"""WITH {PLACES}, c AS (SELECT a.source AS sa, a.key AS ka, b.source AS sb, b.key AS kb, a.name AS na, b.name AS nb, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h
 FROM places a JOIN places b ON (a.source > b.source OR (a.source = b.source AND a.key < b.key)) AND abs(a.lat - b.lat) <= 50 / 111320.0 AND abs(a.lon - b.lon) <= 60 / 111320.0)
SELECT sa, ka, sb, kb FROM c WHERE {_WITHIN} <= 50 AND 1 - levenshtein(lower(na), lower(nb)) / greatest(length(na), length(nb)) > 0.8""")
def dedup_candidates(spark, d):
    p = places(spark, d).select("source", "key", "name", "lat", "lon")
    other = p.withColumnsRenamed({"source": "sb", "key": "kb", "name": "nb"})
    pairs = spatial.range_join(p, other, ingest.NEAR_M, boxed=False).where("source > sb OR (source = sb AND key < kb)")
    return pairs.where(text.levenshtein_similarity("name", "nb") > ingest.SIMILAR).select(F.col("source").alias("sa"), F.col("key").alias("ka"), "sb", "kb")


@query("set_01_union_places")
def union_places(spark, d):
    """The fuzzy union of both sources, with addresses and names merged."""
    out = ingest.union_places(*_sources(spark, d))
    return out.select("place_id", "category", "lat", "lon", "source", "merged", F.to_json("names").alias("names"), F.to_json("address").alias("address"))


@query("agg_17_ingest_summary")
def ingest_summary(spark, d):
    return ingest.summary(ingest.union_places(*_sources(spark, d)))


@query("set_03_merge_names", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'en:' || c_name ELSE 'en:' || c_name || '|fr:' || c_mktsegment END AS names FROM customer")
def merge_names(spark, d):
    """Names of languages that are missing are taken over, the first of each."""
    n = lambda lang, c: F.struct(F.lit(lang).alias("lang"), F.col(c).alias("name"))
    a = F.array(n("en", "c_name"))
    b = F.when(F.col("c_custkey") % 3 == 0, F.array(n("en", "c_mktsegment"))).otherwise(F.array(n("fr", "c_mktsegment"), n("fr", "c_name"), n("en", "c_mktsegment")))
    merged = F.aggregate(b, a, lambda acc, x: F.when(F.exists(acc, lambda y: y["lang"] == x["lang"]), acc).otherwise(F.concat(acc, F.array(x))))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.transform(merged, lambda x: F.concat(x["lang"], F.lit(":"), x["name"])), "|").alias("names"))


_VALUES = [v for vs in TAG_CATEGORIES.values() for v in vs] + ["bench", "yes"]


def _elements(spark, d):
    """Parts as tagged map nodes."""
    k = F.col("p_partkey")
    v = lambda by: F.element_at(F.array(*[F.lit(x) for x in _VALUES]), ((k * by) % len(_VALUES) + 1).cast("int"))
    tags = F.map_filter(F.create_map(F.lit("name"), F.when(k % 7 != 0, F.col("p_name")), F.lit("name:en"), F.when(k % 2 == 0, F.col("p_name")), F.lit("name:fr"), F.when(k % 3 == 0, F.col("p_brand")), F.lit("amenity"), F.when(k % 4 != 0, v(1)), F.lit("shop"), F.when(k % 5 != 0, v(3)), F.lit("building"), v(5), F.lit("addr:street"), F.when(k % 2 == 0, F.col("p_type")), F.lit("addr:country"), F.when(k % 3 == 0, "GH")), lambda a, b: b.isNotNull())
    return table(spark, d, "part").select(k.alias("id"), (F.lit(4.0) + k % 40).alias("lat"), (F.lit(-3.0) + k % 70).alias("lon"), tags.alias("tags"))


def _value_sql(by):
    return f"{_VALUES}[(p_partkey * {by}) % {len(_VALUES)} + 1]"


_MAPPED = lambda v: "CASE " + " ".join(f"WHEN {v} IN ({', '.join(repr(x) for x in vs)}) THEN '{k}'" for k, vs in TAG_CATEGORIES.items()) + " END"
_TAGGED = f"""t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 0 THEN {_value_sql(1)} END AS amenity, CASE WHEN p_partkey % 5 <> 0 THEN {_value_sql(3)} END AS shop, {_value_sql(5)} AS building, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS en, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS fr, 4.0 + p_partkey % 40 AS lat, -3.0 + p_partkey % 70 AS lon, p_type, p_partkey FROM part),
k AS (SELECT *, coalesce({_MAPPED('amenity')}, {_MAPPED('shop')}, {_MAPPED('building')}) AS category FROM t)"""
assert TAG_PRIORITY[:2] == ("amenity", "shop")


@query("src_06_tag_category", f"WITH {_TAGGED} SELECT id, category FROM k")
def category_of_tags(spark, d):
    return _elements(spark, d).select("id", ingest.category_of_tags("tags").alias("category"))


@query("src_04_tagged_places", f"WITH {_TAGGED} SELECT 'node/' || id AS place_id, category, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM k WHERE name IS NOT NULL AND name <> '' AND category IS NOT NULL AND lat <= 38 AND lon <= 55")
def tagged_places(spark, d):
    return ingest.tagged_places(_elements(spark, d)).select("place_id", "category", "lat", "lon")


@query("src_08_tag_names", f"WITH {_TAGGED} SELECT id, array_to_string(list_filter([CASE WHEN name IS NOT NULL AND en IS DISTINCT FROM name AND fr IS DISTINCT FROM name THEN 'en:' || name END, 'en:' || en, 'fr:' || fr], lambda x: x IS NOT NULL), '|') AS names FROM k")
def tag_names(spark, d):
    n = ingest.names_of_tags("tags")
    return _elements(spark, d).select("id", F.array_join(F.transform(n, lambda x: F.concat(x["lang"], F.lit(":"), x["name"])), "|").alias("names"))


@query("src_09_tag_address", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 THEN concat_ws(', ', CASE WHEN p_partkey % 2 = 0 THEN p_type END, CASE WHEN p_partkey % 3 = 0 THEN 'GH' ELSE '' END) END AS address FROM part")
def tag_address(spark, d):
    a = F.col("a")
    e = _elements(spark, d).select("id", ingest.address_of_tags("tags").alias("a"))
    return e.select("id", F.when(a.isNotNull(), text.full_address(a["street"], a["city"], a["region"], a["postcode"], a["country"])).alias("address"))


@query("src_02_address", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN concat_ws(', ', CASE WHEN c_custkey % 2 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 5 = 0 THEN 'Ghana' ELSE '' END) END AS address FROM customer")
def address(spark, d):
    k, null = F.col("c_custkey"), F.lit(None).cast("string")
    a = ingest.address(F.when(k % 2 == 0, F.col("c_name")), F.when(k % 3 == 0, F.col("c_mktsegment")), null, null, F.when(k % 5 == 0, "Ghana"))
    x = F.col("a")
    return table(spark, d, "customer").select("c_custkey", a.alias("a")).select("c_custkey", F.when(x.isNotNull(), text.full_address(x["street"], x["city"], x["region"], x["postcode"], x["country"])).alias("address"))


@query("src_03_wkt_point", f"WITH {PLACES} SELECT source, key, CASE WHEN key % 9 <> 0 THEN lat END AS lat, CASE WHEN key % 9 <> 0 THEN lon END AS lon FROM places")
def wkt_point(spark, d):
    p = places(spark, d)
    wkt = F.when(F.col("key") % 9 == 0, F.lit("LINESTRING (1 2, 3 4)")).otherwise(F.concat(F.lit("POINT ("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")")))
    at = F.col("p")
    return p.select("source", "key", ingest.wkt_point(wkt).alias("p")).select("source", "key", at["lat"].alias("lat"), at["lon"].alias("lon"))


def _graph(spark, d, profile="motorcycle"):
    """Weighted edges of one profile, with reported penalties, names and geometry."""
    e = edges(spark, d).withColumn("weight_ds", road.weight_ds(profile, "distance_m", "road_class", "surface"))
    return penalties.applied(e, penalties.from_contributions(contributions(spark, d)))


_COST = f"""WITH RECURSIVE {EDGES}, x AS (SELECT src, dst, min(CAST(floor(distance_m / ([{', '.join(map(str, PROFILE_SPEEDS['motorcycle']))}][road_class + 1]::DOUBLE * [{', '.join(map(str, SURFACE_FACTORS))}][surface + 1]::DOUBLE * 1000.0 / 3600.0) * 10.0) AS BIGINT)) AS w FROM edges GROUP BY src, dst),
sp(node, cost) USING KEY (node) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT c.node, min(c.cost) FROM (SELECT x.dst AS node, sp.cost + x.w AS cost FROM sp JOIN x ON x.src = sp.node) c WHERE NOT EXISTS (SELECT 1 FROM recurring.sp r WHERE r.node = c.node AND r.cost <= c.cost) GROUP BY c.node)"""


@query("rte_10_shortest_times", f"{_COST} SELECT node AS dst, cost AS time_ds FROM sp WHERE node <> 0")
def shortest_times(spark, d):
    """From node 0 to every node it reaches, without penalties."""
    e = edges(spark, d).withColumn("weight_ds", road.weight_ds("motorcycle", "distance_m", "road_class", "surface")).withColumn("penalty", F.lit(1.0))
    n = nodes(spark, d).where("node_id <> 0")
    asked = n.select(F.col("node_id").alias("request"), F.lit(0).cast("long").alias("src"), F.col("node_id").alias("dst"))
    return routing.shortest_paths(asked, routing.weighted(e), paths=False).where("time_ds IS NOT NULL").select("dst", "time_ds")


def _trips(spark, d):
    """Of every trip the first and the last snapped point, as a request."""
    w = waypoints(spark, d)
    ends = w.groupBy("trip_id").agg(F.min_by(F.struct("lat", "lon"), "seq").alias("a"), F.max_by(F.struct("lat", "lon"), "seq").alias("b"))
    n = nodes(spark, d)
    a = spatial.snap(ends.select("trip_id", "a.lat", "a.lon"), n, ["trip_id"]).select("trip_id", F.col("node_id").alias("src"))
    b = spatial.snap(ends.select("trip_id", "b.lat", "b.lon"), n, ["trip_id"]).select("trip_id", F.col("node_id").alias("dst"))
    return ends.select("trip_id").join(a, "trip_id", "left").join(b, "trip_id", "left").select(F.col("trip_id").alias("request"), "src", "dst")


def _segments(spark, d):
    g = _graph(spark, d)
    n = nodes(spark, d).select("node_id", F.struct("lat", "lon").alias("p"))
    costed = routing.weighted(g)
    paths = routing.shortest_paths(_trips(spark, d), costed)
    shaped = g.where("weight_ds IS NOT NULL AND NOT blocked").join(n.withColumnsRenamed({"node_id": "src", "p": "a"}), "src").join(n.withColumnsRenamed({"node_id": "dst", "p": "b"}), "dst")
    rows = shaped.select("src", "dst", F.floor(F.col("weight_ds") * F.col("penalty")).cast("long").alias("cost"), "distance_m", F.concat(F.lit("Road "), "road_class").alias("road_name"), (F.col("roundabout") == 1).alias("roundabout"), F.array("a", "b").alias("geometry"))
    return paths, routing.path_segments(paths, rows)


@query("rte_17_routes")
def routes(spark, d):
    """Requests snapped at both ends, and their distance and time, with what went wrong where there is none."""
    paths, _ = _segments(spark, d)
    error = F.when(F.col("src").isNull(), "origin too far").when(F.col("dst").isNull(), "destination too far").when(F.col("path").isNull(), "no route")
    return paths.select("request", "src", "dst", "distance_m", (F.col("time_ds") / 10).alias("duration_s"), F.size("path").alias("nodes"), error.alias("error"))


@query("rte_11_path_segments")
def path_segments(spark, d):
    _, s = _segments(spark, d)
    return s.select("request", "seq", "src", "dst", "distance_m", "road_name", "roundabout")


@query("rte_12_polylines")
def route_polylines(spark, d):
    _, s = _segments(spark, d)
    return routing.polylines(s).select("request", F.size("points").alias("points"), "geojson")


@query("rte_20_instructions")
def turn_instructions(spark, d):
    _, s = _segments(spark, d)
    return instructions.along(s)


#: A request: nodes to start from and nodes to reach, the last of which isn't there.
_ORIGINS, _DESTINATIONS = (0, 40, 85, 120), (19, 59, 99, 139, 199, 999_999_999)


def _matrix(spark, d):
    named = lambda ids: spark.createDataFrame([(str(i), i) for i in ids], "name string, node_id long")
    return routing.matrix(named(_ORIGINS), named(_DESTINATIONS), routing.weighted(_graph(spark, d)))


@query("rte_16_matrix")
def matrix(spark, d):
    """Distances and times of the request's pairs."""
    return _matrix(spark, d)


@query("join_11_pairs", f"SELECT o AS origin, t AS destination FROM (SELECT unnest({[str(i) for i in _ORIGINS]}) AS o), (SELECT unnest({[str(i) for i in _DESTINATIONS]}) AS t)")
def pairs(spark, d):
    return _matrix(spark, d).select("origin", "destination")


def _features(spark, d):
    p = places(spark, d)
    at = F.array(F.struct("lat", "lon"))
    rows = p.select(F.when(F.col("source") == "overture", F.col("key") * 2).otherwise(F.col("key") * 2 + 1).alias("id"), F.lit(tiles.POINT).alias("kind"), at.alias("points"), F.create_map(F.lit("name"), F.col("name"), F.lit("amenity"), F.col("category_ord").cast("string"), F.lit("source"), F.col("source")).alias("tags"))
    return rows.withColumn("properties", tiles.properties("tags")).drop("tags")


_XY = "CAST(floor((lon + 180) / 360 * pow(2, z)) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, z)) AS BIGINT) AS y"


@query("agg_10_features_by_tile", f"WITH {PLACES} SELECT z, x, y, count(*) AS n FROM (SELECT z, {_XY} FROM places, (SELECT unnest(range(15)) AS z)) GROUP BY z, x, y")
def features_by_tile(spark, d):
    return tiles.assigned(_features(spark, d)).groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("n"))


@query("til_09_encoded_tiles", f"WITH {PLACES} SELECT z, x, y, count(*) AS features FROM (SELECT z, {_XY} FROM places, (SELECT unnest(range(15)) AS z)) GROUP BY z, x, y")
def encoded_tiles(spark, d):
    return tiles.tiles(_features(spark, d)).select("z", "x", "y", "features")


@query("ord_05_tile_order")
def tile_order(spark, d):
    made = tiles.tiles(_features(spark, d), 0, 8)
    return made.orderBy("tile_id").select("tile_id", "z", "x", "y", F.length("data").alias("bytes"))


@query("src_21_tile_json", f"WITH {PLACES} SELECT 0 AS minzoom, 14 AS maxzoom FROM places LIMIT 1")
def tile_json(spark, d):
    doc = tiles.tile_json(tiles.tiles(_features(spark, d)), "places", "https://tiles.example")
    return doc.select(F.get_json_object("tilejson", "$.minzoom").cast("int").alias("minzoom"), F.get_json_object("tilejson", "$.maxzoom").cast("int").alias("maxzoom"))


_KEYS = ("place", "amenity", "highway", "building", "natural", "area", "source")


def _ways(spark, d):
    k = F.col("p_partkey")
    name = lambda by: F.element_at(F.array(*[F.lit(x) for x in _KEYS]), (k / by % len(_KEYS) + 1).cast("int"))
    pair = lambda by: F.struct(name(by).alias("key"), F.lit("yes").alias("value"))
    return table(spark, d, "part").select("p_partkey", F.array(pair(1), pair(7)).alias("tags"), (k % 2 == 0).alias("closed"))


_K = lambda by: f"{list(_KEYS)}[CAST(floor(p_partkey / {by} % {len(_KEYS)} + 1) AS BIGINT)]"
_WC = lambda v: f"CASE WHEN {v} IN ('highway', 'railway', 'waterway') THEN 2 WHEN {v} IN ('building', 'landuse', 'natural', 'leisure', 'amenity') AND c THEN 3 END"


@query("til_05_way_class", f"SELECT p_partkey, coalesce({_WC('a')}, {_WC('b')}, CASE WHEN c AND (a = 'area' OR b = 'area') THEN 3 END) AS kind FROM (SELECT p_partkey, {_K(1)} AS a, {_K(7)} AS b, p_partkey % 2 = 0 AS c FROM part)")
def way_class(spark, d):
    return _ways(spark, d).select("p_partkey", tiles.way_class("tags", "closed").alias("kind"))


@query("til_04_point_class", f"SELECT p_partkey, a IN ('place', 'amenity', 'natural') OR b IN ('place', 'amenity', 'natural') AS shown FROM (SELECT p_partkey, {_K(1)} AS a, {_K(7)} AS b FROM part)")
def point_class(spark, d):
    tags = F.map_from_entries(F.array_distinct("tags"))
    return _ways(spark, d).select("p_partkey", tiles.point_class(tags).alias("shown"))


@query("til_06_properties", f"SELECT p_partkey, CAST(len(list_distinct(list_filter([a, b], lambda x: x IN ('place', 'amenity', 'highway', 'building', 'natural')))) AS INTEGER) AS n FROM (SELECT p_partkey, {_K(1)} AS a, {_K(7)} AS b FROM part)")
def tile_properties(spark, d):
    tags = F.map_from_entries(F.array_distinct("tags"))
    return _ways(spark, d).select("p_partkey", F.size(tiles.properties(tags)).alias("n"))


@query("til_10_fetch", f"WITH {PLACES}, t AS (SELECT DISTINCT z, x, y FROM (SELECT z, {_XY} FROM places, (SELECT unnest([4, 8]) AS z))), w AS (SELECT event_id, (event_id % 3) * 4 AS z, event_id % 150 AS x, event_id % 130 AS y, ['mvt', 'pbf', 'png'][event_id % 3 + 1] AS e FROM events) SELECT event_id, CASE WHEN e = 'png' OR w.x >= pow(2, w.z) OR w.y >= pow(2, w.z) THEN 400 WHEN t.z IS NULL THEN 404 ELSE 200 END AS status FROM w LEFT JOIN t ON t.z = w.z AND t.x = w.x AND t.y = w.y AND w.z IN (4, 8)")
def tile_fetch(spark, d):
    k = F.col("event_id")
    wanted = table(spark, d, "events").select("event_id", (k % 3 * 4).cast("int").alias("z"), (k % 150).alias("x"), (k % 130).alias("y"), F.element_at(F.array(F.lit("mvt"), F.lit("pbf"), F.lit("png")), (k % 3 + 1).cast("int")).alias("extension"))
    return tiles.fetch(tiles.tiles(_features(spark, d), 4, 8).where("z IN (4, 8)"), wanted).select("event_id", "status")


@query("flt_15_request_errors", f"SELECT o_orderkey, CASE WHEN trim(q) = '' THEN 'q is required' WHEN strlen(trim(q)) > 500 THEN 'q is too long' END AS query_error, CASE WHEN c = 0 THEN 'origins and destinations are required' WHEN c > 2500 THEN 'too many cells' END AS matrix_error, CASE WHEN i NOT IN {ISSUE_TYPES} THEN 'unknown issue type' END AS report_error FROM (SELECT o_orderkey, repeat(' x', CAST(o_orderkey % 300 AS INTEGER)) AS q, (o_orderkey % 80) * (o_orderkey % 60) AS c, {[*ISSUE_TYPES, 'odd']}[o_orderkey % 8 + 1] AS i FROM orders)")
def request_errors(spark, d):
    k = F.col("o_orderkey")
    issue = F.element_at(F.array(*[F.lit(x) for x in (*ISSUE_TYPES, "odd")]), (k % 8 + 1).cast("int"))
    q = F.repeat(F.lit(" x"), (k % 300).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", requests.query_error(q).alias("query_error"), requests.matrix_error(k % 80, k % 60).alias("matrix_error"), requests.report_error(issue, F.lit(5.0), F.lit(1.0), F.lit("car")).alias("report_error"))


@query("flt_16_safe_tileset", "SELECT p_partkey, NOT (contains(n, '..') OR contains(n, '/')) AND n <> '' AS ok FROM (SELECT p_partkey, ['roads', '../etc', 'a/b', 'x..y', 'tiles-1', ''][p_partkey % 6 + 1] AS n FROM part)")
def safe_tileset(spark, d):
    n = F.element_at(F.array(*[F.lit(x) for x in ("roads", "../etc", "a/b", "x..y", "tiles-1", "")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", requests.safe_tileset(n).alias("ok"))


@query("str_11_media_type", "SELECT p_partkey, CASE x WHEN 'mvt' THEN 'application/vnd.mapbox-vector-tile' WHEN 'pbf' THEN 'application/vnd.mapbox-vector-tile' WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp' WHEN 'json' THEN 'application/json' END AS media_type FROM (SELECT p_partkey, ['mvt', 'pbf', 'png', 'webp', 'json', 'gif'][p_partkey % 6 + 1] AS x FROM part)")
def media_type(spark, d):
    x = F.element_at(F.array(*[F.lit(v) for v in ("mvt", "pbf", "png", "webp", "json", "gif")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", requests.media_type(x).alias("media_type"))


@query("str_12_display", "SELECT o_orderkey, CASE WHEN m < 1000 THEN CAST(CAST(floor(m + 0.5) AS BIGINT) AS VARCHAR) || 'm' ELSE printf('%.1fkm', m / 1000.0) END AS distance, CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || 'h ' || lpad(CAST(CAST(ceil(s % 3600 / 60.0) AS BIGINT) AS VARCHAR), 2, '0') || 'm' ELSE CAST(CAST(ceil(s % 3600 / 60.0) AS BIGINT) AS VARCHAR) || 'm' END AS duration FROM (SELECT o_orderkey, o_orderkey % 5000 + 0.25 AS m, o_orderkey % 9000 AS s FROM orders)")
def display(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", requests.distance_text(k % 5000 + F.lit(0.25)).alias("distance"), requests.duration_text(k % 9000).alias("duration"))


@query("srv_04_first_hop", "SELECT event_id, trim(string_split(h, ',')[1]) AS ip FROM (SELECT event_id, ' 10.0.0.' || event_id % 7 || ' , 10.1.1.1' AS h FROM events)")
def first_hop(spark, d):
    return table(spark, d, "events").select("event_id", requests.first_hop(F.concat(F.lit(" 10.0.0."), F.col("event_id") % 7, F.lit(" , 10.1.1.1"))).alias("ip"))


@query("dat_02_rfc3339", "SELECT event_id, CAST(epoch_us(ts) AS DOUBLE) / 1e6 - 3600 AS seconds FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 2 = 1")
def rfc3339(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    t = F.when(F.col("event_id") % 2 == 0, F.concat(stamp, F.lit("+01:00"))).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "events").select("event_id", text.rfc3339_seconds(t).alias("seconds"))


@query("agg_15_request_counts", "SELECT event_type AS path, user_id % 3 AS status, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1, 2")
def request_counts(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("path"), (F.col("user_id") % 3).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.median("value"), 6).alias("median"))


@query("stm_01_trip_lifecycle")
def trip_lifecycle(spark, d):
    kind = F.element_at(F.array(F.lit("update"), F.lit("start"), F.lit("update"), F.lit("end")), (F.col("event_id") % 4 + 1).cast("int"))
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("trip_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.lit(1).cast("long").alias("points"))
    return trips.lifecycle_batch(e)


@query("stm_03_rate_limit")
def rate_limit(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t_sec") / F.lit(1e6), F.lit(ratelimit.BY_KEY).alias("rpm"))
    return ratelimit.limit_batch(e.toDF("key", "seq", "t_sec", "rpm"))


@query("set_04_no_repeats", f"WITH {WAYPOINTS}, p AS (SELECT trip_id, seq, floor(lat * 500) AS a, floor(lon * 500) AS b FROM waypoints), q AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM p WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) SELECT trip_id, count(*) AS points FROM q WHERE pa IS NULL OR pa <> a OR pb <> b GROUP BY trip_id")
def no_repeats(spark, d):
    w = waypoints(spark, d).select(F.col("trip_id").alias("request"), "seq", F.array(F.struct(F.floor(F.col("lat") * 500).cast("double").alias("lat"), F.floor(F.col("lon") * 500).cast("double").alias("lon"))).alias("geometry"))
    return routing.polylines(w).select(F.col("request").alias("trip_id"), F.size("points").cast("long").alias("points"))


@query("agg_08_route_totals", "SELECT l_orderkey, sum(l_linenumber) AS legs, round(sum(l_extendedprice), 2) AS metres FROM lineitem GROUP BY l_orderkey")
def route_totals(spark, d):
    sums = routing.totals(table(spark, d, "lineitem"), "l_orderkey", "l_extendedprice", "l_linenumber")
    return sums.select("l_orderkey", F.col("l_linenumber").alias("legs"), F.round("l_extendedprice", 2).alias("metres"))


@query("geo_12_simplify")
def simplify(spark, d):
    """How many points of each trip remain at every zoom."""
    import pandas as pd

    w = waypoints(spark, d).groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("seq", "lat", "lon"))).alias("p"))

    def run(batches):
        for batch in batches:
            rows = [(t, z, int(tiles.simplified(np.array([(x["lat"], x["lon"]) for x in p], float), tiles.tolerance(z)).sum()) if len(p) > 2 else len(p)) for t, p in zip(batch["trip_id"], batch["p"], strict=True) for z in range(15)]
            yield pd.DataFrame(rows, columns=["trip_id", "zoom", "points"])

    import numpy as np

    return w.mapInPandas(run, "trip_id long, zoom int, points int")


