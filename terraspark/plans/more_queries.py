"""Queries of single aggregates, scalar functions and small joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import ISSUE_TYPES, TAG_CATEGORIES
from ..functions import requests, text
from ..operators import ingest, lines, routing, speeds
from .registry import query, table
from .road_queries import _SAMPLES, _SEGMENTS, _SPEEDS, _samples, _ways
from .route_queries import _K, _KEYS, _VALUES, _elements, _value_sql
from .text_queries import _COUNTRY, _DOCS, _docs, _requests
from .views import EDGES, WAYPOINTS, edges, nodes, waypoints


@query("flt_13_speed_range", "SELECT event_id FROM events WHERE value BETWEEN 1 AND 200")
def speed_range(spark, d):
    return table(spark, d, "events").where(speeds.plausible(F.col("value"))).select("event_id")


@query("flt_14_least_samples", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 3")
def least_samples(spark, d):
    found = table(spark, d, "events").select(F.col("user_id").alias("src"), F.col("event_type").alias("dst"), F.col("value").alias("kmh"))
    return speeds.segment_speeds(found).select(F.col("src").alias("user_id"), F.col("dst").alias("event_type"), F.col("sample_count").alias("n"))


@query("agg_01_samples_by_segment", f"{_SAMPLES} SELECT src, dst, count(*) AS n, round(min(kmh), 6) AS least, round(max(kmh), 6) AS most FROM samples GROUP BY src, dst")
def samples_by_segment(spark, d):
    return _samples(spark, d).groupBy("src", "dst").agg(F.count("kmh").alias("n"), F.round(F.min("kmh"), 6).alias("least"), F.round(F.max("kmh"), 6).alias("most"))


@query("agg_02_mean", f"{_SPEEDS} SELECT src, dst, round(avg_kmh, 6) AS avg_kmh FROM speeds")
def mean(spark, d):
    return speeds.segment_speeds(_samples(spark, d)).select("src", "dst", F.round("avg_kmh", 6).alias("avg_kmh"))


@query("agg_03_median", f"{_SPEEDS} SELECT src, dst, round(median_kmh, 6) AS median_kmh FROM speeds")
def median(spark, d):
    return speeds.segment_speeds(_samples(spark, d)).select("src", "dst", F.round("median_kmh", 6).alias("median_kmh"))


@query("agg_04_p85", "SELECT user_id, list_sort(list(value))[least(CAST(ceil(count(*) * 0.85) AS BIGINT), count(*) - 1) + 1] AS p85 FROM events GROUP BY user_id")
def p85(spark, d):
    found = table(spark, d, "events").select(F.col("user_id").alias("src"), F.col("user_id").alias("dst"), F.col("value").alias("kmh"))
    return speeds.segment_speeds(found, least=1).select(F.col("src").alias("user_id"), F.col("p85_kmh").alias("p85"))


@query("agg_09_share_of_best", f"{_COUNTRY} SELECT request, doc_id, round(bm25 / max(bm25) OVER (PARTITION BY request), 6) AS share FROM h2")
def share_of_best(spark, d):
    from ..operators import textindex

    docs = _docs(spark, d)
    scored = textindex.search_all(_requests(docs), docs, ["name", "name_ascii"], ["country"])
    return scored.select("request", "doc_id", F.round(F.col("bm25") / F.max("bm25").over(W.partitionBy("request")), 6).alias("share"))


@query("agg_16_popularity", "SELECT c_custkey, 1 + c_custkey % 3 AS popularity FROM customer")
def popularity(spark, d):
    names = F.array_repeat(F.struct(F.lit("en").alias("lang"), F.col("c_name").alias("name")), (1 + F.col("c_custkey") % 3).cast("int"))
    return table(spark, d, "customer").select("c_custkey", F.size(names).cast("long").alias("popularity"))


_LEV = lambda a, b: f"(1 - levenshtein(lower({a}), lower({b})) / greatest(length({a}), length({b})))"


@query("join_03_name_similarity", f"SELECT c_custkey, round(CASE c_custkey % 3 WHEN 0 THEN greatest({_LEV('c_name', 'n_name')}, {_LEV('c_mktsegment', 'c_name')}) WHEN 1 THEN {_LEV('c_name', 'n_name')} ELSE {_LEV('c_mktsegment', 'n_name')} END, 9) AS similarity FROM customer JOIN nation ON n_nationkey = c_nationkey")
def name_similarity(spark, d):
    n = lambda lang, c: F.struct(F.lit(lang).alias("lang"), F.col(c).alias("name"))
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    k = F.col("c_custkey") % 3
    a = F.when(k == 0, F.array(n("en", "c_name"), n("fr", "c_mktsegment"))).when(k == 1, F.array(n("en", "c_name"))).otherwise(F.array(n("sw", "c_mktsegment")))
    b = F.when(k == 0, F.array(n("en", "n_name"), n("fr", "c_name"))).otherwise(F.array(n("en", "n_name")))
    return c.select("c_custkey", F.round(text.name_similarity(a, b), 9).alias("similarity"))


@query("join_08_names_not_present", "SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 7)")
def names_not_present(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return p.join(p.where("p_size = 7").select("p_brand"), "p_brand", "left_anti").select("p_partkey", "p_brand")


@query("join_09_refs_with_positions", f"{_SEGMENTS} SELECT r.way_id, r.pos, r.node_id, r.lat, r.lon FROM r")
def refs_with_positions(spark, d):
    refs = _ways(spark, d).select("way_id", F.posexplode("refs").alias("pos", "node_id"))
    return refs.join(nodes(spark, d).select("node_id", "lat", "lon"), "node_id").select("way_id", F.col("pos").cast("long").alias("pos"), "node_id", "lat", "lon")


@query("win_02_segment_numbers", f"WITH {WAYPOINTS} SELECT trip_id, seq, CAST(sum(CASE WHEN seq = 1 OR seq % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY trip_id ORDER BY seq) - 1 AS BIGINT) AS segment FROM waypoints")
def segment_numbers(spark, d):
    w = W.partitionBy("trip_id").orderBy("seq")
    cut = ((F.col("seq") == 1) | (F.col("seq") % 7 == 0)).cast("int")
    return waypoints(spark, d).select("trip_id", "seq", (F.sum(cut).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).alias("segment"))


@query("win_05_changes", f"WITH {EDGES}, l AS (SELECT src, dst, distance_m, road_class, lag(road_class) OVER (PARTITION BY src ORDER BY dst, distance_m) AS p FROM edges) SELECT src, dst, distance_m FROM l WHERE p IS NULL OR p <> road_class")
def changes(spark, d):
    before = F.lag("road_class").over(W.partitionBy("src").orderBy("dst", "distance_m"))
    return edges(spark, d).withColumn("p", before).where("p IS NULL OR p <> road_class").select("src", "dst", "distance_m")


@query("geo_13_halfway", f"""WITH {WAYPOINTS}, s AS (SELECT trip_id, seq, lat, lon, lead(lat) OVER w AS tlat, lead(lon) OVER w AS tlon FROM waypoints WINDOW w AS (PARTITION BY trip_id ORDER BY seq)),
l AS (SELECT *, 6371000.0::DOUBLE * 2 * atan2(sqrt(h), sqrt(1 - h)) AS leg FROM (SELECT *, pow(sin(radians(tlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(tlat)) * pow(sin(radians(tlon - lon) / 2), 2) AS h FROM s WHERE tlat IS NOT NULL)),
c AS (SELECT *, coalesce(sum(leg) OVER (PARTITION BY trip_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(leg) OVER (PARTITION BY trip_id) AS total FROM l),
f AS (SELECT * FROM c WHERE b <= total * 0.5 AND total * 0.5 <= b + leg QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY seq) = 1)
SELECT trip_id, round(lat + (tlat - lat) * (total * 0.5 - b) / leg, 6) AS lat, round(lon + (tlon - lon) * (total * 0.5 - b) / leg, 6) AS lon FROM f""")
def halfway(spark, d):
    out = lines.interpolate(waypoints(spark, d), "trip_id", 0.5)
    return out.select("trip_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("src_05_tag_value", f"SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 0 THEN {_value_sql(1)} END AS amenity FROM part")
def tag_value(spark, d):
    return _elements(spark, d).select("id", F.col("tags")["amenity"].alias("amenity"))


@query("src_07_value_category", f"SELECT p_partkey AS id, CASE {' '.join(f'WHEN v IN ({chr(44).join(repr(x) for x in vs)}) THEN {k!r}' for k, vs in TAG_CATEGORIES.items())} END AS category FROM (SELECT p_partkey, {_value_sql(5)} AS v FROM part)")
def value_category(spark, d):
    assert _VALUES
    return _elements(spark, d).select("id", ingest.tag_category(F.col("tags")["building"]).alias("category"))


@query("set_05_several_files", "SELECT count(*) AS n FROM (SELECT n_name FROM nation UNION ALL SELECT n_name FROM nation)")
def several_files(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet", f"{d}/nation.parquet").agg(F.count("n_name").alias("n"))


@query("til_07_zigzag", "SELECT event_id, CASE WHEN v < 0 THEN -v * 2 - 1 ELSE v * 2 END AS code FROM (SELECT event_id, event_id % 2001 - 1000 AS v FROM events)")
def zigzag(spark, d):
    from ..operators import tiles

    code = F.pandas_udf(lambda v: v.map(tiles.zigzag), "long")
    return table(spark, d, "events").select("event_id", code(F.col("event_id") % 2001 - 1000).alias("code"))


@query("til_02_tile_of_first_vertex", f"{_DOCS} SELECT doc_id, CAST(floor((lon + 180) / 360 * 1024) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 1024) AS BIGINT) AS y FROM docs")
def tile_of_first_vertex(spark, d):
    from ..operators import tiles

    rows = _docs(spark, d).select("doc_id", F.array(F.struct("lat", "lon")).alias("points"))
    return tiles.assigned(rows, 10, 10).select("doc_id", "x", "y")


@query("str_10_issue_type", f"SELECT o_orderkey, i IN {ISSUE_TYPES} AS known FROM (SELECT o_orderkey, {[*ISSUE_TYPES, 'odd']}[o_orderkey % 8 + 1] AS i FROM orders)")
def issue_type(spark, d):
    i = F.element_at(F.array(*[F.lit(x) for x in (*ISSUE_TYPES, "odd")]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", i.isin(*ISSUE_TYPES).alias("known"))


@query("dat_03_seconds_between", "SELECT user_id, event_id, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS DOUBLE) / 1e6 AS seconds FROM events")
def seconds_between(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("user_id", "event_id", ((us - F.lag(us).over(w)) / F.lit(1e6)).alias("seconds"))


@query("jsn_02_line_string", """SELECT user_id, '{"type":"LineString","coordinates":[[' || CAST(CAST(min(event_id) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(max(event_id) AS BIGINT) AS VARCHAR) || ']]}' AS geojson FROM events GROUP BY user_id""")
def line_string(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    return e.select("user_id", routing.line_string(F.array(F.struct(F.col("b").alias("lat"), F.col("a").alias("lon")))).alias("geojson"))


@query("bit_01_masks", "SELECT event_id, (event_id >> 3) & 7 AS field, event_id | 1 AS odd FROM events")
def masks(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.shiftright(k, 3).bitwiseAND(7).alias("field"), k.bitwiseOR(1).alias("odd"))


@query("ext_windows", "SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def windows(spark, d):
    """An addition: the tumbling windows of the streaming operators, over a finished table."""
    from ..streaming.trips import windowed_counts

    e = table(spark, d, "events").select("ts", F.col("event_type").alias("kind"))
    return windowed_counts(e.withColumn("ts", F.col("ts").cast("timestamp")), size="1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n")


@query("str_09_language_code", "SELECT doc_id, lower(lang) AS code FROM documents")
def language_code(spark, d):
    asked = F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", requests.language_code(asked).alias("code"))


@query("str_13_language_json", """SELECT doc_id, CASE WHEN lang IN ('en', 'fr', 'ar', 'sw', 'tw', 'yo') THEN '"' || lang || '"' ELSE '{"other":"' || lang || '"}' END AS tag FROM documents""")
def language_json(spark, d):
    return table(spark, d, "documents").select("doc_id", requests.language_json("lang").alias("tag"))


@query("til_11_archive_format", "SELECT p_partkey, CASE p_partkey % 8 WHEN 2 THEN 'png' WHEN 4 THEN 'webp' ELSE 'mvt' END AS format FROM part")
def archive_format(spark, d):
    return table(spark, d, "part").select("p_partkey", requests.archive_format(F.col("p_partkey") % 8).alias("format"))


@query("dat_04_rfc3339", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0'), '0') END || 'Z' AS t FROM events")
def rfc3339_text(spark, d):
    return table(spark, d, "events").select("event_id", requests.rfc3339("ts").alias("t"))


@query("src_13_tile_features", f"""WITH e AS (SELECT p_partkey AS k, p_partkey % 2 = 0 AS node, {_K(1)} AS tag, CAST(p_partkey % 140 - 70 AS DOUBLE) AS lat, CAST(p_partkey % 97 - 48 AS DOUBLE) AS lon,
    CASE WHEN p_partkey % 2 = 0 THEN 1 WHEN p_partkey % 5 = 0 THEN 1 WHEN p_partkey % 3 = 0 THEN 4 ELSE 2 END AS n FROM part),
f AS (SELECT *, CASE WHEN node THEN CASE WHEN tag IN ('place', 'amenity', 'natural') THEN 1 END WHEN n < 2 THEN NULL WHEN tag = 'highway' THEN 2 WHEN n = 4 AND tag IN ('building', 'natural', 'amenity', 'area') THEN 3 END AS kind,
    lat BETWEEN -35 AND 38 AND lon BETWEEN -25 AND 55 AS a, n > 1 AND lat + 1 BETWEEN -35 AND 38 AND lon BETWEEN -25 AND 55 AS b, n > 2 AND lat BETWEEN -35 AND 38 AND lon + 1 BETWEEN -25 AND 55 AS c FROM e)
SELECT row_number() OVER (ORDER BY node DESC, k) AS id, kind, CAST(n AS INTEGER) AS n_points, lat, lon FROM f WHERE kind IS NOT NULL AND (a OR b OR c)""")
def tile_features(spark, d):
    """Odd parts are ways of one, two or four positions, even ones nodes; some lie outside the region."""
    from ..operators import tiles

    k, node = F.col("p_partkey"), F.col("p_partkey") % 2 == 0
    lat, lon = (k % 140 - 70).cast("double"), (k % 97 - 48).cast("double")
    way = F.array(*[F.struct((lat + a).alias("lat"), (lon + b).alias("lon")) for a, b in ((0, 0), (1, 0), (0, 1), (0, 0))])
    n = F.when(k % 5 == 0, 1).when(k % 3 == 0, 4).otherwise(2)
    key = F.element_at(F.array(*[F.lit(x) for x in _KEYS]), (k % len(_KEYS) + 1).cast("int"))
    elements = table(spark, d, "part").select(
        F.when(node, "node").otherwise("way").alias("kind"), k.alias("id"), F.when(node, lat).alias("lat"), F.when(node, lon).alias("lon"),
        F.create_map(key, F.lit("yes")).alias("tags"), F.when(~node, F.slice(way, F.lit(1), n)).alias("points"))
    first = F.col("points")[0]
    return tiles.extract_features(elements).select("id", "kind", F.size("points").alias("n_points"), first["lat"].alias("lat"), first["lon"].alias("lon"))
