"""Queries of the road, penalty and speed operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import DEFAULT_SPEEDS, HIGHWAY_CLASS, PROFILE_SPEEDS, SURFACE_CLASS, SURFACE_FACTORS
from ..functions import road
from ..operators import lines, penalties, roads, spatial, speeds
from .registry import query, table
from .views import CONTRIBUTIONS, EDGES, NODES, WAYPOINTS, contributions, edges, haversine_sql, nodes, waypoints

_HIGHWAYS = [x for names in HIGHWAY_CLASS.values() for x in names] + ["steps", "proposed"]
_SURFACES = [x for names in SURFACE_CLASS.values() for x in names] + ["metal", "wood"]


def _pick(names, key):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (key % len(names) + 1).cast("int"))


def _pick_sql(names, key):
    return f"[{', '.join(repr(n) for n in names)}][{key} % {len(names)} + 1]"


def _case(value, groups, other):
    return "CASE " + " ".join(f"WHEN {value} IN ({', '.join(repr(n) for n in names)}) THEN {k}" for k, names in groups.items()) + f" ELSE {other} END"


@query("rte_01_road_class", f"SELECT p_partkey, h AS highway, {_case('h', HIGHWAY_CLASS, 'NULL')} AS road_class FROM (SELECT p_partkey, {_pick_sql(_HIGHWAYS, 'p_partkey')} AS h FROM part)")
def road_class(spark, d):
    t = table(spark, d, "part").select("p_partkey", _pick(_HIGHWAYS, F.col("p_partkey")).alias("highway"))
    return t.withColumn("road_class", road.road_class("highway"))


@query("rte_02_surface", f"SELECT p_partkey, h AS surface, {_case('h', SURFACE_CLASS, '3')} AS surface_class FROM (SELECT p_partkey, {_pick_sql(_SURFACES, 'p_partkey')} AS h FROM part)")
def surface(spark, d):
    t = table(spark, d, "part").select("p_partkey", _pick(_SURFACES, F.col("p_partkey")).alias("surface"))
    return t.withColumn("surface_class", road.surface_class("surface"))


_ACCESS = ["yes", "permissive", "no", "private", "designated", "customers"]


@query("rte_03_access", f"SELECT p_partkey, CASE WHEN h IN ('no', 'private') THEN 1 WHEN h = 'designated' THEN 2 ELSE 0 END AS access FROM (SELECT p_partkey, {_pick_sql(_ACCESS, 'p_partkey')} AS h FROM part)")
def access(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", road.access_class(_pick(_ACCESS, k)).alias("access"))


_ONEWAY = ["yes", "1", "true", "-1", "no", ""]


@query("rte_04_direction", f"SELECT p_partkey, CASE WHEN o = '-1' THEN -1 WHEN o IN ('yes', '1', 'true') OR p_partkey % 8 = 0 OR p_partkey % 17 = 0 THEN 1 ELSE 0 END AS direction FROM (SELECT p_partkey, {_pick_sql(_ONEWAY, 'p_partkey')} AS o FROM part)")
def direction(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", road.direction(_pick(_ONEWAY, k), k % 8, k % 17 == 0).alias("direction"))


_WAYS = "ways AS (SELECT DISTINCT row_no AS way_id FROM nodes), r AS (SELECT row_no AS way_id, col AS pos, node_id, lat, lon FROM nodes UNION ALL SELECT 1000000 + col, row_no, node_id, lat, lon FROM nodes WHERE col % 5 = 0)"


def _ways(spark, d):
    """Every grid row is a way, and so is every fifth column; they cross where both pass."""
    n = nodes(spark, d)
    row = n.select(F.col("row_no").alias("way_id"), F.col("col").alias("pos"), "node_id")
    col = n.where("col % 5 = 0").select((F.col("col") + 1_000_000).alias("way_id"), F.col("row_no").alias("pos"), "node_id")
    refs = F.transform(F.sort_array(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"])
    ways = row.unionByName(col).groupBy("way_id").agg(refs.alias("refs"))
    k = F.col("way_id")
    return ways.withColumn("tags", F.create_map(F.lit("highway"), _pick(_HIGHWAYS[:-2], k), F.lit("surface"), _pick(_SURFACES, k), F.lit("oneway"), _pick(["no", "yes", "-1"], k), F.lit("name"), F.concat(F.lit("Road "), k)))


_SEGMENTS = f"""WITH {NODES}, {_WAYS}, u AS (SELECT node_id, count(*) AS used FROM r GROUP BY node_id), n2 AS (SELECT way_id, count(*) AS n FROM r GROUP BY way_id HAVING count(*) >= 2),
s AS (SELECT r.*, lead(node_id) OVER w AS t, lead(lat) OVER w AS blat, lead(lon) OVER w AS blon, sum(CASE WHEN pos = (SELECT min(pos) FROM r q WHERE q.way_id = r.way_id) OR pos = (SELECT max(pos) FROM r q WHERE q.way_id = r.way_id) OR used >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY way_id ORDER BY pos) - 1 AS segment FROM r JOIN u USING (node_id) JOIN n2 USING (way_id) WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
p AS (SELECT way_id, segment, arg_min(node_id, pos) AS a, arg_max(t, pos) AS b, sum(12742000.0::DOUBLE * asin(sqrt(pow(sin(radians(blat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(blat)) * pow(sin(radians(blon - lon) / 2), 2)))) AS m FROM s WHERE t IS NOT NULL GROUP BY way_id, segment),
c AS (SELECT p.*, {_case(_pick_sql(_HIGHWAYS[:-2], 'way_id'), HIGHWAY_CLASS, 'NULL')} AS cls, way_id % 3 AS o FROM p),
e AS (SELECT *, CASE WHEN o = 2 THEN -1 WHEN o = 1 OR cls = 0 THEN 1 ELSE 0 END AS direction FROM c)"""


@query("rte_05_edges", f"""{_SEGMENTS} SELECT a AS src, b AS dst, way_id, CAST(segment AS BIGINT) AS segment, CAST(floor(m) AS BIGINT) AS distance_m FROM e WHERE direction >= 0 UNION ALL SELECT b, a, way_id, CAST(segment AS BIGINT), CAST(floor(m) AS BIGINT) FROM e WHERE direction <= 0""")
def build_edges(spark, d):
    e = roads.build_edges(roads.parse_ways(_ways(spark, d)), nodes(spark, d))
    return e.select("src", "dst", "way_id", "segment", "distance_m")


@query("rte_06_default_times", f"WITH {EDGES} SELECT src, dst, CAST(floor(distance_m / ([{', '.join(map(str, DEFAULT_SPEEDS))}][road_class + 1]::DOUBLE * 1000.0 / 3600.0) * 10.0) AS BIGINT) AS time_ds FROM edges")
def default_times(spark, d):
    return edges(spark, d).select("src", "dst", road.default_ds("distance_m", "road_class").alias("time_ds"))


@query("rte_07_flags", f"WITH {EDGES} SELECT src, dst, CAST(road_class + surface * 8 + oneway * 32 + (src % 3) * 128 + (dst % 3) * 512 + roundabout * 2048 AS INTEGER) AS flags, CAST(road_class AS INTEGER) AS road_class, CAST(surface AS INTEGER) AS surface, CAST(src % 3 AS INTEGER) AS foot, CAST(dst % 3 AS INTEGER) AS bicycle, CAST(roundabout AS INTEGER) AS roundabout FROM edges")
def flags(spark, d):
    e = edges(spark, d)
    packed = e.select("src", "dst", road.pack_flags(road_class=F.col("road_class"), surface=F.col("surface"), oneway=F.col("oneway"), foot=F.col("src") % 3, bicycle=F.col("dst") % 3, roundabout=F.col("roundabout")).alias("flags"))
    return packed.select("src", "dst", "flags", *[road.unpack_flag("flags", n).alias(n) for n in ("road_class", "surface", "foot", "bicycle", "roundabout")])


_WEIGHTS = " UNION ALL ".join(
    f"SELECT src, dst, '{p}' AS profile, CAST(CASE WHEN {'road_class <= 5' if p == 'car' else 'true' if p == 'motorcycle' else 'road_class >= 2 AND ' + ('src' if p == 'foot' else 'dst') + ' % 3 <> 1'} THEN floor(distance_m / ([{', '.join(map(str, v))}][road_class + 1]::DOUBLE * [{', '.join(map(str, SURFACE_FACTORS))}][surface + 1]::DOUBLE * 1000.0 / 3600.0) * 10.0) END AS BIGINT) AS weight_ds FROM edges"
    for p, v in PROFILE_SPEEDS.items())


@query("rte_08_profile_weights", f"WITH {EDGES} {_WEIGHTS}")
def profile_weights(spark, d):
    e = edges(spark, d)
    each = [F.struct(F.lit(p).alias("profile"), road.weight_ds(p, "distance_m", "road_class", "surface", 0, F.col("src") % 3, F.col("dst") % 3).alias("weight_ds")) for p in PROFILE_SPEEDS]
    return e.select("src", "dst", F.explode(F.array(*each)).alias("w")).select("src", "dst", "w.profile", "w.weight_ds")


@query("flt_12_accessible", f"WITH {EDGES} SELECT src, dst, road_class <= 5 AS car, true AS motorcycle, road_class >= 2 AND dst % 3 <> 1 AS bicycle, road_class >= 2 AND src % 3 <> 1 AS foot FROM edges")
def accessible(spark, d):
    return edges(spark, d).select("src", "dst", *[road.accessible(p, "road_class", 0, F.col("src") % 3, F.col("dst") % 3).alias(p) for p in ("car", "motorcycle", "bicycle", "foot")])


@query("rte_09_profiles", "SELECT profile, CAST(pos - 1 AS INTEGER) AS road_class, kmh FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS profile, unnest({list(v)}::DOUBLE[]) AS kmh, unnest(range(1, 9)) AS pos" for p, v in PROFILE_SPEEDS.items()) + ")")
def profiles(spark, d):
    return road.profile_table(spark)


@query("ord_07_profile_names", "SELECT unnest(['bicycle', 'car', 'foot', 'motorcycle']) AS profile, unnest(range(1, 5)) AS position")
def profile_names(spark, d):
    return spark.createDataFrame([(p, i + 1) for i, p in enumerate(road.profile_names())], "profile string, position long")


@query("agg_06_node_degree", f"WITH {EDGES} SELECT node_id, count(*) AS n FROM (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node_id")
def node_degree(spark, d):
    refs = edges(spark, d).select(F.array("src", "dst").alias("refs"))
    return roads.reference_counts(refs)


@query("set_02_referenced_nodes", f"WITH {EDGES} SELECT DISTINCT src AS node_id FROM edges UNION SELECT dst FROM edges")
def referenced_nodes(spark, d):
    return roads.reference_counts(edges(spark, d).select(F.array("src", "dst").alias("refs"))).select("node_id")


@query("src_11_nodes_of_ways", f"WITH {NODES}, {EDGES} SELECT node_id, lat, lon FROM nodes WHERE node_id IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
def nodes_of_ways(spark, d):
    return roads.referenced(nodes(spark, d).select("node_id", "lat", "lon"), edges(spark, d).select(F.array("src", "dst").alias("refs")))


@query("ord_04_edges_by_source", f"WITH {EDGES} SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst, distance_m) AS position FROM edges")
def edges_by_source(spark, d):
    from pyspark.sql import Window as W

    return edges(spark, d).select("src", "dst", F.row_number().over(W.partitionBy("src").orderBy("dst", "distance_m")).cast("long").alias("position"))


@query("join_07_is_edge", f"WITH {EDGES}, {CONTRIBUTIONS} SELECT id, src_node, dst_node FROM contributions c WHERE EXISTS (SELECT 1 FROM edges e WHERE e.src = c.src_node AND e.dst = c.dst_node)")
def is_edge(spark, d):
    return roads.along_edges(contributions(spark, d), edges(spark, d), "src_node", "dst_node").select("id", "src_node", "dst_node")


@query("win_01_steps", f"WITH {WAYPOINTS}, s AS (SELECT trip_id, seq, lat, lon, t_sec, lead(lat) OVER w AS tlat, lead(lon) OVER w AS tlon, lead(t_sec) OVER w AS tt FROM waypoints WINDOW w AS (PARTITION BY trip_id ORDER BY seq)), a AS (SELECT trip_id, seq, lat, lon FROM s), x AS (SELECT trip_id, seq, tt - t_sec AS seconds, 6371000.0::DOUBLE * 2 * atan2(sqrt(h), sqrt(1 - h)) AS m FROM (SELECT *, pow(sin(radians(tlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(tlat)) * pow(sin(radians(tlon - lon) / 2), 2) AS h FROM s WHERE tlat IS NOT NULL)) SELECT trip_id, seq, round(m, 3) AS metres, seconds FROM x")
def trip_steps(spark, d):
    return speeds.steps(waypoints(spark, d)).select("trip_id", "seq", F.round("metres", 3).alias("metres"), "seconds")


_LEGS = f"WITH {WAYPOINTS}, s AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM waypoints WINDOW w AS (PARTITION BY trip_id ORDER BY seq)), l AS (SELECT *, coalesce(6371000.0::DOUBLE * 2 * atan2(sqrt(h), sqrt(1 - h)), 0) AS leg FROM (SELECT *, pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2) AS h FROM s))"


@query("agg_07_trip_stats", f"{_LEGS} SELECT trip_id, CAST(floor(sum(leg)) AS BIGINT) AS distance_m, CAST(greatest(arg_max(t_sec, seq) - arg_min(t_sec, seq), 0) AS BIGINT) AS duration_s FROM l GROUP BY trip_id")
def trip_stats(spark, d):
    return speeds.trip_stats(waypoints(spark, d))


@query("win_03_running_distance", f"{_LEGS} SELECT trip_id, seq, round(sum(leg) OVER (PARTITION BY trip_id ORDER BY seq), 3) AS metres FROM l")
def running_distance(spark, d):
    return lines.measured(waypoints(spark, d), "trip_id").select("trip_id", "seq", F.round("upto", 3).alias("metres"))


@query("win_04_distance_before", f"{_LEGS} SELECT trip_id, seq, round(coalesce(sum(leg) OVER (PARTITION BY trip_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS metres FROM l")
def distance_before(spark, d):
    return lines.measured(waypoints(spark, d), "trip_id").select("trip_id", "seq", F.round("before", 3).alias("metres"))


_SAMPLES = f"""WITH {NODES}, {EDGES}, {WAYPOINTS}, c AS (SELECT w.trip_id, w.seq, n.node_id, {haversine_sql('w', 'n')} AS dist FROM waypoints w JOIN nodes n ON abs(n.lat - w.lat) <= 1000 / 111320.0 AND abs(n.lon - w.lon) <= 1000 / 111320.0),
s AS (SELECT trip_id, seq, arg_min(node_id, dist) AS node_id FROM c WHERE dist <= 1000 GROUP BY trip_id, seq),
y AS (SELECT w.*, node_id, lead(node_id) OVER o AS dst, lead(w.lat) OVER o AS tlat, lead(w.lon) OVER o AS tlon, lead(t_sec) OVER o AS tt FROM waypoints w JOIN s USING (trip_id, seq) WINDOW o AS (PARTITION BY trip_id ORDER BY seq)),
z AS (SELECT node_id AS src, dst, tt - t_sec AS sec, 6371000.0::DOUBLE * 2 * atan2(sqrt(h), sqrt(1 - h)) AS m FROM (SELECT *, pow(sin(radians(tlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(tlat)) * pow(sin(radians(tlon - lon) / 2), 2) AS h FROM y WHERE tlat IS NOT NULL)),
samples AS (SELECT src, dst, m / sec * 3.6 AS kmh FROM z WHERE src <> dst AND m >= 10 AND sec > 0 AND m / sec * 3.6 BETWEEN 1 AND 200 AND EXISTS (SELECT 1 FROM edges e WHERE e.src = z.src AND e.dst = z.dst))"""


def _samples(spark, d):
    w = waypoints(spark, d)
    snapped = w.join(spatial.snap(w, nodes(spark, d), ["trip_id", "seq"]).select("trip_id", "seq", "node_id"), ["trip_id", "seq"])
    return speeds.samples(snapped, edges(spark, d))


@query("rte_21_speed_samples", f"{_SAMPLES} SELECT src, dst, round(kmh, 6) AS kmh FROM samples")
def speed_samples(spark, d):
    return _samples(spark, d).select("src", "dst", F.round("kmh", 6).alias("kmh"))


_SPEEDS = f"{_SAMPLES}, speeds AS (SELECT src, dst, count(*) AS sample_count, avg(kmh) AS avg_kmh, median(kmh) AS median_kmh, list_sort(list(kmh))[least(CAST(ceil(count(*) * 0.85) AS BIGINT), count(*) - 1) + 1] AS p85_kmh FROM samples GROUP BY src, dst HAVING count(*) >= 3)"


@query("rte_22_segment_speeds", f"{_SPEEDS} SELECT src, dst, sample_count, round(avg_kmh, 6) AS avg_kmh, round(median_kmh, 6) AS median_kmh, round(p85_kmh, 6) AS p85_kmh FROM speeds")
def segment_speeds(spark, d):
    s = speeds.segment_speeds(_samples(spark, d))
    return s.select("src", "dst", "sample_count", *[F.round(c, 6).alias(c) for c in ("avg_kmh", "median_kmh", "p85_kmh")])


@query("agg_05_restored_samples", f"{_SPEEDS} SELECT src, dst, count(*) AS n, round(avg(kmh), 6) AS kmh FROM (SELECT src, dst, avg_kmh AS kmh, unnest(range(sample_count)) FROM speeds) GROUP BY src, dst")
def restored_samples(spark, d):
    r = speeds.restored(speeds.segment_speeds(_samples(spark, d)))
    return r.groupBy("src", "dst").agg(F.count("kmh").alias("n"), F.round(F.avg("kmh"), 6).alias("kmh"))


@query("agg_14_segment_counters", f"{_SAMPLES}, n AS (SELECT count(*) AS n FROM samples GROUP BY src, dst) SELECT count(*) AS segments, count(*) FILTER (n >= 3) AS with_enough FROM n")
def segment_counters(spark, d):
    return speeds.counters(_samples(spark, d))


_SLOW = f"{_SPEEDS}, x AS (SELECT DISTINCT src, dst, [{', '.join(map(str, PROFILE_SPEEDS['motorcycle']))}][road_class + 1]::DOUBLE AS expected FROM edges), slow AS (SELECT src, dst, least(expected / avg_kmh, 5.0) AS penalty FROM speeds JOIN x USING (src, dst) WHERE avg_kmh < 0.6 * expected)"


def _expected(spark, d):
    return edges(spark, d).select("src", "dst", road._at(PROFILE_SPEEDS["motorcycle"], "road_class").alias("expected_kmh")).distinct()


@query("agg_13_slow_penalties", f"{_SLOW} SELECT src, dst, round(penalty, 6) AS penalty FROM slow")
def slow_penalties(spark, d):
    p = penalties.from_speeds(speeds.segment_speeds(_samples(spark, d)), _expected(spark, d))
    return p.select("src", "dst", F.round("penalty", 6).alias("penalty"))


_REPORTS = f"""{CONTRIBUTIONS}, v AS (SELECT id, created_at, src_node AS src, dst_node AS dst, issue_type, CASE WHEN issue_type = 'road_closed' THEN 'Infinity'::DOUBLE WHEN issue_type = 'speed_wrong' THEN 1.5 WHEN issue_type IN ('wrong_turn', 'roundabout_error') THEN 1.2 END AS penalty FROM contributions),
b AS (SELECT * FROM v WHERE penalty IS NOT NULL UNION ALL SELECT id, created_at, dst, src, issue_type, penalty FROM v WHERE issue_type IN ('road_closed', 'speed_wrong')),
reported AS (SELECT src, dst, arg_max(penalty, (created_at, id)) AS penalty FROM b GROUP BY src, dst)"""


@query("rte_18_contribution_penalties", f"WITH {_REPORTS} SELECT src, dst, penalty FROM reported")
def contribution_penalties(spark, d):
    return penalties.from_contributions(contributions(spark, d))


@query("agg_12_penalty_merge", f"{_SLOW}, {_REPORTS} SELECT src, dst, round(max(penalty), 6) AS penalty FROM (SELECT * FROM reported UNION ALL SELECT src, dst, greatest(1.0, penalty) FROM slow) GROUP BY src, dst")
def penalty_merge(spark, d):
    slow = penalties.from_speeds(speeds.segment_speeds(_samples(spark, d)), _expected(spark, d))
    merged = penalties.merge(penalties.from_contributions(contributions(spark, d)), slow)
    return merged.select("src", "dst", F.when(F.col("penalty") == float("inf"), F.col("penalty")).otherwise(F.round("penalty", 6)).alias("penalty"))


@query("join_06_edge_penalty", f"WITH {EDGES}, {_REPORTS} SELECT e.src, e.dst, e.distance_m, coalesce(penalty, 1.0) AS penalty, coalesce(penalty, 1.0) = 'Infinity'::DOUBLE AS blocked FROM edges e LEFT JOIN reported r ON e.src = r.src AND e.dst = r.dst")
def edge_penalty(spark, d):
    return penalties.applied(edges(spark, d), penalties.from_contributions(contributions(spark, d))).select("src", "dst", "distance_m", "penalty", "blocked")


@query("rte_19_penalty_lookup", f"WITH {_REPORTS} SELECT count(*) AS n, count(*) FILTER (penalty = 'Infinity'::DOUBLE) AS blocked FROM reported")
def penalty_lookup(spark, d):
    return penalties.from_contributions(contributions(spark, d)).agg(F.count("penalty").alias("n"), F.count_if(F.col("penalty") == float("inf")).alias("blocked"))


@query("join_10_report_nodes", f"WITH {NODES}, {CONTRIBUTIONS}, p AS (SELECT id, n.lat + 0.0001 AS lat, n.lon AS lon FROM contributions c JOIN nodes n ON n.node_id = c.src_node), c AS (SELECT p.id, n.node_id, {haversine_sql('p', 'n')} AS dist FROM p JOIN nodes n ON abs(n.lat - p.lat) <= 1000 / 111320.0 AND abs(n.lon - p.lon) <= 1000 / 111320.0) SELECT id, arg_min(node_id, dist) AS node_id FROM c WHERE dist <= 1000 GROUP BY id")
def report_nodes(spark, d):
    n = nodes(spark, d)
    at = contributions(spark, d).select("id", F.col("src_node").alias("node_id")).join(n, "node_id").select("id", (F.col("lat") + 0.0001).alias("lat"), "lon")
    return spatial.snap(at, n, ["id"]).select("id", "node_id")
