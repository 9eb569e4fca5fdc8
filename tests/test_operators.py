"""Golden values and properties of single operators."""

import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terraspark.functions import geo, road, text
from terraspark.operators import graph, ingest, instructions, routing, tiles
from terraspark.sources import osmpbf, pmtiles, stores
from terraspark.streaming import ratelimit, trips


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_geo_goldens(spark):
    x, y = geo.tile_xy(F.lit(5.603), F.lit(-0.187), F.lit(10))
    r = one(spark, x, y, geo.haversine_m(5.6037, -0.1870, 6.6885, -1.6244), geo.bearing(0.0, 0.0, 1.0, 0.0), geo.bearing(0.0, 0.0, 0.0, 1.0), geo.bearing(1.0, 0.0, 0.0, 0.0))
    assert (r[0], r[1]) == (511, 496)
    assert abs(r[2] - 199_500) < 1_000
    assert [round(v) for v in r[3:]] == [0, 90, 180]


def test_flags_round_trip(spark):
    rows = [(c, s, o, a, b, r) for c in range(8) for s in range(4) for o in (0, 1) for a in range(3) for b in (0, 2) for r in (0, 1)]
    df = spark.createDataFrame(rows, "c int, s int, o int, a int, b int, r int")
    packed = df.withColumn("f", road.pack_flags(road_class=F.col("c"), surface=F.col("s"), oneway=F.col("o"), foot=F.col("a"), bicycle=F.col("b"), roundabout=F.col("r")))
    out = packed.select("c", "s", "o", "a", "b", "r", *[road.unpack_flag("f", n).alias(n) for n in ("road_class", "surface", "oneway", "foot", "bicycle", "roundabout")]).collect()
    assert all(tuple(x[:6]) == tuple(x[6:]) for x in out)


def test_text_goldens(spark):
    r = one(spark, text.full_address(F.lit("123 Main St"), F.lit("Accra"), F.lit("Greater Accra"), F.lit("00233"), F.lit("Ghana")), text.tokens(F.lit("L'Église,  N°5")), text.strip_diacritics(F.lit("café naïve")), text.arabic(F.lit("مُحَمَّد أحمد")), text.french_elision(F.lit("l'église")))
    assert r[0] == "123 Main St, Accra, Greater Accra, 00233, Ghana"
    assert r[1] == ["l", "église", "n", "5"]
    assert (r[2], r[3], r[4]) == ("cafe naive", "محمد احمد", "église")
    assert text.phonetic_code("smith") == text.phonetic_code("smyth") and text.phonetic_code("") == ""
    assert text.phonetic_code("Thomas") == "0MS" and text.phonetic_code("Xavier") == "KSFR" and text.phonetic_code("nation") == "NXN"


def test_parse(spark):
    p = one(spark, text.parse_query(F.lit("shop near MTN mast, Osu, Accra"), F.lit("en")), text.parse_query(F.lit("Oxford Street, Osu"), F.lit(None).cast("string")), text.parse_query(F.lit("hôtel près de la gare"), F.lit("fr")), text.parse_query(F.lit(""), F.lit("en")))
    assert (p[0].neighborhood, p[0].city, p[0].relation, p[0].landmark) == ("Osu", "Accra", "near", "MTN mast")
    assert (p[1].street, p[1].city, p[1].tokens) == ("Oxford Street", "Osu", [])
    assert (p[2].relation, p[2].landmark) == ("near", "la gare")
    assert p[3].tokens == [] and p[3].landmark is None


def _place(i, name, lat, lon, source, lang="en", addr=None):
    return (i, [(lang, name)], "market", lat, lon, addr, source)


PLACE = "place_id string, names array<struct<lang:string,name:string>>, category string, lat double, lon double, address struct<street:string,city:string,region:string,postcode:string,country:string>, source string"


def test_union_is_the_greedy_one(spark):
    rng = np.random.default_rng(3)
    names = ["Makola Market", "Makola Markt", "Central Hospital", "Central Hospitl", "Osu Mosque", "Makola Marke"]
    make = lambda n, s: [_place(f"{s}{i:03d}", names[rng.integers(6)], float(5 + rng.integers(12) * 0.0002), float(0.1 + rng.integers(3) * 0.0002), s, ["en", "fr"][rng.integers(2)], None if rng.integers(2) else (None, "Accra", None, str(i), "GH")) for i in range(n)]
    a, b = make(12, "overture"), make(60, "osm")
    out = ingest.union_places(spark.createDataFrame(a, PLACE), spark.createDataFrame(b, PLACE)).collect()
    keys = ("place_id", "names", "category", "lat", "lon", "address", "source")
    fields = ("street", "city", "region", "postcode", "country")
    rows = [dict(zip(keys, r, strict=True)) | {"names": [{"lang": x, "name": y} for x, y in r[1]], "address": None if r[5] is None else dict(zip(fields, r[5], strict=True))} for r in a + b]
    want = {r["place_id"]: r for r in ingest.merge_group(rows)}
    assert {r.place_id for r in out} == set(want) and 0 < len(out) < 72
    for r in out:
        w = want[r.place_id]
        assert r.merged == w["merged"] and [(n.lang, n.name) for n in r.names] == [(n["lang"], n["name"]) for n in w["names"]]
        assert (None if r.address is None else r.address.asDict()) == w["address"]


def test_merge_keeps_what_is_there():
    a = {"names": [{"lang": "en", "name": "Osu Market"}], "lat": 5.0, "lon": 0.0, "address": {"street": None, "city": "Accra", "region": None, "postcode": None, "country": ""}, "source": "overture"}
    b = {"names": [{"lang": "en", "name": "osu market"}, {"lang": "fr", "name": "Marché"}], "lat": 5.0001, "lon": 0.0, "address": {"street": "S", "city": "Tema", "region": None, "postcode": "1", "country": "GH"}, "source": "osm"}
    (m,) = ingest.merge_group([a, b])
    assert m["address"] == {"street": "S", "city": "Accra", "region": None, "postcode": "1", "country": ""}
    assert [n["lang"] for n in m["names"]] == ["en", "fr"] and m["lat"] == 5.0


def _edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, cost long, distance_m long, time_ds long")


def test_paths(spark):
    line = [(i, i + 1, 10, 100, 10) for i in range(9)] + [(i + 1, i, 10, 100, 10) for i in range(9)]
    r = {x.request: x for x in routing.shortest_paths(spark.createDataFrame([("a", 0, 9), ("b", 4, 4), ("c", 0, 77), ("d", None, 3)], "request string, src long, dst long"), _edges(spark, line)).collect()}
    assert (r["a"].distance_m, len(r["a"].path)) == (900, 10)
    assert (r["b"].distance_m, r["b"].time_ds, r["b"].path) == (0, 0, [4])
    assert r["c"].distance_m is None and r["d"].path is None
    detour = [(0, 1, 500, 500, 500), (0, 2, 100, 3000, 100), (2, 1, 100, 500, 100)]
    assert routing.shortest_paths(spark.createDataFrame([(1, 0, 1)], "request int, src long, dst long"), _edges(spark, detour)).first().path == [0, 2, 1]


def test_relaxation_agrees_with_search(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b), int(c), int(c), int(c)) for a, b, c in zip(rng.integers(0, 30, 90), rng.integers(0, 30, 90), rng.integers(1, 50, 90), strict=True) if a != b]
    e = _edges(spark, rows)
    asked = spark.createDataFrame([(f"{o}-{t}", o, t) for o in (0, 7) for t in range(30)], "request string, src long, dst long")
    want = {(r.src, r.dst): r.time_ds for r in routing.shortest_paths(asked, e).collect() if r.time_ds is not None}
    got = {(r.origin, r.node): r.cost for r in routing.relax(spark.createDataFrame([(0,), (7,)], "origin long"), e).collect()}
    assert {k: v for k, v in want.items()} == {k: v for k, v in got.items() if k in want} and set(want) <= set(got)


def test_paths_of_graphs_that_are_not_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), int(c), int(c) * 2, int(c)) for a, b, c in zip(rng.integers(0, 20, 60), rng.integers(0, 20, 60), rng.integers(1, 50, 60), strict=True) if a != b]
    asked = spark.createDataFrame([(f"{a}-{b}", a, b) for a in (0, 3) for b in range(21)] + [("none", None, 4)], "request string, src long, dst long")
    small = {r.request: r for r in routing.shortest_paths(asked, _edges(spark, rows)).collect()}
    monkeypatch.setattr(routing, "MOST_EDGES", 1)
    large = {r.request: r for r in routing.shortest_paths(asked, _edges(spark, rows)).collect()}
    assert set(small) == set(large)
    for k, r in small.items():
        assert (r.time_ds, r.distance_m, r.path is None) == (large[k].time_ds, large[k].distance_m, large[k].path is None)


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (110, 2))] + [(i, i + 1) for i in range(500, 560)] + [(900, 900)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    want = {x: find(x) for x in up if x != 900}
    assert {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _seg(points, road, metres, around=False):
    return {"geometry": [{"lat": a, "lon": b} for a, b in points], "road_name": road, "distance_m": metres, "roundabout": around}


def test_roundabout_instructions():
    s = [_seg([(0, 0), (0.01, 0)], "A", 100), _seg([(0.01, 0), (0.011, 0.001)], None, 10, True), _seg([(0.011, 0.001), (0.01, 0.002)], None, 12, True), _seg([(0.01, 0.002), (0, 0.002)], "B", 50)]
    out = instructions.instructions(s)
    assert [x["type"] for x in out] == ["depart", "roundabout", out[2]["type"], "arrive"] and out[2]["type"] != "roundabout"
    assert out[1]["exit"] == 1 and out[1]["road"] == "B" and out[1]["distance_m"] == 100
    assert out[2]["distance_m"] == 22 and out[3]["distance_m"] == 50
    assert instructions.instructions([]) == []
    assert [x["type"] for x in instructions.instructions([_seg([(0, 0)], "A", 5)])] == ["depart", "arrive"]


def test_tile_commands_and_archive(tmp_path, spark):
    zz = tiles.zigzag
    assert tiles.commands(tiles.LINE, [(0, 0), (10, 10), (20, 10)]) == [9, 0, 0, 18, zz(10), zz(10), zz(10), zz(0)]
    assert tiles.commands(tiles.LINE, [(0, 0)]) == [] and tiles.commands(tiles.POLYGON, [(0, 0), (1, 1)]) == []
    assert [tiles.hilbert(1, x, y) for x, y in ((0, 0), (0, 1), (1, 1), (1, 0))] == [1, 2, 3, 4] and tiles.hilbert(0, 0, 0) == 0
    assert len({tiles.hilbert(4, x, y) for x in range(16) for y in range(16)}) == 256
    f = spark.createDataFrame([(1, tiles.POINT, [(5.603, -0.187)], {"name": "x"}), (2, tiles.LINE, [(5.6, -0.18), (5.61, -0.17)], {})], "id long, kind int, points array<struct<lat:double,lon:double>>, properties map<string,string>")
    made = tiles.tiles(f, 0, 10)
    out = {(r.z, r.x, r.y): r for r in made.collect()}
    data = bytes(out[10, 511, 496].data)
    ((number, layer),) = osmpbf.fields(data)
    parts = list(osmpbf.fields(layer))
    assert number == 3 and dict(parts)[1] == b"default" and dict(parts)[5] == 4096 and dict(parts)[15] == 2 and (3, b"name") in parts
    n = pmtiles.write(made, str(tmp_path / "t.pmtiles"))
    read = pmtiles.read(str(tmp_path / "t.pmtiles"))
    assert n == len(read) == len(out) and read[tiles.hilbert(10, 511, 496)] == data
    with pytest.raises(ValueError):
        pmtiles.write(made.where("z > 99"), str(tmp_path / "none.pmtiles"))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(-1, 1), st.floats(-1, 1)), min_size=3, max_size=30))
def test_simplified_keeps_ends_and_nearness(points):
    p = np.array(points)
    keep = tiles.simplified(p, 0.05)
    assert keep[0] and keep[-1]
    at = np.flatnonzero(keep)
    for a, b in zip(at, at[1:], strict=False):
        d = p[b] - p[a]
        size = math.hypot(*d)
        for i in range(a + 1, b):
            gap = abs(d[0] * (p[i, 1] - p[a, 1]) - d[1] * (p[i, 0] - p[a, 0])) / size if size else math.hypot(*(p[i] - p[a]))
            assert gap <= 0.05 + 1e-9


def _message(*parts):
    out = b""
    for number, v in parts:
        out += tiles.varint(number << 3) + tiles.varint(v) if isinstance(v, int) else tiles._field(number, v)
    return out


def _packed(values, signed=True, steps=False):
    last, out = 0, b""
    for v in values:
        d = v - last if steps else v
        last = v
        out += tiles.varint(((d << 1) ^ (d >> 63)) if signed else d)
    return out


def test_map_extract(spark, tmp_path):
    import struct
    import zlib

    strings = [b"", b"name", b"Osu", b"highway", b"primary", b"amenity", b"bank"]
    table = b"".join(tiles._field(1, s) for s in strings)
    dense = _message((1, _packed([10, 11], steps=True)), (8, _packed([56000000, 56100000], steps=True)), (9, _packed([-1870000, -1860000], steps=True)), (10, _packed([1, 2, 5, 6, 0, 0], signed=False)))
    way = _message((1, 77), (2, _packed([3], signed=False)), (3, _packed([4], signed=False)), (8, _packed([10, 11], steps=True)))
    block = _message((1, table), (2, _message((2, dense))), (2, _message((3, way))))
    body = _message((2, len(block)), (3, zlib.compress(block)))
    head = _message((1, b"OSMData"), (3, len(body)))
    (tmp_path / "x.osm.pbf").write_bytes(struct.pack(">I", len(head)) + head + body)
    osmpbf.register(spark)
    rows = {(r.kind, r.id): r for r in spark.read.format("osmpbf").option("path", str(tmp_path)).load().collect()}
    assert abs(rows["node", 10].lat - 5.6) < 1e-9 and rows["node", 10].tags == {"name": "Osu", "amenity": "bank"} and rows["node", 11].tags == {}
    assert rows["way", 77].refs == [10, 11] and rows["way", 77].tags == {"highway": "primary"}


def test_features_of_an_extract(spark, tmp_path):
    import struct

    strings = [b"", b"highway", b"primary", b"amenity", b"bank", b"building", b"yes"]
    table = b"".join(tiles._field(1, s) for s in strings)
    place = lambda values: _packed([round(v * 1e7) for v in values], steps=True)
    dense = _message((1, _packed([9, 8, 7], steps=True)), (8, place([5.6, 60.0, 5.7])), (9, place([-0.1, -0.1, -0.2])), (10, _packed([3, 4, 0, 3, 4, 0, 0], signed=False)))
    way = lambda i, key, lats, lons: _message((1, i), (2, _packed([key], signed=False)), (3, _packed([key + 1], signed=False)), (9, place(lats)), (10, place(lons)))
    ways = [way(1, 1, [50.0, 5.0], [0.0, 0.0]), way(2, 5, [5.0, 5.1, 5.1, 5.0], [0.0, 0.0, 0.1, 0.0]), way(3, 1, [5.0], [0.0]), way(4, 5, [5.0, 5.1], [0.0, 0.0]), way(5, 1, [50.0, 51.0], [0.0, 0.0])]
    block = _message((1, table), (2, _message((2, dense))), (2, _message(*[(3, w) for w in ways])), (2, _message((3, _message((1, 6), (2, _packed([1], signed=False)), (3, _packed([2], signed=False)))))))
    body = _message((1, block))
    head = _message((1, b"OSMData"), (3, len(body)))
    (tmp_path / "x.osm.pbf").write_bytes(struct.pack(">I", len(head)) + head + body)
    osmpbf.register(spark)
    rows = tiles.extract_features(spark.read.format("osmpbf").option("path", str(tmp_path)).load()).orderBy("id").collect()
    # The bank inside, the road with one end inside and the closed building; ids count on from 1.
    assert [(r.id, r.kind, [(round(p.lat, 6), round(p.lon, 6)) for p in r.points]) for r in rows] == [
        (1, tiles.POINT, [(5.6, -0.1)]), (2, tiles.LINE, [(50.0, 0.0), (5.0, 0.0)]), (3, tiles.POLYGON, [(5.0, 0.0), (5.1, 0.0), (5.1, 0.1), (5.0, 0.0)])]


def test_numbered_over_partitions(spark):
    from terraspark.tables import numbered

    rows = numbered(spark.range(500).repartition(7).withColumn("by", -F.col("id")), ["by"], "n").collect()
    assert sorted((r.n, r.by) for r in rows) == [(i + 1, i - 499) for i in range(500)]


def test_tile_archives_of_a_folder(spark, tmp_path):
    from terraspark.sources import tilearchive

    tilearchive.register(spark)
    load = lambda where: spark.read.format("tilearchive").load(str(where))
    assert load(tmp_path / "none").count() == 0 and load(tmp_path).count() == 0
    rows = [(7, i, 3, tiles.hilbert(7, i, 3), bytes([i % 256]) * 9) for i in range(128)] + [(0, 0, 0, 0, b"all")]
    made = spark.createDataFrame(rows, "z int, x long, y long, tile_id long, data binary")
    pmtiles.write(made, str(tmp_path / "one.pmtiles"))
    ids = spark.createDataFrame([(tiles.hilbert(8, x, y), 8, b"%d" % (x * y)) for x in range(0, 256) for y in range(0, 80)], "tile_id long, z int, data binary")
    assert pmtiles.write(ids, str(tmp_path / "two.pmtiles")) == 20_480
    got = load(tmp_path).cache()
    assert sorted((r.z, r.x, r.y, r.tile_id, bytes(r.data)) for r in got.where("tileset = 'one'").collect()) == sorted(rows)
    two = got.where("tileset = 'two'").collect()
    assert len(two) == 20_480 and all(bytes(r.data) == b"%d" % (r.x * r.y) and r.z == 8 and r.format == "mvt" for r in two)
    assert load(tmp_path / "one.pmtiles").count() == 129
    assert all(tiles.tile_of(tiles.hilbert(z, x, y)) == (z, x, y) for z in range(6) for x in range(2**z) for y in range(2**z))


def test_now_and_languages(spark):
    from terraspark.functions import requests

    r = one(spark, text.rfc3339_seconds(requests.rfc3339()) - F.unix_micros(F.current_timestamp()) / F.lit(1e6), *[requests.language_json(F.lit(x).cast("string")) for x in ("FR", "De", None)])
    assert abs(r[0]) < 1e-3 and r[1:] == ('"fr"', '{"other":"de"}', None)


def test_stores(spark, tmp_path):
    trip = [("t1", "car", "2026-01-01T00:00:00+01:00", None, [(5.0, 0.0, "2026-01-01T00:00:00+01:00", None, None), (5.001, 0.0, "2026-01-01T00:00:30+01:00", None, None)])]
    df = spark.createDataFrame(trip, stores.TRIPS)
    stores.save_json(df, str(tmp_path / "trips"))
    stores.save_json(df.withColumn("ended_at", F.lit("2026-01-01T00:01:00+01:00")), str(tmp_path / "trips"))
    back = stores.read_trips(spark, str(tmp_path / "trips"))
    assert back.count() == 1 and back.first().ended_at is not None
    w = stores.waypoints(back).orderBy("seq").collect()
    assert w[1].t_sec - w[0].t_sec == 30
    assert stores.save_table(df, str(tmp_path / "p")) and not stores.save_table(df, str(tmp_path / "p")) and stores.save_table(df, str(tmp_path / "p"), force=True)
    assert stores.read_table(spark, str(tmp_path / "nothing"), stores.SPEEDS).count() == 0


def test_open_places(spark, tmp_path):
    rows = [("a", 5.0, 0.1, "bank", ("Bank A",), [("1 St", "Accra", "GH")]), (None, 5.0, 0.1, "atm", ("B",), None), ("c", 60.0, 0.1, "bank", ("C",), None), ("d", 5.0, 0.1, "unknown", ("D",), None), ("e", None, 0.1, "bank", ("E",), None), ("f", 5.0, 0.1, "bank", ("",), None)]
    spark.createDataFrame(rows, "id string, lat double, lon double, category string, names struct<primary:string>, addresses array<struct<freeform:string,locality:string,country:string>>").write.parquet(str(tmp_path / "o"))
    out = {r.place_id: r for r in stores.read_open_places(spark, str(tmp_path / "o")).collect()}
    assert len(out) == 2 and out["a"].address.city == "Accra" and out["a"].category == "bank"
    bare = spark.createDataFrame([(5.0, 0.1, "bank", ("Z",))], "lat double, lon double, category string, names struct<primary:string>")
    assert ingest.open_places(bare).first().address is None


def test_lifecycle_stream_equals_batch(spark, tmp_path):
    rows = [(t, i, k, 1) for t in ("a", "b", "c") for i, k in enumerate(["start", "update", "end", "update"] if t != "c" else ["update", "start", "end", "end"])]
    df = spark.createDataFrame(rows, "trip_id string, seq long, kind string, points long").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    q = trips.lifecycle(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("life").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("life").collect()))
    assert got == sorted(map(tuple, trips.lifecycle_batch(df).collect()))
    assert [r[3] for r in got if r[0] == "c"] == [404, 200, 200, 409] and [r[3] for r in got if r[0] == "a"] == [200, 200, 200, 409]


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = [(k, i, float(i // 3), 60) for k in ("x", "y") for i in range(200)]
    df = spark.createDataFrame(rows, "key string, seq long, t_sec double, rpm int").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    q = ratelimit.limit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("calls").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("calls").collect()))
    assert got == sorted(map(tuple, ratelimit.limit_batch(df).collect()))
    allowed = [r[2] for r in got if r[0] == "x"]
    assert all(allowed[:60]) and not all(allowed)


def test_windows_stream(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2026, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=i), "click", i % 2) for i in range(0, 600, 7)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string, user_id long").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, work in (("tumbling", trips.windowed_counts), ("sessions", trips.sessions)):
        q = work(read()).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert spark.table("tumbling").agg(F.sum("n")).first()[0] > 0


def test_learning_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 30.0)] * 3, "src long, dst long, kmh double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = trips.learn(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "store")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3
    assert os.path.isdir(tmp_path / "store")
