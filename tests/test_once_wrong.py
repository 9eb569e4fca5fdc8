"""Cases that went wrong once."""

import math
import random

import pytest

from terraspark.operators import routing, spatial
from terraspark.sources import stores


def metres(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 6_371_000 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_range_join_at_any_latitude(spark):
    rng = random.Random(6)
    points = [(lat + rng.uniform(0, 0.004), 20 + rng.uniform(0, 0.006)) for lat in (0, 37, -34, 62, -80) for _ in range(60)]
    points += [(37.0, 10.0), (37.0, 10.00055)]  # 48.9 m apart
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, lat double, lon double")
    out = spatial.range_join(df, df.withColumnRenamed("i", "j"), 50, boxed=False).where("i < j")
    got = {(r.i, r.j) for r in out.select("i", "j").collect()}
    want = {(i, j) for j, q in enumerate(points) for i, p in enumerate(points[:j]) if metres(p, q) <= 50}
    assert got == want and (len(points) - 2, len(points) - 1) in want


def test_ties_are_broken_alike_whatever_the_size(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(0, 5, 1, 100), (5, 9, 2, 100), (0, 2, 2, 7), (2, 9, 1, 7)]
    rows += [(rng.randrange(10, 40), rng.randrange(10, 40), rng.randint(1, 3), rng.randint(1, 99)) for _ in range(160)]
    edges = spark.createDataFrame([(*r, r[2]) for r in rows if r[0] != r[1]], "src long, dst long, cost long, distance_m long, time_ds long").cache()
    asked = spark.createDataFrame([(0, 0, 9)] + [(i, rng.randrange(10, 40), rng.randrange(10, 40)) for i in range(1, 25)], "request long, src long, dst long")
    pick = lambda: sorted((r.request, r.distance_m, r.time_ds, tuple(r.path or ())) for r in routing.shortest_paths(asked, edges).collect())
    small = pick()
    monkeypatch.setattr(routing, "MOST_EDGES", 1)
    assert pick() == small
    assert small[0] == (0, 14, 3, (0, 2, 9))


def test_relax_that_does_not_settle_is_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1, 1) for i in range(6)], "src long, dst long, cost long")
    with pytest.raises(RuntimeError):
        routing.relax(spark.createDataFrame([(0,)], "origin long"), edges, most_rounds=3)


def test_open_places_of_nothing(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    for where in ("missing", "empty"):
        out = stores.read_open_places(spark, str(tmp_path / where))
        assert out.count() == 0 and out.columns[0] == "place_id"


def test_long_ways_on_graphs_that_are_not_broadcast(spark, monkeypatch):
    """Two rows of 200 nodes in few blocks: a round for each edge of a way, as relax() has them, would be 200."""
    rows = [(i, i + 1, 3 + i % 5, 10) for i in range(399) if i != 199] + [(i, i + 200, 1 + i % 3, 7) for i in range(200)] + [(i + 200, i, 1 + i % 2, 9) for i in range(0, 200, 3)]
    edges = spark.createDataFrame([(*r, r[2]) for r in rows], "src long, dst long, cost long, distance_m long, time_ds long").cache()
    asked = spark.createDataFrame([(1, 0, 199), (2, 0, 399), (3, 150, 20), (4, 7, 7), (5, 0, 999), (6, 30, 390)], "request long, src long, dst long")
    pick = lambda **kw: sorted((r.request, r.distance_m, r.time_ds, tuple(r.path or ())) for r in routing.shortest_paths(asked, edges, **kw).collect())
    small = pick()
    assert [r[1] is None for r in small] == [False, False, True, False, True, False]

    def never(*_, **__):
        raise AssertionError("a round for each edge")

    monkeypatch.setattr(routing, "relax", never)
    monkeypatch.setattr(routing, "MOST_EDGES", 250)
    assert pick() == small
    assert pick(paths=False) == [(*r[:3], ()) for r in small]


def test_tiles_of_many_features_take_time_in_proportion():
    """Bytes appended to bytes are copied each time: the time grew with the square of a tile's features."""
    import hashlib
    import time

    from terraspark.operators import tiles

    def spent(n):
        features = [{"id": i, "kind": tiles.POINT, "points": [(5 + i % 100 / 50, i % 70 / 50)], "properties": [("name", f"{'place' * 20} {i}"), ("amenity", "bar")]} for i in range(n)]
        began = time.process_time()
        data = tiles.encode(features, 0, 0, 0)
        return time.process_time() - began, data

    few, small = spent(5_000)
    assert hashlib.md5(small).hexdigest() == "c0b080fe2246ba2ab42a1fcecba30dd7"
    many, _ = spent(80_000)
    assert many < 40 * few


def test_fuzzy_union_broadcasts_no_places(spark, tmp_path):
    """Files of like names are small, and what they hold isn't: it filled the driver."""
    from terraspark.operators import ingest

    spark.sql("SELECT id AS seq, 5.0 + id * 0.0002D AS lat, 0.0D AS lon, array(named_struct('lang', 'en', 'name', concat('Place ', id))) AS names FROM range(200)").write.parquet(str(tmp_path / "p"))
    plan = ingest.candidates(spark.read.parquet(str(tmp_path / "p")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
