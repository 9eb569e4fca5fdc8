"""Vector tiles of map features.

A feature lies in the one tile of its first vertex, at every zoom, unclipped. Tiles are encoded a partition at a time,
feature by feature: what a task holds is the tile's bytes and its keys and values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AREA_KEYS, LINE_KEYS, POINT_KEYS, TILE_PROPERTIES, TOLERANCES
from ..functions import geo
from ..tables import numbered

EXTENT, LAYER = 4096, "default"
POINT, LINE, POLYGON = 1, 2, 3


def point_class(tags) -> Column:
    """Whether a node with these tags (map) is shown."""
    return F.arrays_overlap(F.map_keys(geo._c(tags)), F.array(*[F.lit(k) for k in POINT_KEYS]))


def way_class(tags, closed) -> Column:
    """2 line, 3 polygon or null, by the first tag (of an array of (key, value), in order) that decides; area=yes closes where no other does."""
    t, closed = geo._c(tags), geo._c(closed)
    kind = F.transform(t, lambda x: F.when(x["key"].isin(*LINE_KEYS), LINE).when(x["key"].isin(*AREA_KEYS) & closed, POLYGON))
    first = F.get(F.filter(kind, lambda k: k.isNotNull()), F.lit(0))
    return F.coalesce(first, F.when(closed & F.exists(t, lambda x: x["key"] == "area"), POLYGON))


def properties(tags) -> Column:
    return F.map_filter(geo._c(tags), lambda k, v: k.isin(*TILE_PROPERTIES))


def extract_features(elements: DataFrame) -> DataFrame:
    """(id, kind, points, properties) of an extract's elements (kind, id, lat, lon, tags, points) that are shown on tiles.

    These are nodes of a shown kind inside the region, and ways of a shown kind that carry positions of two nodes or
    more, one of them inside. A way of four nodes or more whose last lies on its first is closed. Ids count from 1,
    nodes before ways and by their own ids, so they do not depend on how the extract was read.
    """
    node, tags, points = F.col("kind") == "node", F.col("tags"), F.col("points")
    at = F.when(node, F.array(F.struct("lat", "lon"))).otherwise(points)
    closed = (F.size(points) >= 4) & (F.get(points, F.lit(0)) == F.get(points, F.size(points) - 1))
    shown = F.when(node, F.when(point_class(tags), POINT)).when((F.col("kind") == "way") & (F.size(points) >= 2), way_class(F.map_entries(tags), closed))
    inside = F.exists("at", lambda p: geo.in_box(p["lat"], p["lon"]))
    rows = elements.select("id", F.col("kind").alias("element"), shown.alias("kind"), at.alias("points"), at.alias("at"), properties(tags).alias("properties"))
    kept = rows.where(F.col("kind").isNotNull() & inside).drop("at").withColumnRenamed("id", "own")
    return numbered(kept, ["element", "own"], "id").select("id", "kind", "points", "properties")


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points a line keeps: those further than the tolerance from the chord of what is kept around them (Ramer, Douglas, Peucker), without recursion."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    spans = [(0, len(points) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        p, q, mid = points[a], points[b], points[a + 1 : b]
        chord = q - p
        size = math.hypot(*chord)
        gap = np.abs(chord[0] * (mid[:, 1] - p[1]) - chord[1] * (mid[:, 0] - p[0])) / size if size else np.hypot(*(mid - p).T)
        i = int(gap.argmax())
        if gap[i] > tolerance:
            at = a + 1 + i
            keep[at] = True
            spans += [(a, at), (at, b)]
    return keep


def tolerance(zoom: int) -> float:
    return next((d for most, d in TOLERANCES if zoom <= most), TOLERANCES[-1][1])


_SHORT = [bytes([n]) for n in range(128)]


def varint(n: int) -> bytes:
    if 0 <= n < 128:
        return _SHORT[n]
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def zigzag(n: int) -> int:
    return (n << 1) ^ (n >> 63)


def _field(number: int, payload: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return varint(number << 3) + varint(value)


def commands(kind: int, points: list[tuple[int, int]]) -> list[int]:
    """The command stream of a geometry; empty where a line has under two points or a polygon under three."""
    if len(points) < kind:
        return []
    out, x, y = [], 0, 0

    def go(to: tuple[int, int]) -> None:
        nonlocal x, y
        out.extend((zigzag(to[0] - x), zigzag(to[1] - y)))
        x, y = to

    out.append(1 | (len(points) if kind == POINT else 1) << 3)
    for p in points if kind == POINT else points[:1]:
        go(p)
    if kind != POINT:
        out.append(2 | (len(points) - 1) << 3)
        for p in points[1:]:
            go(p)
    if kind == POLYGON:
        out.append(7 | 1 << 3)
    return out


def local(lat: float, lon: float, z: int, x: int, y: int) -> tuple[int, int]:
    n = 2**z
    r = math.radians(lat)
    px = ((lon + 180) / 360 * n - x) * EXTENT
    py = ((1 - math.log(math.tan(r) + 1 / math.cos(r)) / math.pi) / 2 * n - y) * EXTENT
    return tuple(int(math.copysign(math.floor(abs(v) + 0.5), v)) for v in (px, py))


class Tile:
    """A tile of one layer that features are added to; keys and values are numbered as they come up."""

    def __init__(self, z: int, x: int, y: int) -> None:
        self.at, self.keys, self.values, self.body, self.features = (z, x, y), {}, {}, bytearray(), 0

    def add(self, id_: int, kind: int, points: list[tuple[float, float]], properties: list[tuple[str, str]]) -> None:
        z, x, y = self.at
        if kind != POINT and len(points) > 2:
            keep = simplified(np.array(points, float), tolerance(z))
            points = [p for p, k in zip(points, keep, strict=True) if k] if keep.sum() >= 2 else points
        self.features += 1
        if kind == POINT and len(points) == 1:
            px, py = local(*points[0], z, x, y)
            stream = b"\x09" + varint(zigzag(px)) + varint(zigzag(py))
        else:
            stream = b"".join(map(varint, commands(kind, [local(lat, lon, z, x, y) for lat, lon in points])))
        if not stream:
            return
        keys, values, tags = self.keys, self.values, b""
        for k, v in properties:
            tags += varint(keys.setdefault(k, len(keys))) + varint(values.setdefault(v, len(values)))
        if tags:
            tags = b"\x12" + varint(len(tags)) + tags
        row = b"\x08" + varint(id_) + tags + b"\x18" + varint(kind) + b"\x22" + varint(len(stream)) + stream
        self.body += b"\x12" + varint(len(row)) + row

    def data(self) -> bytes:
        """Empty where no feature has a geometry. Nothing can be added afterwards."""
        if not self.body:
            return b""
        layer = bytearray(_field(1, LAYER.encode()))
        layer += self.body
        self.body = bytearray()
        for k in self.keys:
            layer += _field(3, k.encode())
        for v in self.values:
            layer += _field(4, _field(1, v.encode()))
        layer += _number(5, EXTENT) + _number(15, 2)
        return b"".join((varint(3 << 3 | 2), varint(len(layer)), layer))


def encode(features: list[dict], z: int, x: int, y: int) -> bytes:
    """A tile of features (id, kind, points [(lat, lon)], properties)."""
    tile = Tile(z, x, y)
    for f in features:
        tile.add(f["id"], f["kind"], f["points"], f["properties"])
    return tile.data()


def assigned(features: DataFrame, min_zoom: int = 0, max_zoom: int = 14) -> DataFrame:
    """features (id, kind, points array of (lat, lon), properties map) with z, x, y of their tile at each zoom."""
    z = F.explode(F.sequence(F.lit(max(0, min_zoom)), F.lit(min(max_zoom, 14))))
    rows = features.where(F.size("points") > 0).withColumn("z", z)
    x, y = geo.tile_xy(F.col("points")[0]["lat"], F.col("points")[0]["lon"], F.col("z"))
    return rows.withColumns({"x": x, "y": y})


def tiles(features: DataFrame, min_zoom: int = 0, max_zoom: int = 14) -> DataFrame:
    """(z, x, y, tile_id, data, features): encoded tiles with something in them. Rows come to a task sorted by tile and feature id, and a tile is encoded as its rows stream by."""
    order = ["z", "x", "y"]
    dealt = assigned(features, min_zoom, max_zoom).withColumn("props", F.array_sort(F.map_entries("properties"))).select(*order, "id", "kind", "points", "props").repartition(*order).sortWithinPartitions(*order, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: Tile | None = None
        made: list[tuple] = []

        def finish() -> None:
            if tile and (data := tile.data()):
                made.append((*tile.at, hilbert(*tile.at), data, tile.features))

        def out() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], k) for i, k in enumerate(kinds)], names=["z", "x", "y", "tile_id", "data", "features"])
            made.clear()
            return batch

        def lists(column: pa.Array, *fields: str) -> tuple[list[int], list[tuple]]:
            """Where each row's pairs begin (and the last end), and all pairs."""
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy()).tolist()
            pairs = column.flatten()
            columns = pairs.flatten()
            return [0, *ends], list(zip(*(columns[pairs.type.get_field_index(f)].to_pylist() for f in fields), strict=True))

        for batch in batches:
            z, x, y, ids, kinds = (batch.column(c).to_pylist() for c in range(5))
            (first, points), (begin, props) = lists(batch.column(5), "lat", "lon"), lists(batch.column(6), "key", "value")
            for i, at in enumerate(zip(z, x, y, strict=True)):
                if tile is None or at != tile.at:
                    finish()
                    tile = Tile(*at)
                tile.add(ids[i], kinds[i], points[first[i] : first[i + 1]], props[begin[i] : begin[i + 1]])
            if made:
                yield out()
        finish()
        if made:
            yield out()

    return dealt.mapInArrow(run, "z int, x long, y long, tile_id long, data binary, features long")


def hilbert(z: int, x: int, y: int) -> int:
    """The number of a tile along the Hilbert curves of all zooms, one after another."""
    base, d, side = (4**z - 1) // 3, 0, 2**z
    s = side // 2
    while s:
        rx, ry = int(bool(x & s)), int(bool(y & s))
        d += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
        s //= 2
    return base + d


def tile_of(number: int) -> tuple[int, int, int]:
    """The zoom, x and y of a tile by its number; hilbert() backwards."""
    z = ((3 * number + 1).bit_length() - 1) // 2
    rest, x, y = number - (4**z - 1) // 3, 0, 0
    for level in range(z):
        side = 1 << level
        rx, ry = rest >> 1 & 1, (rest ^ rest >> 1) & 1
        if not ry:
            if rx:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
        x, y, rest = x + side * rx, y + side * ry, rest >> 2
    return z, x, y


def tile_json(made: DataFrame, name: str, url: str) -> DataFrame:
    """One row: the description of a tile set."""
    return made.agg(F.to_json(F.struct(F.lit("3.0.0").alias("tilejson"), F.lit(name).alias("name"), F.array(F.lit(f"{url}/v1/tiles/{name}/{{z}}/{{x}}/{{y}}.pbf")).alias("tiles"), F.min("z").alias("minzoom"), F.max("z").alias("maxzoom"))).alias("tilejson"))


def fetch(made: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (z, x, y, extension) with status (200, 400 for a bad format or place, 404) and data."""
    ok = F.col("extension").isin("mvt", "pbf") & geo.valid_tile("z", "x", "y")
    rows = wanted.join(made.select("z", "x", "y", "data"), ["z", "x", "y"], "left")
    return rows.withColumn("status", F.when(~ok, 400).when(F.col("data").isNull(), 404).otherwise(200)).withColumn("data", F.when(F.col("status") == 200, F.col("data")))
