"""Distances, bearings, boxes and tiles as column expressions. Angles are degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import AFRICA, EARTH_M, METRES_PER_DEGREE, TOLERANCES


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def haversine_m(lat1, lon1, lat2, lon2, radius: float = EARTH_M) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(radius) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2, EARTH_M / 1000)


def edge_length_m(lat1, lon1, lat2, lon2) -> Column:
    """Length of a road segment: the arcsine form."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(a))


def metres_to_degrees(metres) -> Column:
    """Without regard to latitude, as boxes are meant here."""
    return _c(metres) / F.lit(METRES_PER_DEGREE)


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing, 0 to 360."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    deg = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(deg + 360.0, F.lit(360.0))


def bearing_delta(delta) -> Column:
    """A turn in (-180, 180]."""
    m = F.pmod(_c(delta), F.lit(360.0))
    return F.when(m > 180, m - 360).otherwise(m)


def turn_class(delta) -> Column:
    d = _c(delta)
    side = F.when(d > 0, "right").otherwise("left")
    a = F.abs(d)
    return F.when(a <= 15, "straight").when(a <= 45, F.concat(F.lit("slight_"), side)).when(a <= 135, F.concat(F.lit("turn_"), side)).when(a <= 170, F.concat(F.lit("sharp_"), side)).otherwise("u_turn")


def in_box(lat, lon, box: tuple[float, float, float, float] = AFRICA) -> Column:
    """Inside (lon min, lat min, lon max, lat max), edges included."""
    return _c(lon).between(box[0], box[2]) & _c(lat).between(box[1], box[3])


def valid_position(lat, lon) -> Column:
    return F.coalesce(_c(lat).between(-90.0, 90.0) & _c(lon).between(-180.0, 180.0) & ~F.isnan(_c(lat)) & ~F.isnan(_c(lon)), F.lit(False))


def box_or_null(min_lon, min_lat, max_lon, max_lat) -> Column:
    """The box as a struct, null where it has no extent."""
    a, b, c, d = map(_c, (min_lon, min_lat, max_lon, max_lat))
    return F.when((a < c) & (b < d), F.struct(a.alias("min_lon"), b.alias("min_lat"), c.alias("max_lon"), d.alias("max_lat")))


def valid_tile(z, x, y) -> Column:
    z, x, y = map(_c, (z, x, y))
    side = F.pow(F.lit(2.0), z)
    return (z >= 0) & (z <= 22) & (x >= 0) & (y >= 0) & (x < side) & (y < side)


def _mercator_y(lat) -> Column:
    r = F.radians(_c(lat))
    return (1 - F.log(F.tan(r) + 1 / F.cos(r)) / F.lit(3.141592653589793)) / 2


def tile_xy(lat, lon, zoom) -> tuple[Column, Column]:
    """The slippy tile of a point, held inside the map."""
    n = F.pow(F.lit(2.0), _c(zoom))
    x = F.floor((_c(lon) + 180) / 360 * n)
    y = F.floor(_mercator_y(lat) * n)
    return tuple(F.greatest(F.lit(0).cast("long"), F.least(v.cast("long"), (n - 1).cast("long"))) for v in (x, y))


def tile_local(lat, lon, z, x, y, extent: int = 4096) -> tuple[Column, Column]:
    """Whole coordinates inside a tile, halves away from zero."""
    n = F.pow(F.lit(2.0), _c(z))
    px = ((_c(lon) + 180) / 360 * n - _c(x)) * extent
    py = (_mercator_y(lat) * n - _c(y)) * extent
    return F.round(px).cast("int"), F.round(py).cast("int")


def zoom_tolerance(zoom) -> Column:
    out = None
    for most, degrees in TOLERANCES:
        out = F.when(_c(zoom) <= most, degrees) if out is None else out.when(_c(zoom) <= most, degrees)
    return out.otherwise(TOLERANCES[-1][1])


def relation_box(relation, lat, lon, center_lat=None, center_lon=None, other_lat=None, other_lon=None) -> Column:
    """The box that a spatial relation to a landmark stands for.

    near: 200 m around it, beside: 50 m. behind, past and opposite: 100 m around a point 150 m from it on the line away
    from the centre (to the north without one). between: 100 m around the midpoint with the other landmark, or as near.
    """
    rel, lat, lon = _c(relation), _c(lat), _c(lon)
    null = F.lit(None).cast("double")
    clat, clon, olat, olon = (null if v is None else _c(v) for v in (center_lat, center_lon, other_lat, other_lon))
    dlat, dlon = lat - clat, lon - clon
    size = F.sqrt(dlat * dlat + dlon * dlon)
    away = 150.0 / METRES_PER_DEGREE
    known = clat.isNotNull() & clon.isNotNull() & (size > 0)
    beyond = rel.isin("behind", "past", "opposite")
    middle = (rel == "between") & olat.isNotNull() & olon.isNotNull()
    at_lat = F.when(beyond, F.when(known, lat + dlat / size * away).otherwise(lat + away)).when(middle, (lat + olat) / 2).otherwise(lat)
    at_lon = F.when(beyond, F.when(known, lon + dlon / size * away).otherwise(lon)).when(middle, (lon + olon) / 2).otherwise(lon)
    half = F.when(rel == "beside", 50.0).when(beyond | middle, 100.0).otherwise(200.0) / METRES_PER_DEGREE
    return F.struct((at_lon - half).alias("min_lon"), (at_lat - half).alias("min_lat"), (at_lon + half).alias("max_lon"), (at_lat + half).alias("max_lat"))
