"""Road tags, edge flags and travel profiles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ACCESS_CLASS, DEFAULT_SPEEDS, HIGHWAY_CLASS, PROFILE_SPEEDS, SURFACE_CLASS, SURFACE_FACTORS
from .geo import _c

MOST = 4_294_967_295
#: (lowest bit, bits) of each field of an edge's flags.
FLAGS = {"road_class": (0, 3), "surface": (3, 2), "oneway": (5, 1), "seasonal": (6, 1), "foot": (7, 2), "bicycle": (9, 2), "roundabout": (11, 1)}


def _class(value, groups: dict[int, tuple[str, ...]], other) -> Column:
    out = F
    for k, names in groups.items():
        out = out.when(_c(value).isin(*names), k)
    return out.otherwise(other)


def road_class(highway) -> Column:
    """0 to 7; null where the way is no road."""
    return _class(highway, HIGHWAY_CLASS, None)


def surface_class(surface) -> Column:
    return _class(surface, SURFACE_CLASS, 3)


def access_class(access) -> Column:
    return _class(access, ACCESS_CLASS, 0)


def direction(oneway, road, roundabout) -> Column:
    """1 forward only, -1 backward only, 0 both."""
    tag = _c(oneway)
    forward = tag.isin("yes", "1", "true") | (_c(road) == 0) | _c(roundabout)
    return F.when(tag == "-1", -1).when(F.coalesce(forward, F.lit(False)), 1).otherwise(0)


def pack_flags(**fields) -> Column:
    out = F.lit(0)
    for name, (low, bits) in FLAGS.items():
        out = out.bitwiseOR(F.shiftleft(_c(fields.get(name, 0)).cast("int").bitwiseAND(F.lit((1 << bits) - 1)), low))
    return out


def unpack_flag(flags, name: str) -> Column:
    low, bits = FLAGS[name]
    return F.shiftright(_c(flags), low).bitwiseAND(F.lit((1 << bits) - 1))


def _at(values: tuple[float, ...], index) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), _c(index).cast("int") + 1)


def travel_ds(distance_m, speed_kmh) -> Column:
    """Tenths of a second, cut off; the largest unsigned number at no speed."""
    speed = _c(speed_kmh)
    return F.when(speed <= 0, F.lit(MOST)).otherwise(F.least(F.floor(_c(distance_m) / (speed * 1000.0 / 3600.0) * 10.0).cast("long"), F.lit(MOST)))


def default_ds(distance_m, road) -> Column:
    return travel_ds(distance_m, _at(DEFAULT_SPEEDS, road))


def accessible(profile: str, road, seasonal=0, foot=0, bicycle=0) -> Column:
    open_ = _c(seasonal) == 0
    road = _c(road)
    if profile == "car":
        return open_ & (road <= 5)
    if profile == "motorcycle":
        return open_
    return open_ & (road >= 2) & (_c(foot if profile == "foot" else bicycle) != 1)


def weight_ds(profile: str, distance_m, road, surface, seasonal=0, foot=0, bicycle=0) -> Column:
    """Travel time on an edge, null where it is closed to the profile."""
    speed = _at(PROFILE_SPEEDS[profile], road)
    return F.when(accessible(profile, road, seasonal, foot, bicycle) & (speed > 0), travel_ds(distance_m, speed * _at(SURFACE_FACTORS, surface)))


def profile_table(spark):
    """(profile, road_class, kmh) of all profiles."""
    rows = [(p, list(v)) for p, v in PROFILE_SPEEDS.items()]
    return spark.createDataFrame(rows, "profile string, v array<double>").select("profile", F.posexplode("v").alias("road_class", "kmh"))


def profile_names() -> list[str]:
    return sorted(PROFILE_SPEEDS)
