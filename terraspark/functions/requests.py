"""Checks of requests, formats and displayed values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ISSUE_TYPES
from .geo import _c, valid_position

#: Languages that have a code of their own; any other is carried as it is named.
LANGUAGES = ("en", "fr", "ar", "sw", "tw", "yo")
#: Formats by the number that a tile archive's header gives its tiles; what isn't listed counts as mvt.
ARCHIVE_FORMATS = {1: "mvt", 2: "png", 4: "webp", 6: "mvt"}
LONGEST_QUERY, MOST_RESULTS, MOST_CELLS = 500, 50, 2500
#: Formats of tiles and their media types.
FORMATS = {"mvt": "application/vnd.mapbox-vector-tile", "pbf": "application/vnd.mapbox-vector-tile", "png": "image/png", "webp": "image/webp", "json": "application/json"}


def query_error(q) -> Column:
    """What is wrong with a search text, or null."""
    t = F.trim(F.coalesce(_c(q), F.lit("")))
    return F.when(t == "", "q is required").when(F.octet_length(t) > LONGEST_QUERY, "q is too long")


def limit(value, default: int = 5) -> Column:
    return F.least(F.coalesce(_c(value), F.lit(default)), F.lit(MOST_RESULTS))


def matrix_error(origins, destinations) -> Column:
    cells = _c(origins).cast("long") * _c(destinations)
    return F.when(cells == 0, "origins and destinations are required").when(cells > MOST_CELLS, "too many cells")


def report_error(issue_type, lat, lon, profile) -> Column:
    return F.when(~F.coalesce(_c(issue_type).isin(*ISSUE_TYPES), F.lit(False)), "unknown issue type").when(~valid_position(lat, lon), "bad position").when(F.trim(F.coalesce(_c(profile), F.lit(""))) == "", "profile is required")


def safe_tileset(name) -> Column:
    """No way out of the folder of tile sets."""
    n = _c(name)
    return (n != "") & ~n.contains("..") & ~n.contains("/") & ~n.contains("\\") & ~n.contains("\x00")


def media_type(extension) -> Column:
    out = F
    for k, v in FORMATS.items():
        out = out.when(_c(extension) == k, v)
    return out.otherwise(None)


def distance_text(metres) -> Column:
    m = _c(metres)
    return F.when(m < 1000, F.concat(F.floor(m + 0.5).cast("string"), F.lit("m"))).otherwise(F.format_string("%.1fkm", (m / 1000).cast("double")))


def duration_text(seconds) -> Column:
    s = _c(seconds)
    hours, minutes = F.floor(s / 3600).cast("long"), F.ceil(F.pmod(s, F.lit(3600)) / 60).cast("long")
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), F.lpad(minutes.cast("string"), 2, "0"), F.lit("m"))).otherwise(F.concat(minutes.cast("string"), F.lit("m")))


def first_hop(forwarded) -> Column:
    return F.trim(F.get(F.split(_c(forwarded), ","), F.lit(0)))


def language_code(name) -> Column:
    """A language's code in lower case, known or not; null stays null."""
    return F.lower(_c(name))


def language_json(name) -> Column:
    """A language as records carry it: its code, or an object that names another."""
    code = language_code(name)
    return F.when(code.isin(*LANGUAGES), F.concat(F.lit('"'), code, F.lit('"'))).otherwise(F.to_json(F.when(code.isNotNull(), F.struct(code.alias("other")))))


def archive_format(tile_type) -> Column:
    """The format of an archive's tiles; an unknown type counts as mvt."""
    out = F
    for k, v in ARCHIVE_FORMATS.items():
        out = out.when(_c(tile_type) == k, v)
    return out.otherwise("mvt")


def rfc3339(ts=None) -> Column:
    """A time, or now, as RFC 3339 text in UTC, with as many decimals of a second as it has."""
    t = F.current_timestamp() if ts is None else _c(ts).cast("timestamp")
    part = F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.rtrim(F.rtrim(part, F.lit("0")), F.lit(".")), F.lit("Z"))
