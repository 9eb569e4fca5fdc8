"""Places from two kinds of sources, and their fuzzy union."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import TAG_CATEGORIES, TAG_PRIORITY
from ..functions import geo, text
from ..tables import materialise
from .graph import components
from .spatial import range_join

NEAR_M, SIMILAR = 50.0, 0.8
NAMES = "array<struct<lang:string,name:string>>"
ADDRESS = "struct<street:string,city:string,region:string,postcode:string,country:string>"


def address(street, city, region, postcode, country) -> Column:
    """A struct; null where street and city are missing and the country is missing or empty. A missing country is ''."""
    s, c, r, p, n = map(geo._c, (street, city, region, postcode, country))
    nothing = s.isNull() & c.isNull() & (F.coalesce(n, F.lit("")) == "")
    return F.when(~nothing, F.struct(s.alias("street"), c.alias("city"), r.alias("region"), p.alias("postcode"), F.coalesce(n, F.lit("")).alias("country")))


def wkt_point(wkt) -> Column:
    """(lat, lon) of POINT (lon lat), null for anything else."""
    number = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    pattern = rf"^\s*POINT\s*\(\s*{number}\s+{number}\s*\)\s*$"
    w = geo._c(wkt)
    return F.when(w.rlike(pattern), F.struct(F.regexp_extract(w, pattern, 2).cast("double").alias("lat"), F.regexp_extract(w, pattern, 1).cast("double").alias("lon")))


def tag_category(value) -> Column:
    return text._named(value, TAG_CATEGORIES)


def category_of_tags(tags) -> Column:
    """By the first of the priority tags whose value stands for a category."""
    t = geo._c(tags)
    return F.coalesce(*[tag_category(t[k]) for k in TAG_PRIORITY])


def _some(value: Column) -> Column:
    return F.when(value != "", value)


def names_of_tags(tags) -> Column:
    """name:en, name:fr, name:ar and name:sw in that order; the plain name before them, as en, unless one has its text. Empty names are none."""
    t = geo._c(tags)
    own = F.filter(F.array(*[F.struct(F.lit(lang).alias("lang"), _some(t[f"name:{lang}"]).alias("name")) for lang in ("en", "fr", "ar", "sw")]), lambda n: n["name"].isNotNull())
    plain = F.struct(F.lit("en").alias("lang"), t["name"].alias("name"))
    return F.when(_some(t["name"]).isNotNull() & ~F.exists(own, lambda n: n["name"] == t["name"]), F.concat(F.array(plain), own)).otherwise(own)


def address_of_tags(tags) -> Column:
    t = geo._c(tags)
    return address(t["addr:street"], t["addr:city"], t["addr:state"], t["addr:postcode"], t["addr:country"])


def open_places(rows: DataFrame) -> DataFrame:
    """Places of the open map release: rows (id, lat, lon, category, names.primary, addresses) inside the region, with a known category and a name.

    Columns that are missing are null. addresses may be a struct or a list of structs, whose first counts.
    """
    has = set(rows.columns)
    col = lambda c, kind: F.col(c) if c in has else F.lit(None).cast(kind)
    addr = rows.schema["addresses"].dataType.typeName() if "addresses" in has else None
    one = F.get("addresses", F.lit(0)) if addr == "array" else F.col("addresses") if addr else None
    fields = {f.name for f in (rows.schema["addresses"].dataType.elementType if addr == "array" else rows.schema["addresses"].dataType).fields} if addr else set()
    part = lambda *names: F.coalesce(*[one[n] for n in names if n in fields], F.lit(None).cast("string")) if addr else F.lit(None).cast("string")
    name = F.col("names")["primary"] if "names" in has else F.lit(None).cast("string")
    lat, lon = col("lat", "double"), col("lon", "double")
    kept = rows.where(lat.isNotNull() & lon.isNotNull() & geo.in_box(lat, lon) & (F.coalesce(name, F.lit("")) != "")).withColumn("__category", text.category_of(col("category", "string"))).where(F.col("__category").isNotNull())
    return kept.select(
        F.coalesce(col("id", "string"), F.concat(F.lit("overture-"), F.monotonically_increasing_id())).alias("place_id"), F.array(F.struct(F.lit("en").alias("lang"), name.alias("name"))).cast(NAMES).alias("names"), F.col("__category").alias("category"),
        lat.alias("lat"), lon.alias("lon"), address(part("street", "freeform"), part("locality", "city"), part("region"), part("postcode"), part("country")).cast(ADDRESS).alias("address"), F.lit("overture").alias("source"))


def tagged_places(elements: DataFrame) -> DataFrame:
    """Places of map nodes (id, lat, lon, tags): named, inside the region, of a known category."""
    t = F.col("tags")
    kept = elements.where((F.coalesce(t["name"], F.lit("")) != "") & geo.in_box("lat", "lon")).withColumn("category", category_of_tags(t)).where(F.col("category").isNotNull())
    return kept.select(F.concat(F.lit("node/"), "id").alias("place_id"), names_of_tags(t).cast(NAMES).alias("names"), "category", "lat", "lon", address_of_tags(t).cast(ADDRESS).alias("address"), F.lit("osm").alias("source"))


def candidates(places: DataFrame) -> DataFrame:
    """(a, b): places by seq, within twice the distance and with a pair of similar names.

    Whatever a place can be merged with, directly or by names gained in merging, is connected to it by such pairs: a
    group's members lie within the distance of its first place, so within twice of each other, and a match comes from
    one pair of names.
    """
    rows = places.select("seq", "lat", "lon", "names")
    pairs = range_join(rows, rows.withColumnsRenamed({"seq": "b", "names": "other"}), 2 * NEAR_M, boxed=False, merge=True).where(F.col("seq") < F.col("b"))
    close = F.exists("names", lambda x: F.exists("other", lambda y: text.levenshtein_similarity(x["name"], y["name"]) > SIMILAR))
    return pairs.where(close).select(F.col("seq").alias("a"), "b")


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _similar(a: list[dict], b: list[dict]) -> float:
    def score(x: str, y: str) -> float:
        x, y = x.lower(), y.lower()
        return 1.0 if not x and not y else 1 - _distance(x, y) / max(len(x), len(y))

    same = [score(x["name"], y["name"]) for x in a for y in b if x["lang"] == y["lang"]]
    return max(same) if same else score(a[0]["name"], b[0]["name"]) if a and b else 0.0


def merge_group(rows: list[dict]) -> list[dict]:
    """Places in the order of seq, those of the first source first as they are; each other one is merged into the first before it that is near and similar, or joins the list."""
    from math import atan2, cos, radians, sin, sqrt

    def metres(p: dict, q: dict) -> float:
        h = sin(radians(q["lat"] - p["lat"]) / 2) ** 2 + cos(radians(p["lat"])) * cos(radians(q["lat"])) * sin(radians(q["lon"] - p["lon"]) / 2) ** 2
        return 6_371_000.0 * 2 * atan2(sqrt(h), sqrt(1 - h))

    out: list[dict] = []
    for p in rows:
        p["names"], p["merged"] = [dict(n) for n in p["names"]], 1
        found = None if p["source"] == "overture" else next((q for q in out if metres(q, p) <= NEAR_M and _similar(q["names"], p["names"]) > SIMILAR), None)
        if found is None:
            out.append(p)
            continue
        found["merged"] += 1
        if found["address"] is None:
            found["address"] = p["address"]
        elif p["address"] is not None:
            found["address"] = found["address"] | {k: p["address"][k] for k in ("street", "city", "region", "postcode") if found["address"][k] is None}
        for n in p["names"]:
            if all(m["lang"] != n["lang"] for m in found["names"]):
                found["names"].append(n)
    return out


def union_places(first: DataFrame, second: DataFrame, order: str = "place_id") -> DataFrame:
    """The fuzzy union of two sources of places; columns of places and merged, how many rows each stands for.

    Rows are taken in the order of `order`, all of the first source before the second. Only groups of connected
    candidates are handled one place after another, in a task each; places without a candidate stay as they are. (A
    group is a cluster of places of like names within 100 m steps, whatever the size of the data.)
    """
    both = first.select(F.lit(0).alias("__turn"), "*").unionByName(second.select(F.lit(1).alias("__turn"), "*"))
    key = F.struct("__turn", order)
    # Numbers that follow the order, without one task sorting all: the sort is by range, and the offsets add up.
    ranged = both.withColumn("__key", key).repartitionByRange("__key").sortWithinPartitions("__key").drop("__turn", "__key")
    rows = materialise(ranged.withColumn("seq", F.monotonically_increasing_id()), "places")
    links = materialise(candidates(rows), "place-links")
    groups = components(links).withColumnsRenamed({"node": "seq", "root": "group"})
    # Sorted numbers and like names take little room in files, by which Spark would choose to broadcast them.
    marked = rows.join(groups.hint("merge"), "seq", "left")
    single = marked.where("group IS NULL").drop("seq", "group").withColumn("merged", F.lit(1))
    together = marked.where("group IS NOT NULL").groupBy("group").agg(F.sort_array(F.collect_list(F.struct("seq", *rows.drop("seq").columns))).alias("rows"))
    schema = single.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for group in batch["rows"]:
                own = [{k: v for k, v in dict(r).items() if k != "seq"} | {"names": [dict(n) for n in r["names"]], "address": None if r["address"] is None else dict(r["address"])} for r in group]
                out += merge_group(own)
            yield pd.DataFrame(out, columns=schema.names)

    return single.unionByName(together.select("rows").mapInPandas(run, schema))


def summary(places: DataFrame) -> DataFrame:
    return places.groupBy("source").agg(F.count(F.lit(1)).alias("places"), F.sum("merged").alias("rows"), F.count_if(F.col("address").isNotNull()).alias("with_address"))
