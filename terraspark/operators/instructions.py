"""Turn instructions along a route."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import atan2, cos, degrees, radians, sin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRAIGHT, SLIGHT, TURN, SHARP = 15.0, 45.0, 135.0, 170.0


def _heading(s: dict) -> float:
    """Of the first two points, 0 with fewer."""
    g = s["geometry"]
    if len(g) < 2:
        return 0.0
    a, b, d = radians(g[0]["lat"]), radians(g[1]["lat"]), radians(g[1]["lon"] - g[0]["lon"])
    return degrees(atan2(sin(d) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(d))) % 360


def _turn(by: float) -> str:
    size, side = abs(by), "right" if by > 0 else "left"
    for most, name in ((STRAIGHT, "straight"), (SLIGHT, f"slight_{side}"), (TURN, f"turn_{side}"), (SHARP, f"sharp_{side}")):
        if size <= most:
            return name
    return "u_turn"


def instructions(segments: list[dict]) -> list[dict]:
    """Of segments (geometry, road_name, distance_m, roundabout) in order.

    The first is the departure. A plain segment makes an instruction when its road differs from the one before or it
    turns by over 15 degrees; the instruction carries the way since the last one. A run of roundabout segments is one
    instruction: its exit counts changes of name within the run and the way out, and is 1 at least; the segment after it
    is then judged against the run's last. The arrival carries what is left.
    """
    if not segments:
        return []
    made: list[dict] = []
    head, road, way = _heading(segments[0]), segments[0]["road_name"], segments[0]["distance_m"]

    def say(kind: str, name: str | None, bearing: float, exit_: int | None = None) -> None:
        made.append({"type": kind, "exit": exit_, "road": name, "distance_m": float(way), "bearing": bearing})

    say("depart", road, head)
    at = 1
    for around, run in groupby(segments[1:], key=lambda s: bool(s["roundabout"])):
        part = list(run)
        entry, at = at - 1, at + len(part)
        out = segments[at] if at < len(segments) else None
        if around:
            names = sum(a["road_name"] != b["road_name"] for a, b in zip(part, part[1:], strict=False))
            bearing = _heading(part[-1]) if out else head
            say("roundabout", (out or segments[entry])["road_name"], bearing, max(1, names + (out is not None)))
            way, head, road = sum(s["distance_m"] for s in part), bearing, part[-1]["road_name"] if out else None
            continue
        for s in part:
            bearing = _heading(s)
            by = (bearing - head) % 360
            by = by - 360 if by > 180 else by
            if s["road_name"] != road or abs(by) > STRAIGHT:
                say(_turn(by), s["road_name"], bearing)
                way = 0
            way, head, road = way + s["distance_m"], bearing, s["road_name"]
    say("arrive", segments[-1]["road_name"], _heading(segments[-1]))
    return made


def along(segments: DataFrame) -> DataFrame:
    """(request, position, type, exit, road, distance_m, bearing) of path segments (request, seq, geometry, road_name, distance_m, roundabout)."""
    whole = segments.groupBy("request").agg(F.sort_array(F.collect_list(F.struct("seq", "geometry", "road_name", "distance_m", "roundabout"))).alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r, i, x["type"], x["exit"], x["road"], x["distance_m"], x["bearing"]) for r, s in zip(batch["request"], batch["s"], strict=True) for i, x in enumerate(instructions(list(s)))]
            yield pd.DataFrame(rows, columns=["request", "position", "type", "exit", "road", "distance_m", "bearing"]).astype({"exit": "Int64"})

    kind = dict(segments.dtypes)["request"]
    return whole.mapInPandas(run, f"request {kind}, position long, type string, exit long, road string, distance_m double, bearing double")
