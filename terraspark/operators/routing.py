"""Shortest paths, matrices and routes on a road graph.

A graph that fits a checked size is broadcast as adjacency arrays, and requests are answered by a search from each
distinct origin; origins are dealt out over the cluster. A larger graph is searched in blocks of nodes of near ids
(operators.blocks). relax() finds the ways from some origins to all nodes by rounds of joins, an edge a round.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import new_path, remove
from . import blocks

#: Edges of a graph that is broadcast: five numbers of 8 bytes each, 80 MB on the driver and in each Python worker.
MOST_EDGES = 2_000_000


@dataclass
class Graph:
    """Edges by source; nodes are numbered by their place in `ids`."""

    ids: np.ndarray
    first: np.ndarray
    target: np.ndarray
    weight: np.ndarray
    distance: np.ndarray
    time: np.ndarray

    @classmethod
    def of(cls, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, distance: np.ndarray, time: np.ndarray) -> Graph:
        order = np.lexsort((distance, weight, dst, src))
        ids = np.unique(np.concatenate([src, dst]))
        at = np.searchsorted(ids, src[order])
        return cls(ids, np.searchsorted(at, np.arange(len(ids) + 1)), np.searchsorted(ids, dst[order]), weight[order], distance[order], time[order])

    def number(self, node: int) -> int | None:
        i = int(np.searchsorted(self.ids, node))
        return i if i < len(self.ids) and self.ids[i] == node else None

    def search(self, origin: int) -> Search:
        return Search(self, origin)


class Search:
    """From a node's number, as far as it is asked for. Of ways of equal weight the one with the lower node before the end stays, then before that one, and so on."""

    def __init__(self, graph: Graph, origin: int) -> None:
        self.graph, self.origin = graph, origin
        self.best, self.before, self.sums = {origin: 0}, {}, {}
        self.queue = [(0, origin)]

    def find(self, wanted: set[int]) -> None:
        """Goes on until all of them are settled or nothing is left."""
        g, best, before, done = self.graph, self.best, self.before, self.sums
        left = len(wanted - done.keys())
        while self.queue and left:
            cost, node = heapq.heappop(self.queue)
            if node in done:
                continue
            if node == self.origin:
                done[node] = (0, 0)
            else:
                at, edge = before[node]
                done[node] = (done[at][0] + int(g.distance[edge]), done[at][1] + int(g.time[edge]))
            left -= node in wanted
            for edge in range(g.first[node], g.first[node + 1]):
                there, total = int(g.target[edge]), cost + int(g.weight[edge])
                had = best.get(there, total + 1)
                if there not in done and (total < had or (total == had and node < before[there][0])):
                    best[there], before[there] = total, (node, edge)
                    heapq.heappush(self.queue, (total, there))

    def path(self, node: int) -> list[int]:
        """Nodes (ids) on the way to one that is settled."""
        out = [node]
        while node != self.origin:
            node = self.before[node][0]
            out.append(node)
        return self.graph.ids[out[::-1]].tolist()


def weighted(edges: DataFrame) -> DataFrame:
    """edges (src, dst, weight_ds, distance_m, penalty) that are open, with cost: the weight times the penalty, cut off."""
    return edges.where("weight_ds IS NOT NULL AND penalty < double('Infinity')").select("src", "dst", F.floor(F.col("weight_ds") * F.col("penalty")).cast("long").alias("cost"), "distance_m", F.col("weight_ds").alias("time_ds"))


def shortest_paths(requests: DataFrame, edges: DataFrame, paths: bool = True) -> DataFrame:
    """(request, src, dst, distance_m, time_ds, path) for requests (request, src, dst) on weighted edges.

    path are the nodes on the way; without paths they are null, and nothing grows with the ways' lengths. Distance and
    time are without penalties. A request from a node to itself has zeros; one that can't be met has nulls. Edges beyond
    MOST_EDGES aren't broadcast: they are searched in blocks.
    """
    n = edges.count()
    if n > MOST_EDGES:
        return _by_blocks(requests, edges, paths, -(-n // min(MOST_EDGES, blocks.EDGES)))
    columns = ("src", "dst", "cost", "distance_m", "time_ds")
    t = edges.select(*columns).toArrow()
    graph = Graph.of(*(t[c].to_numpy() for c in columns))
    shared = requests.sparkSession.sparkContext.broadcast(graph)
    per = requests.select("request", F.col("src").cast("long"), F.col("dst").cast("long")).repartition("src").sortWithinPartitions("src")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        at = search = None  # an origin's requests may come in several batches
        for batch in batches:
            rows = []
            for src, group in batch.groupby("src", dropna=False):
                here = None if pd.isna(src) else g.number(int(src))
                if here is not None and here != at:
                    at, search = here, g.search(here)
                ends = {int(x): g.number(int(x)) for x in group["dst"].dropna()}
                if here is not None:
                    search.find({v for v in ends.values() if v is not None})
                for request, dst in zip(group["request"], group["dst"], strict=True):
                    if not pd.isna(dst) and not pd.isna(src) and int(src) == int(dst):
                        rows.append((request, src, dst, 0, 0, [int(src)] if paths else None))
                    elif not pd.isna(dst) and here is not None and (hit := search.sums.get(ends[int(dst)])) is not None:
                        rows.append((request, src, dst, *hit, search.path(ends[int(dst)]) if paths else None))
                    else:
                        rows.append((request, src, dst, None, None, None))
            yield pd.DataFrame(rows, columns=["request", "src", "dst", "distance_m", "time_ds", "path"]).astype({"src": "Int64", "dst": "Int64", "distance_m": "Int64", "time_ds": "Int64"})

    kind = dict(requests.dtypes)["request"]
    return per.mapInPandas(run, f"request {kind}, src long, dst long, distance_m long, time_ds long, path array<long>")


def relax(origins: DataFrame, edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(origin, node, cost, path) from every origin (origin) to all nodes it reaches, for graphs of any size.

    Each round only what improved in the one before moves on, and all origins advance together. Of ways of equal cost
    the one with the lower node before the end stays, then before that one, and so on, as in Graph.search. What doesn't
    settle in most_rounds is an error.
    """
    spark = origins.sparkSession
    schema = "origin long, node long, cost long, path array<long>"

    def write(df: DataFrame) -> str:
        path = new_path(spark, "relax")
        df.select("origin", "node", "cost", "path").write.parquet(path)
        return path

    def least(df: DataFrame) -> DataFrame:
        best = F.min(F.struct("cost", F.reverse("path").alias("back"))).alias("b")
        return df.groupBy("origin", "node").agg(best).select("origin", "node", "b.cost", F.reverse("b.back").alias("path"))

    read = lambda path: spark.read.schema(schema).parquet(path)
    o = F.col("origin").cast("long")
    known = front = write(origins.select(o.alias("origin"), o.alias("node"), F.lit(0).cast("long").alias("cost"), F.array(o).alias("path")).distinct())
    out = edges.groupBy("src", "dst").agg(F.min("cost").alias("by")).withColumnRenamed("src", "node")
    for _ in range(most_rounds):
        moved = read(front).join(out, "node").where(~F.array_contains("path", F.col("dst"))).select("origin", F.col("dst").alias("node"), (F.col("cost") + F.col("by")).alias("cost"), F.concat("path", F.array("dst")).alias("path"))
        had = read(known).select("origin", "node", F.struct("cost", F.reverse("path").alias("back")).alias("had"))
        now = F.struct("cost", F.reverse("path").alias("back"))
        better = write(least(moved).join(had, ["origin", "node"], "left").where(F.col("had").isNull() | (now < F.col("had"))))
        if read(better).isEmpty():
            break
        merged = write(least(read(known).unionByName(read(better))))
        if front != known:
            remove(spark, front)
        remove(spark, known)
        known, front = merged, better
    else:
        raise RuntimeError("ways did not settle")
    return read(known)


def _by_blocks(requests: DataFrame, edges: DataFrame, paths: bool, count: int) -> DataFrame:
    """shortest_paths() on a graph in so many blocks; lengths are those of the least costly edge between two nodes."""
    asked = requests.select("request", F.col("src").cast("long"), F.col("dst").cast("long"))
    ways = asked.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()
    found = blocks.search(ways, edges.select("src", "dst", "cost", "distance_m", "time_ds"), count, paths)
    same = F.col("src") == F.col("dst")
    zero = F.when(same, F.lit(0).cast("long"))
    own = F.when(same, F.array("src")) if paths else F.lit(None).cast("array<long>")
    return asked.join(found, ["src", "dst"], "left").select("request", "src", "dst", F.coalesce("distance_m", zero).alias("distance_m"), F.coalesce("time_ds", zero).alias("time_ds"), F.coalesce("path", own).alias("path"))


def matrix(origins: DataFrame, destinations: DataFrame, edges: DataFrame) -> DataFrame:
    """(origin, destination, distance_m, duration_s) for all pairs of origins and destinations (name, node_id); nulls where either has no node or there is no way. Seconds are cut off."""
    o = origins.select(F.col("name").alias("origin"), F.col("node_id").alias("src"))
    pairs = o.crossJoin(destinations.select(F.col("name").alias("destination"), F.col("node_id").alias("dst")))
    asked = pairs.select(F.struct("origin", "destination").alias("request"), "src", "dst")
    keyed = asked.withColumn("request", F.to_json("request"))
    kinds = asked.schema["request"].dataType.simpleString()
    out = shortest_paths(keyed, edges, paths=False)
    return out.select(F.from_json("request", kinds).alias("r"), "distance_m", F.floor(F.col("time_ds") / 10).cast("long").alias("duration_s")).select("r.origin", "r.destination", "distance_m", "duration_s")


def path_segments(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(request, seq, src, dst, distance_m, road_name, roundabout, geometry) of the edges along paths; of parallel edges the least costly."""
    legs = paths.where("path IS NOT NULL").select("request", F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))).alias("a"), F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0))).alias("b"))).alias("seq", "leg"))
    one = edges.groupBy("src", "dst").agg(F.min_by(F.struct("distance_m", "road_name", "roundabout", "geometry"), F.struct("cost", "distance_m")).alias("e"))
    return legs.select("request", "seq", F.col("leg.a").alias("src"), F.col("leg.b").alias("dst")).join(one, ["src", "dst"]).select("request", "seq", "src", "dst", "e.*")


def totals(segments: DataFrame, by: str, distance: str, duration: str) -> DataFrame:
    """(by, distance, duration): sums over the segments of each way."""
    return segments.groupBy(by).agg(F.sum(distance).alias(distance), F.sum(duration).alias(duration))


def line_string(points):
    """GeoJSON of an array of points (lat, lon), longitude first."""
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda x: F.array(x["lon"], x["lat"])).alias("coordinates")))


def polylines(segments: DataFrame) -> DataFrame:
    """(request, points, geojson): geometries joined in order, without points that repeat the one before."""
    whole = segments.groupBy("request").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", "geometry"))), lambda s: s["geometry"])).alias("p"))
    fresh = F.filter("p", lambda x, i: (i == 0) | (x != F.get("p", i - 1)))
    return whole.select("request", fresh.alias("points")).withColumn("geojson", line_string("points"))
