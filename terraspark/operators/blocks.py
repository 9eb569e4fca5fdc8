"""Shortest ways on a graph too large for one task, searched in blocks of nodes of near ids.

A block is searched by itself from what has come to it: for each origin, nodes with their least cost so far and the node
before. What leaves it over edges to other blocks goes to those; blocks to which something new comes are searched again,
until nothing changes. So there are about as many rounds as a way crosses borders of blocks, and a task holds one block.
An origin's search ends at the cost of its furthest wanted node, once all of them are reached.

Of ways of equal cost the one with the lower node before the end stays. Costs are kept with the number of edges of no
cost as a fraction (ONE), so that each step adds something.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import materialise, new_path, remove

#: Edges of a block, about; a task holds some 200 bytes for each.
EDGES = 1_000_000
ONE = 1 << 20
MOST_ROUNDS = 10_000
#: What comes to a block: kind 0 a node reached (cost, the node before, metres and time), 1 a node whose cost is wanted, 2 one whose way is.
ASK = "block int, kind int, origin long, node long, cost long, before long, distance_m long, time_ds long, sender int, wanted long, bound long, dst long, step int"


class Block:
    def __init__(self, edges: pa.Table, more: np.ndarray) -> None:
        src, dst, w, d, t = (edges[c].to_numpy() for c in ("src", "dst", "cost", "distance_m", "time_ds"))
        order = np.argsort(src, kind="stable")
        self.ids = np.unique(np.concatenate([src, more]))
        at, to = np.searchsorted(self.ids, src[order]), dst[order]
        inside = np.minimum(np.searchsorted(self.ids, to), len(self.ids) - 1)
        # Nodes of other blocks have no edges here, even where they have come up.
        self.first = np.searchsorted(at, np.arange(len(self.ids) + 1)).tolist()
        here = (self.ids[inside] == to) & (edges["at"].to_numpy()[order] == edges["block"].to_numpy()[order])
        self.target, self.to = np.where(here, inside, -1).tolist(), to
        self.weight, self.distance, self.time, self.at = w[order].tolist(), d[order], t[order], edges["at"].to_numpy()[order]
        self.leaves = ~here

    def number(self, node: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, node)

    def search(self, start: dict[int, tuple[int, int, int, int]], wanted: set[int], all_wanted: bool, bound: int | None):
        """From start (number: cost, node before, metres, time): settled (number: cost, node before, number before or -1, metres, time), and what leaves (node: cost, node before, metres, time, block)."""
        ids, first, target, weight, leaves = self.ids, self.first, self.target, self.weight, self.leaves
        best = {k: (v[0], v[1], -1, -1) for k, v in start.items()}
        queue = [(v[0], k) for k, v in start.items()]
        heapq.heapify(queue)
        done: dict[int, tuple[int, int, int, int, int]] = {}
        out: dict[int, tuple[int, int, int, int, int]] = {}
        left = len(wanted)
        while queue and (left or not all_wanted):
            cost, node = heapq.heappop(queue)
            if node in done:
                continue
            if bound is not None and cost > bound:
                break
            _, before, prev, edge = best[node]
            if prev < 0:
                metres, time = start[node][2:]
            else:
                metres, time = done[prev][3] + int(self.distance[edge]), done[prev][4] + int(self.time[edge])
            done[node] = (cost, before, prev, metres, time)
            left -= node in wanted
            me = int(ids[node])
            for e in range(first[node], first[node + 1]):
                total, there = cost + weight[e], target[e]
                if there >= 0:
                    had = best.get(there)
                    if there not in done and (had is None or total < had[0] or (total == had[0] and me < had[1])):
                        best[there] = (total, me, node, e)
                        if had is None or total < had[0]:
                            heapq.heappush(queue, (total, there))
                elif leaves[e] and (bound is None or total <= bound):
                    to = int(self.to[e])
                    had = out.get(to)
                    if had is None or (total, me) < had[:2]:
                        out[to] = (total, me, metres + int(self.distance[e]), time + int(self.time[e]), int(self.at[e]))
        return done, out


def _searched(edges: pa.Table, asks: pa.Table) -> Iterator[tuple[int, Block, dict, dict, list[tuple]]]:
    """For each origin that has come to a block: origin, block, settled, what leaves, and what is wanted (kind, number, dst, step)."""
    if not asks.num_rows:
        return
    block = Block(edges, asks["node"].to_numpy())
    cols = {c: asks[c].to_numpy() for c in ("kind", "origin", "cost", "before", "distance_m", "time_ds", "wanted", "dst", "step")}
    bounds, numbers = asks["bound"].to_pylist(), block.number(asks["node"].to_numpy())
    order = np.argsort(cols["origin"], kind="stable")
    cuts = np.flatnonzero(np.diff(cols["origin"][order])) + 1
    for rows in np.split(order, cuts):
        start: dict[int, tuple[int, int, int, int]] = {}
        wanted, bound, total, ways = [], None, 0, False
        for i in rows.tolist():
            total, bound = int(cols["wanted"][i]), bounds[i]
            if cols["kind"][i] == 0:
                label = tuple(int(cols[c][i]) for c in ("cost", "before", "distance_m", "time_ds"))
                n = int(numbers[i])
                if n not in start or label[:2] < start[n][:2]:
                    start[n] = label
            else:
                ways = ways or cols["kind"][i] == 2
                wanted.append((int(cols["kind"][i]), int(numbers[i]), int(cols["dst"][i]), int(cols["step"][i])))
        if start:
            mine = {w[1] for w in wanted}
            yield int(cols["origin"][rows[0]]), block, *block.search(start, mine, ways or len(mine) == total, bound), wanted


MESSAGE = "block int, origin long, node long, cost long, before long, distance_m long, time_ds long, sender int"


def _message(edges: pa.Table, asks: pa.Table) -> pa.Table:
    """What leaves a block for others, and with block -1 the wanted nodes that are reached."""
    rows = []
    me = asks["block"][0].as_py() if asks.num_rows else None
    for origin, block, done, out, wanted in _searched(edges, asks):
        rows += [(v[4], origin, node, *v[:4], me) for node, v in out.items()]
        rows += [(-1, origin, int(block.ids[n]), done[n][0], done[n][1], done[n][3], done[n][4], me) for _, n, _, _ in wanted if n in done]
    kinds = [pa.int32(), *[pa.int64()] * 6, pa.int32()]
    names = [x.split()[0] for x in MESSAGE.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


PIECE = "origin long, dst long, step int, nodes array<long>, before long"


def _piece(edges: pa.Table, asks: pa.Table) -> pa.Table:
    """Of each wanted way the part inside this block, from its last node backwards, and the node before that (-1 at the origin)."""
    rows = []
    for origin, block, done, _, wanted in _searched(edges, asks):
        for kind, n, dst, step in wanted:
            if kind == 2:
                nodes = []
                while n >= 0:
                    nodes.append(int(block.ids[n]))
                    before, n = done[n][1], done[n][2]
                rows.append((origin, dst, step, nodes, before))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64()]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["origin", "dst", "step", "nodes", "before"])


def _placed(cuts: np.ndarray):
    """The block of a node, a pandas function."""

    @F.pandas_udf("int")
    def place(node):
        import pandas as pd

        return pd.Series(np.searchsorted(cuts, node.to_numpy(), "right").astype(np.int32))

    return place


def search(ways: DataFrame, edges: DataFrame, count: int, paths: bool) -> DataFrame:
    """(src, dst, distance_m, time_ds, path) of those ways (src, dst; distinct, not from a node to itself) that there are."""
    spark = ways.sparkSession
    one = edges.groupBy("src", "dst").agg(F.min(F.struct("cost", "distance_m", "time_ds")).alias("e")).select("src", "dst", "e.*")
    cuts = np.unique(np.array(edges.approxQuantile("src", [i / count for i in range(1, count)], min(0.01, 0.2 / count)), np.int64)) if count > 1 else np.zeros(0, np.int64)
    place = _placed(cuts)
    kept: list[str] = []

    def write(df: DataFrame, name: str, parts: str | None = None) -> DataFrame:
        kept.append(new_path(spark, name))
        (df.write.partitionBy(parts) if parts else df.write).parquet(kept[-1])
        return spark.read.schema(df.schema).parquet(kept[-1])

    placed = one.select(place("src").alias("block"), place("dst").alias("at"), "src", "dst", (F.col("cost") * ONE + (F.col("cost") == 0).cast("long")).alias("cost"), "distance_m", "time_ds")
    graph = write(placed.repartition("block"), "blocks", "block").select("block", "at", "src", "dst", "cost", "distance_m", "time_ds")
    nodes = graph.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    asked = materialise(ways.join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("src").alias("origin"), F.col("dst").alias("node"), place("dst").alias("block")), "blocks-ways")
    totals = asked.groupBy("origin").agg(F.count("node").alias("wanted"))

    none = lambda kind: F.lit(None).cast(kind)
    zero = F.lit(0).cast("long")

    def ask(kind: int, df: DataFrame, **own: Column) -> DataFrame:
        have = set(df.columns)
        fields = [x.split() for x in ASK.split(", ")]
        return df.select(*[own[c].cast(k).alias(c) if c in own else F.lit(kind).alias(c) if c == "kind" else F.col(c) if c in have else (none(k) if c == "bound" else F.lit(0).cast(k)).alias(c) for c, k in fields])

    def run(active: list[int], inbox: DataFrame, goals: DataFrame, f, schema: str) -> DataFrame:
        asks = inbox.where(F.col("block").isin(*active)).unionByName(goals)
        return graph.where(F.col("block").isin(*active)).groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(f, schema)

    state = write(asked.select("origin").distinct().select(place("origin").alias("block"), "origin", F.col("origin").alias("node"), zero.alias("cost"), F.lit(-1).cast("long").alias("before"), zero.alias("distance_m"), zero.alias("time_ds"), F.lit(-1).alias("sender")), "blocks-state")
    counted = {}

    def tally(df: DataFrame) -> dict[tuple[int, int], tuple]:
        rows = df.where("block >= 0").groupBy("sender", "block").agg(F.count("node").alias("n"), F.sum(F.xxhash64(*[c for c in df.columns if c != "sender"]).cast("decimal(38,0)")).alias("h")).collect()
        return {(r.sender, r.block): (r.n, r.h) for r in rows}

    counted = tally(state)
    active = sorted({b for _, b in counted})
    for _ in range(MOST_ROUNDS):
        if not active:
            break
        # Where all wanted nodes of an origin are reached, nothing beyond the furthest is of use.
        limits = totals.join(state.where("block = -1").groupBy("origin").agg(F.count_distinct("node").alias("n"), F.max("cost").alias("most")), "origin", "left").select("origin", "wanted", F.when(F.col("n") == F.col("wanted"), F.col("most")).alias("bound"))
        held = state.where("block >= 0").join(limits, "origin").where("bound IS NULL OR cost <= bound")
        goals = asked.where(F.col("block").isin(*active)).join(limits, "origin")
        sent = run(active, ask(0, held), ask(1, goals), _message, MESSAGE)
        before, old = state, kept[-1]
        state = write(before.where(~F.col("sender").isin(*active)).unionByName(sent), "blocks-state")
        now = tally(state)
        active = sorted({b for s, b in now.keys() | counted.keys() if now.get((s, b)) != counted.get((s, b))})
        counted = now
        remove(spark, old)
        kept.remove(old)
    else:
        raise RuntimeError("ways did not settle")
    found = state.where("block = -1").select(F.col("origin").alias("src"), F.col("node").alias("dst"), "cost", "distance_m", "time_ds")
    if not paths:
        return found.select("src", "dst", "distance_m", "time_ds", F.lit(None).cast("array<long>").alias("path"))
    heads = found.select(place("dst").alias("block"), F.col("src").alias("origin"), F.col("dst").alias("node"), "dst", F.lit(0).alias("step"))
    inbox = ask(0, state.where("block >= 0"))
    pieces = None
    for step in range(MOST_ROUNDS):
        active = sorted(r.block for r in heads.select("block").distinct().collect())
        if not active:
            break
        got = write(run(active, inbox, ask(2, heads), _piece, PIECE), "blocks-pieces")
        pieces = got if pieces is None else pieces.unionByName(got)
        heads = got.where("before >= 0").select(place("before").alias("block"), "origin", F.col("before").alias("node"), "dst", F.lit(step + 1).alias("step"))
    whole = F.reverse(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("step", "nodes"))), lambda p: p["nodes"])))
    if pieces is None:
        return found.select("src", "dst", "distance_m", "time_ds", F.lit(None).cast("array<long>").alias("path"))
    return found.join(pieces.groupBy(F.col("origin").alias("src"), "dst").agg(whole.alias("path")), ["src", "dst"]).select("src", "dst", "distance_m", "time_ds", "path")
