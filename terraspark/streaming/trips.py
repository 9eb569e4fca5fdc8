"""Trips as a stream of events, and what is learned when they end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "trip_id string, seq long, kind string, status int, points long"
STATE = "status string, points long"


def step(status: str | None, points: int, kind: str, added: int) -> tuple[str | None, int, int]:
    """State and outcome of one event: 200, 404 for a trip that isn't known, 409 for one that has ended."""
    if kind == "start":
        return "open", added, 200
    if status is None:
        return None, 0, 404
    if status == "ended":
        return status, points, 409
    return ("ended" if kind == "end" else "open"), points + added, 200


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, points = state.get if state.exists else (None, 0)
    events = pd.concat(list(batches)).sort_values("seq", kind="stable")
    rows = []
    for seq, kind, added in events[["seq", "kind", "points"]].itertuples(index=False):
        status, points, outcome = step(status, points, kind, int(added))
        rows.append((key[0], seq, kind, outcome, points))
    if status is not None:
        state.update((status, points))
    yield pd.DataFrame(rows, columns=["trip_id", "seq", "kind", "status", "points"])


def lifecycle(events: DataFrame) -> DataFrame:
    """An outcome for every event (trip_id, seq, kind start/update/end, points) of a stream; events of a trip in the order of seq within a batch."""
    return events.groupBy("trip_id").applyInPandasWithState(_fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def lifecycle_batch(events: DataFrame) -> DataFrame:
    """The same of a finished table. A trip's rows are folded in its task."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        status, points, out = None, 0, []
        for seq, kind, added in rows.sort_values("seq", kind="stable")[["seq", "kind", "points"]].itertuples(index=False):
            status, points, outcome = step(status, points, kind, int(added))
            out.append((key[0], seq, kind, outcome, points))
        return pd.DataFrame(out, columns=["trip_id", "seq", "kind", "status", "points"])

    return events.groupBy("trip_id").applyInPandas(run, OUT)


def learn(samples: DataFrame, store: str):
    """A sink for writeStream.foreachBatch that appends speed samples (src, dst, kmh) to a table; a batch that is tried again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.select("src", "dst", "kmh").write.mode("overwrite").parquet(f"{store}/batch={number}")

    return samples.writeStream.foreachBatch(put)


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events (ts, kind) by tumbling or sliding windows; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide or size), "kind").agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "kind", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of events (ts, user_id) with pauses of less than gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("session_window.start", "session_window.end", "user_id", "n")
