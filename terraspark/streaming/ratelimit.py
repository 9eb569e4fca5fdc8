"""Token buckets by key: as many tokens as calls a minute are allowed, refilled evenly; a call takes one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, seq long, allowed boolean, remaining double, retry_after_s double"
BY_ADDRESS, BY_KEY = 120, 60


def take(tokens: float, last: float, now: float, rpm: int) -> tuple[float, float, bool, float]:
    """Tokens and time after a call, whether it may pass, and the wait that is told, which is reckoned before the refill."""
    rate = rpm / 60.0
    wait = 0.0 if tokens >= 1 else (1 - tokens) / rate
    tokens = min(float(rpm), tokens + max(0.0, now - last) * rate)
    return (tokens - 1, now, True, 0.0) if tokens >= 1 else (tokens, now, False, wait)


def _calls(key: str, rows: pd.DataFrame, tokens: float | None, last: float) -> tuple[list[tuple], float, float]:
    out = []
    for seq, now, rpm in rows.sort_values(["t_sec", "seq"], kind="stable")[["seq", "t_sec", "rpm"]].itertuples(index=False):
        tokens, last, ok, wait = take(float(rpm) if tokens is None else tokens, now if tokens is None else last, now, int(rpm))
        out.append((key, seq, ok, tokens, wait))
    return out, tokens if tokens is not None else 0.0, last


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    tokens, last = state.get if state.exists else (None, 0.0)
    rows, tokens, last = _calls(key[0], pd.concat(list(batches)), tokens, last)
    state.update((tokens, last))
    yield pd.DataFrame(rows, columns=["key", "seq", "allowed", "remaining", "retry_after_s"])


def limit_stream(calls: DataFrame) -> DataFrame:
    """Outcomes of a stream of calls (key, seq, t_sec double, rpm)."""
    return calls.groupBy("key").applyInPandasWithState(_fold, OUT, "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def limit_batch(calls: DataFrame) -> DataFrame:
    """The same of a table. A key's bucket is one chain of states, so its calls are folded one after another; only the columns needed come along."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_calls(key[0], rows, None, 0.0)[0], columns=["key", "seq", "allowed", "remaining", "retry_after_s"])

    return calls.select("key", "seq", "t_sec", "rpm").groupBy("key").applyInPandas(run, OUT)
