"""Rate limiting as a stateful stream: windows anchored at a key's first event, not at the epoch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

STATE = "start timestamp, count long"


def _decide(seconds: int, limit: int):
    """State per key: start of the running window and its count; it expires a window after the watermark."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")  # one key's events of one micro-batch
        allowed, starts = [], []
        for t in rows["ts"]:
            if start is None or (t - pd.Timestamp(start)).total_seconds() >= seconds:
                start, count = t, 0
            count += 1
            allowed.append(count <= limit)
            starts.append(start)
        state.update((start, count))
        state.setTimeoutTimestamp(int(pd.Timestamp(start).timestamp() * 1000) + 2 * seconds * 1000)
        yield rows.assign(window_start=starts, allowed=allowed)

    return step


def limit_stream(events: DataFrame, key: str, seconds: int = 60, limit: int = 3, late: str = "5 minutes") -> DataFrame:
    """`events` (key, ts, ...) with window_start and allowed. Events later than `late` are dropped by the watermark."""
    schema = StructType([*events.schema.fields]).add("window_start", "timestamp").add("allowed", "boolean")
    return events.withWatermark("ts", late).groupBy(key).applyInPandasWithState(_decide(seconds, limit), schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def counters(events: DataFrame, *keys: str, value: str | None = None) -> DataFrame:
    """Running counts (and sums) by key, for complete or update mode."""
    sums = [F.count("*").alias("events")] + ([F.sum(value).alias("total")] if value else [])
    return events.groupBy(*keys).agg(*sums)


def exposition(counted: DataFrame, name: str, labels: tuple[str, ...], value: str = "events") -> DataFrame:
    """(line): one counter as lines `name{label="value",...} number`, sorted; quotes, backslashes and line ends escaped."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    parts = [F.concat(F.lit(f'{c}="'), escaped(c), F.lit('"')) for c in labels]
    return counted.select(F.concat(F.lit(f"{name}{{"), F.concat_ws(",", *parts), F.lit("} "), F.col(value).cast("string")).alias("line")).orderBy("line")


def windowed_counters(events: DataFrame, width: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key; a window is final once the watermark passes it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("events"))
