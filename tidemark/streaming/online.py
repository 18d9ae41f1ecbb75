"""Predict, then observe, as a stream: the state of a series is what its forecaster has seen.

Every micro-batch may bring the next values of any series; within a batch they are taken in order of t. Values that don't
come after the last one seen are late: they give no row and leave the state alone. Of values for the same time in one batch
the least counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "n bigint, last_t bigint, first double, last double, level double, ring array<double>"
OUT = "series_id string, t bigint, actual double, naive_1 double, seasonal_naive double, drift double, ses double"


def forecast_stream(stream: DataFrame, m: int, alpha: float = 0.3) -> DataFrame:
    """series_id, t, y (a stream) -> each value with the forecasts made before it was seen.

    State of a series: number and first and last value, a ring of the last m values, the smoothed level.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, last_t, first, last, level, ring = state.get if state.exists else (0, None, None, None, None, [])
        ring = list(ring)
        rows = pd.concat(list(batches)).sort_values(["t", "y"])
        out = []
        for t, y in zip(rows["t"].tolist(), rows["y"].tolist(), strict=True):
            if last_t is not None and t <= last_t:
                continue
            drift = last + (last - first) / max(n - 1, 1) if n else None
            out.append((key[0], t, y, last, ring[0] if len(ring) == m else None, drift, level))
            n, last_t, first, last = n + 1, t, y if first is None else first, y
            level = y if level is None else level + alpha * (y - level)
            ring = [*ring, y][-m:]
        state.update((n, last_t, first, last, level, ring))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return stream.groupBy("series_id").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")


def bucket_stream(events: DataFrame, width: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Sums of event values by type and window; a window closes when the watermark passes it."""
    w = F.window("ts", width)
    sums = events.withWatermark("ts", late).groupBy(F.col("event_type").alias("series_id"), w).agg(F.sum("value").alias("y"))
    return sums.select("series_id", F.unix_timestamp("window.start").alias("t"), "y")
