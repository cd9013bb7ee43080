"""Streaming versions of the keyed folds: moving priors and streaks by key, reward windows by step."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ema_prior_stream(stream: DataFrame, key: str, value: str, order: str, momentum: float) -> DataFrame:
    """(key, ema, seen, streak) after each micro-batch: first value, then momentum times old plus the rest times new.

    The state of a key is three numbers. Within a micro-batch values are taken in order of ``order``.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    output = f"{key} {kinds[key]}, ema double, seen long, streak long"

    def update(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ema, seen, streak = state.get if state.exists else (0.0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        for v in rows[value]:
            if v is None or v != v:
                continue
            ema = float(v) if seen == 0 else momentum * ema + (1 - momentum) * float(v)
            seen, streak = seen + 1, 0 if v >= 1 else streak + 1
        state.update((ema, seen, streak))
        yield pd.DataFrame({key: [name[0]], "ema": [ema], "seen": [seen], "streak": [streak]})

    return stream.select(key, value, order).groupBy(key).applyInPandasWithState(update, output, "ema double, seen long, streak long", "update", "NoTimeout")


def reward_window_stream(stream: DataFrame, step: str, value: str, interval: int) -> DataFrame:
    """Means over tumbling windows of steps, complete so far."""
    return stream.groupBy(F.ceil(F.col(step) / interval).alias("window")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.max(step).alias("upto"))


def event_windows(stream: DataFrame, time: str, key: str, value: str, late: str, width: str) -> DataFrame:
    """An extension: sums by key and event-time window, rows later than ``late`` dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
