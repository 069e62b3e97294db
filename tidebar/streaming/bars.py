"""Bars from a stream: resampling with a watermark, and running kernels.

``smoothed`` keeps each series' EMA as state between batches by the same rule as
the batch kernel, so a stream's rows equal a table's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.exprs import KEY, TIME


def resampled(bars: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``sources.bars.resample`` of a stream: bars later than ``late`` are left out."""
    return bars.withWatermark(TIME, late).groupBy(KEY, F.window(TIME, every)).agg(F.min_by("open", TIME).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", TIME).alias("close"), F.sum("volume").alias("volume")).select(KEY, F.col("window.start").alias(TIME), "open", "high", "low", "close", "volume")


def smoothed(bars: DataFrame, span: int) -> DataFrame:
    """(symbol, ts, close, ema) of a stream whose batches are each in order of time."""
    alpha = 2.0 / (span + 1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, value = state.get if state.exists else (0, 0.0)
        for frame in frames:
            frame = frame.sort_values(TIME)
            out = []
            for x in frame["close"]:
                value = x if n == 0 else value + alpha * (x - value)
                n += 1
                out.append(value if n >= span else None)
            yield pd.DataFrame({KEY: frame[KEY], TIME: frame[TIME], "close": frame["close"], "ema": out})
        state.update((n, value))

    rows = bars.select(KEY, F.col(TIME).cast("timestamp").alias(TIME), "close")
    return rows.groupBy(KEY).applyInPandasWithState(step, "symbol string, ts timestamp, close double, ema double", "n long, value double", "append", GroupStateTimeout.NoTimeout)
