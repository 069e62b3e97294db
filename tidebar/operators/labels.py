"""Direction and regime labels. A label looks ahead of its bar; a feature never does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LabelConfig
from ..functions import exprs as E
from ..functions.exprs import ratio
from .kernels import run_kernels


def future_return(horizon: int = 10) -> Column:
    return ratio(E.lead("close", horizon), "close") - 1


def direction_labels(bars: DataFrame, config: LabelConfig = LabelConfig()) -> DataFrame:
    """Adds future_return, smoothed_return, blend_label (-1, 0, 1), threshold,
    effective_threshold and round_trip_cost. A null return is labelled 0."""
    cost = 2 * config.cost_bps_per_side / 10_000.0
    effective = config.threshold + (cost if config.cost_adjusted else 0.0)
    df = bars.withColumn("future_return", future_return(config.horizon))
    df = df.withColumn("smoothed_return", E.mean("future_return", config.smoothing, 1))
    r = F.col("smoothed_return")
    label = F.when(r > effective, 1).when(r < -effective, -1).otherwise(0)
    return df.withColumns({"blend_label": label, "threshold": F.lit(config.threshold), "effective_threshold": F.lit(effective), "round_trip_cost": F.lit(cost)})


def label_report(labelled: DataFrame) -> DataFrame:
    """Counts and return statistics of each label, and of all (null label)."""
    r = F.col("future_return")
    return labelled.groupingSets([["blend_label"], []], "blend_label").agg(
        F.count("*").alias("n"), F.count(r).alias("n_return"), F.avg(r).alias("mean_return"), F.stddev_samp(r).alias("std_return"), F.percentile(r, F.lit(0.25)).alias("p25"), F.percentile(r, F.lit(0.5)).alias("median_return"), F.percentile(r, F.lit(0.75)).alias("p75")
    )


def adx_regime(bars: DataFrame, adx_column: str | None = None) -> DataFrame:
    """Adds regime: up or down by SMA(10) - SMA(40) while ADX(14) > 25, else chop."""
    df = bars if adx_column else run_kernels(bars, ["adx_14"])
    slope, strong = E.mean("close", 10) - E.mean("close", 40), F.col(adx_column or "adx_14") > 25
    return df.withColumn("regime", F.when(strong & (slope > 0), "trend_up").when(strong & (slope < 0), "trend_down").otherwise("chop"))


def channel_regime(channel: DataFrame, slope: str = "lr_slope", middle: str = "lr_mid", limit: float = 0.001) -> DataFrame:
    """Adds regime from a regression channel's slope and the close's side of it."""
    up = (F.col(slope) > limit) & (F.col("close") > F.col(middle))
    down = (F.col(slope) < -limit) & (F.col("close") < F.col(middle))
    return channel.withColumn("regime", F.when(up, "trend_up").when(down, "trend_down").otherwise("chop"))


def regime_labels(df: DataFrame, strategy: str = "indicator") -> DataFrame:
    if strategy == "indicator":
        return adx_regime(df)
    if strategy == "rule":
        return channel_regime(df)
    raise ValueError(f"unknown regime strategy {strategy!r}")


def check_labels(labelled: DataFrame, column: str, classes: int = 3, most_share: float = 0.8) -> None:
    """Raises unless all classes are there and none has more than ``most_share``."""
    counts = {r[0]: r[1] for r in labelled.groupBy(column).count().collect()}
    total = sum(counts.values())
    if len(counts) != classes or max(counts.values()) > most_share * total:
        raise ValueError(f"labels are unbalanced: {counts}")


def grid_labels(bars: DataFrame, horizons: list[int], smoothings: list[int], threshold: float = 0.0005) -> DataFrame:
    """(symbol, horizon, smoothing, n, n_long, n_short, mean_return) for every
    pair of parameters, from one scan and one shuffle of the bars."""
    df = bars.withColumns({f"r{h}": future_return(h) for h in horizons})
    df = df.withColumns({f"s{h}_{s}": E.mean(f"r{h}", s, 1) for h in horizons for s in smoothings})
    pairs = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lit(s).alias("smoothing"), F.col(f"r{h}").alias("r"), F.col(f"s{h}_{s}").alias("m")) for h in horizons for s in smoothings))
    rows = df.select(E.KEY, F.explode(pairs).alias("x")).select(E.KEY, "x.*")
    return rows.groupBy(E.KEY, "horizon", "smoothing").agg(F.count("*").alias("n"), F.count_if(F.col("m") > threshold).alias("n_long"), F.count_if(F.col("m") < -threshold).alias("n_short"), F.avg("r").alias("mean_return"))
