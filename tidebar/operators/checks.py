"""Data quality, drift, audits and resampling statistics."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions.exprs import KEY, TIME, ratio
from ..sources.bars import COLUMNS, PRICES, sane

#: Bootstrap inputs are broadcast; longer series are refused.
MOST_RETURNS = 5_000_000


def quality_counts(bars: DataFrame) -> DataFrame:
    """A row for each series: nulls, infinities, zeros, negatives and bars out of order."""
    counts = {}
    for c in COLUMNS:
        v = F.col(c)
        counts |= {f"{c}_null": F.count_if(v.isNull() | F.isnan(v)), f"{c}_inf": F.count_if(F.abs(v) == float("inf")), f"{c}_zero": F.count_if(v == 0), f"{c}_negative": F.count_if(v < 0)}
    return bars.groupBy(KEY).agg(F.count("*").alias("bars"), F.count_if(~sane()).alias("ohlc_violations"), *(v.alias(k) for k, v in counts.items()))


def _log_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("close_1", E.lag("close")).withColumn("log_ret", F.ln(F.nullif(ratio("close", "close_1"), F.lit(0.0))))


def price_gaps(bars: DataFrame, limit: float = 5.0) -> DataFrame:
    """Bars whose log return is over ``limit`` deviations from its series' mean."""
    df = _log_returns(bars)
    stats = df.groupBy(KEY).agg(F.avg("log_ret").alias("m"), F.stddev_samp("log_ret").alias("s"))
    return df.join(stats, KEY).withColumn("z", (F.col("log_ret") - F.col("m")) / F.nullif("s", F.lit(0.0))).where(F.abs("z") > limit).drop("m", "s", "close_1")


def volume_spikes(bars: DataFrame, factor: float = 5.0, n: int = 100, need: int = 20) -> DataFrame:
    return bars.withColumn("volume_mean", E.mean("volume", n, need)).where(F.col("volume") > factor * F.col("volume_mean"))


def time_gaps(bars: DataFrame) -> DataFrame:
    """A row for each series: median step in seconds, repeated times, gaps over
    3 and over 10 times the median."""
    step = F.expr(f"timestampdiff(SECOND, lag({TIME}) over (partition by {KEY} order by {TIME}), {TIME})")
    df = bars.select(KEY, step.alias("step"))
    median = df.groupBy(KEY).agg(F.percentile("step", F.lit(0.5)).alias("median_step"))
    s, m = F.col("step"), F.col("median_step")
    return df.join(median, KEY).groupBy(KEY).agg(F.first("median_step").alias("median_step"), F.count_if(s == 0).alias("repeats"), F.count_if(s > 3 * m).alias("gaps"), F.count_if(s > 10 * m).alias("large_gaps"), F.max("step").alias("longest_step"))


def out_of_order(bars: DataFrame, sequence: str) -> DataFrame:
    """Bars that come before their predecessor's time in the order they arrived in."""
    before = F.lag(TIME).over(Window.partitionBy(KEY).orderBy(sequence))
    return bars.withColumn("__before", before).where(F.col(TIME) < F.col("__before")).drop("__before")


def _moments(x: str) -> dict[str, Column]:
    n, v = F.count(x), F.col(x)
    return {"n": n, "mean": F.avg(v), "vol": F.stddev_samp(v), "skew": F.when(n > 2, F.skewness(v) * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0))), "kurt": F.when(n > 3, (n - 1.0) / F.nullif((n - 2.0) * (n - 3.0), F.lit(0.0)) * ((n + 1.0) * F.kurtosis(v) + 6.0))}


def drift(bars: DataFrame) -> DataFrame:
    """Moments of log returns in each series' first and second half (0, 1)."""
    df = _log_returns(bars)
    half = (F.col("bar_idx") >= F.floor(F.count("*").over(Window.partitionBy(KEY)) / 2)).cast("int")
    return df.withColumn("half", half).groupBy(KEY, "half").agg(*(v.alias(k) for k, v in _moments("log_ret").items()))


def recent_volatility(bars: DataFrame, n: int = 500) -> DataFrame:
    """(symbol, ratio) of the last n log returns' deviation to all."""
    df = _log_returns(bars).withColumn("__back", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(TIME))))
    return df.groupBy(KEY).agg((F.stddev_samp(F.when(F.col("__back") <= n, F.col("log_ret"))) / F.nullif(F.stddev_samp("log_ret"), F.lit(0.0))).alias("recent_vol_ratio"))


def kolmogorov_smirnov(values: DataFrame, keys: list[str], value: str, sample: str) -> DataFrame:
    """(keys, n0, n1, d, p_value) of two samples (``sample`` is 0 or 1) in each group.

    Equal values are counted together first, so a window holds a group's
    distinct values."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_if(F.col(sample) == 0).alias("c0"), F.count_if(F.col(sample) == 1).alias("c1"))
    whole, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    df = counts.withColumns({"n0": F.sum("c0").over(whole), "n1": F.sum("c1").over(whole), "f0": F.sum("c0").over(upto), "f1": F.sum("c1").over(upto)})
    df = df.groupBy(*keys).agg(F.first("n0").alias("n0"), F.first("n1").alias("n1"), F.max(F.abs(F.col("f0") / F.nullif("n0", F.lit(0)) - F.col("f1") / F.nullif("n1", F.lit(0)))).alias("d"))
    en = F.sqrt(F.col("n0") * F.col("n1") / F.nullif(F.col("n0") + F.col("n1"), F.lit(0)))
    lam = (en + 0.12 + 0.11 / F.nullif(en, F.lit(0.0))) * F.col("d")
    series = sum((2 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 51)), F.lit(0.0))
    return df.withColumn("p_value", F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0))))


def compare_periods(a: DataFrame, b: DataFrame) -> DataFrame:
    """Moments of each period's own log returns, and their KS statistic."""
    rows = _log_returns(a).withColumn("period", F.lit(0)).unionByName(_log_returns(b).withColumn("period", F.lit(1)))
    own = rows.groupBy(KEY, "period").agg(*(v.alias(k) for k, v in _moments("log_ret").items()))
    wide = [own.where(F.col("period") == k).select(KEY, *(F.col(c).alias(f"{c}_{k}") for c in ("mean", "vol", "skew", "kurt"))) for k in (0, 1)]
    return kolmogorov_smirnov(rows, [KEY], "log_ret", "period").join(wide[0], KEY, "left").join(wide[1], KEY, "left")


def quality_score(bars: DataFrame) -> DataFrame:
    """(symbol, errors, warnings, outlier_rate, score): 100 less 10 an error, 2 a
    warning, and up to 20 for outliers; at least 0."""
    counts, gaps = quality_counts(bars), time_gaps(bars)
    outliers = price_gaps(bars).groupBy(KEY).agg(F.count("*").alias("outliers"))
    df = counts.join(gaps, KEY, "left").join(outliers, KEY, "left")
    bad = lambda c: (F.coalesce(F.col(c), F.lit(0)) > 0).cast("int")
    errors = bad("ohlc_violations") + bad("repeats") + sum((bad(f"{c}_{w}") for c in PRICES for w in ("null", "inf", "negative")), F.lit(0))
    warnings = bad("gaps") + bad("large_gaps") + bad("volume_zero") + sum((bad(f"{c}_zero") for c in PRICES), F.lit(0))
    rate = F.coalesce(F.col("outliers"), F.lit(0)) / F.col("bars")
    score = F.greatest(F.lit(0.0), 100.0 - 10 * errors - 2 * warnings - F.least(1000 * rate, F.lit(20.0)))
    return df.select(KEY, errors.alias("errors"), warnings.alias("warnings"), rate.alias("outlier_rate"), score.alias("score"))


@dataclass
class Audit:
    errors: list[str]
    warnings: list[str]

    @property
    def passed(self) -> bool:
        return not self.errors


def audit(log: DataFrame, tolerance: float = 1e-3, strict: bool = False) -> Audit:
    """Checks a trade log (signal, position, future_return, pnl_raw, cost, pnl and,
    if there, symbol and ts, equity, prob, ev, regime) with one aggregate, after one
    pass over each series where it has times; messages are made here.

    Errors: values outside their range, infinite ones, repeated times, an equity
    that isn't above 0. Warnings: missing or extreme values, gaps of over three
    median steps, an equity that isn't correlated (0.99) with the product of pnl,
    confidences that are all alike, expected values that are all missing or below 0."""
    needed = {"signal", "pnl", "pnl_raw", "cost", "future_return", "position"}
    if missing := needed - set(log.columns):
        return Audit([f"missing columns: {', '.join(sorted(missing))}"], [])
    n = F.count("*")
    tests = {
        "signals outside -1, 0, 1": F.count_if(~F.col("signal").isin(-1, 0, 1)),
        "returns over 100%": F.count_if(F.abs("future_return") > 1),
        "infinite returns": F.count_if(F.abs("pnl") == float("inf")),
        "pnl unlike return times position less cost": F.count_if(F.abs(F.col("pnl") - (F.col("position") * F.col("future_return") - F.col("cost"))) > tolerance),
    }
    soft = {"over 10% of returns missing": F.count_if(F.col("pnl").isNull()) > 0.1 * n}
    if {KEY, TIME} <= set(log.columns):
        step = F.col(TIME).cast("timestamp").cast("double") - E.lag(TIME).cast("timestamp").cast("double")
        log = log.withColumns({"__step": step, "__equity": F.product(1 + F.coalesce("pnl", F.lit(0.0))).over(E.so_far())})
        tests["repeated times"] = F.count_if(F.col("__step") == 0)
        soft["gaps of over three median steps"] = F.max("__step") > 3 * F.percentile_approx("__step", F.lit(0.5))
        if "equity" in log.columns:
            soft["equity unlike the product of pnl"] = F.coalesce(E.correlation("equity", "__equity") < 0.99, F.lit(False))
    if "equity" in log.columns:
        tests["equity not above 0"] = F.count_if(F.col("equity") <= 0)
    if "prob" in log.columns:
        tests["probabilities outside 0 to 1"] = F.count_if((F.col("prob") < 0) | (F.col("prob") > 1))
        soft["probabilities all alike"] = (n > 1) & (F.max("prob") == F.min("prob"))
    if "ev" in log.columns:
        tests["infinite expected values"] = F.count_if(F.abs("ev") == float("inf"))
        soft["no expected value above 0"] = (F.count("ev") > 0) & (F.max("ev") <= 0)
    if "regime" in log.columns:
        tests["unknown regimes"] = F.count_if(~F.col("regime").isin("trend_up", "trend_down", "chop", "unknown"))
    row = log.agg(n.alias("n"), *(v.alias(k) for k, v in (tests | soft).items())).first().asDict()
    errors = [f"{k}: {row[k]}" for k in tests if row[k]] + ([] if row["n"] else ["no rows"])
    warnings = [k for k in soft if row[k]]
    return Audit(errors + warnings, []) if strict else Audit(errors, warnings)


def _sharpe(x: np.ndarray, periods: int) -> float:
    s = x.std(ddof=1) if len(x) > 1 else 0.0
    return float(math.sqrt(periods) * x.mean() / s) if s > 0 else 0.0


def _worst(x: np.ndarray) -> float:
    curve = np.cumprod(1 + x)
    return float((curve / np.maximum.accumulate(curve) - 1).min())


def _held_returns(returns: DataFrame, value: str, key: str | None):
    """Broadcast (series, returns in time order) pairs, sorted by series; one of None without a key."""
    n = returns.count()
    if n > MOST_RETURNS:
        raise ValueError(f"over {MOST_RETURNS} returns")
    series: dict[str | None, list[float]] = {} if key else {None: []}
    for k, v in returns.orderBy(TIME).select(F.col(key) if key else F.lit(None), value).collect():
        own = series.setdefault(k, [])
        if v is not None:
            own.append(v)
    held = [(k, np.array(series[k], float)) for k in sorted(series, key=lambda k: (k is None, str(k)))]
    return returns.sparkSession.sparkContext.broadcast(held)


def _seeds(seed: int, key: object, k: int) -> list[int]:
    return [seed, int(k)] if key is None else [seed, int(k), zlib.crc32(str(key).encode())]


def _keyed(returns: DataFrame, key: str | None) -> str:
    return f"`{key}` {returns.schema[key].dataType.simpleString()}, " if key else ""


def bootstrap(returns: DataFrame, value: str = "pnl", replicates: int = 1000, block: int | None = None, seed: int = 42, periods: int = 252, key: str | None = None) -> DataFrame:
    """(replicate, sharpe, total_return, max_drawdown) of circular block samples
    of one series in time order, or with ``key`` of each of its series, named in
    a first column; each replicate of a series has its own seed, so results
    depend neither on the partitions nor on the other series. A series of under
    20 returns has no replicates."""
    held = _held_returns(returns, value, key)
    long = [i for i, (_, x) in enumerate(held.value) if len(x) >= 20]
    names = ["replicate", "sharpe", "total_return", "max_drawdown"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for at in frame["id"]:
                (name, x), k = held.value[long[at // replicates]], at % replicates
                size = block or max(1, round(math.sqrt(len(x))))
                rng = np.random.default_rng(_seeds(seed, name, k))
                starts = rng.integers(0, len(x), -(-len(x) // size))
                sample = x[(starts[:, None] + np.arange(size)).ravel()[: len(x)] % len(x)]
                found = (k, _sharpe(sample, periods), float(np.prod(1 + sample) - 1), _worst(sample))
                out.append((name, *found) if key else found)
            yield pd.DataFrame(out, columns=[key, *names] if key else names)

    return returns.sparkSession.range(replicates * len(long)).mapInPandas(run, _keyed(returns, key) + "replicate long, sharpe double, total_return double, max_drawdown double")


def bootstrap_summary(samples: DataFrame, level: float = 0.95, keys: tuple[str, ...] = ()) -> DataFrame:
    """Interval and share of replicates not above 0, a row for each statistic (of each of ``keys``)."""
    names = ["sharpe", "total_return", "max_drawdown"]
    rows = samples.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("statistic"), F.col(c).alias("v")) for c in names))).alias("x"))
    v = F.col("x.v")
    return rows.groupBy(*keys, F.col("x.statistic").alias("statistic")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit((1 - level) / 2)).alias("low"), F.percentile(v, F.lit((1 + level) / 2)).alias("high"), F.avg((v <= 0).cast("double")).alias("p_value"))


def overfit(returns: DataFrame, value: str = "pnl", train_share: float = 0.7, permutations: int = 500, seed: int = 42, periods: int = 252, key: str | None = None) -> DataFrame:
    """One row, or with ``key`` one for each of its series: Sharpe in and out of
    sample, its decay, and the share of shuffled series at least as good in sample."""
    held = _held_returns(returns, value, key)
    names = ["sharpe_in", "sharpe_out", "decay", "s"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for at in frame["id"]:
                name, x = held.value[at // permutations]
                cut = int(len(x) * train_share)
                inside, outside = _sharpe(x[:cut], periods), _sharpe(x[cut:], periods)
                shuffled = np.random.default_rng(_seeds(seed, name, at % permutations)).permutation(x)[:cut]
                found = (inside, outside, 1 - outside / inside if inside else 0.0, _sharpe(shuffled, periods))
                out.append((name, *found) if key else found)
            yield pd.DataFrame(out, columns=[key, *names] if key else names)

    shuffled = returns.sparkSession.range(permutations * len(held.value)).mapInPandas(run, _keyed(returns, key) + "sharpe_in double, sharpe_out double, decay double, s double")
    return shuffled.groupBy(*([key] if key else []), "sharpe_in", "sharpe_out", "decay").agg(F.avg((F.col("s") >= F.col("sharpe_in")).cast("double")).alias("pbo"))
