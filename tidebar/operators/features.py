"""Feature operators: columns that depend on nothing after their own bar.

``with_base`` adds lags and row expressions once (unused ones are pruned by the
optimizer); each feature function then returns named expressions over it, so
all windows of a plan share one partitioning and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions.exprs import KEY, TIME, ratio

RETURNS = (1, 2, 3, 5, 10, 20)
VOLATILITIES = (5, 10, 20, 50)
RSIS = (7, 14, 21)
AVERAGES = (10, 20, 50)
CONTEXT_WINDOWS = (3, 6, 12, 24, 48)
LN2 = 0.6931471805599453


def _log_ratio(a: str, b: str) -> Column:
    return F.ln(F.nullif(ratio(a, b), F.lit(0.0)))


def with_base(bars: DataFrame) -> DataFrame:
    """Lags of prices, then returns, ranges and running extremes."""
    lags = {f"close_{k}": E.lag("close", k) for k in (*RETURNS[:-1], RETURNS[-1])}
    df = bars.withColumns({**lags, "high_1": E.lag("high"), "low_1": E.lag("low"), "volume_1": E.lag("volume"), "peak": F.max("close").over(E.so_far())})
    df = df.withColumns(
        {
            **{f"ret_{k}": ratio("close", f"close_{k}") - 1 for k in RETURNS},
            "change": F.col("close") - F.col("close_1"),
            "tr": E.true_range(),
            "log_hl": _log_ratio("high", "low"), "log_co": _log_ratio("close", "open"), "log_oc1": _log_ratio("open", "close_1"),
            "log_ho": _log_ratio("high", "open"), "log_lo": _log_ratio("low", "open"), "log_hc": _log_ratio("high", "close"), "log_lc": _log_ratio("low", "close"),
            "volume_safe": F.nullif("volume", F.lit(0.0)),
            "drawdown": ratio("close", "peak") - 1,
        }
    )
    return df.withColumns({"ret_lag": E.lag("ret_1"), "gain": F.when(F.col("change") > 0, F.col("change")).otherwise(0.0), "loss": F.when(F.col("change") < 0, -F.col("change")).otherwise(0.0)})


def returns() -> dict[str, Column]:
    return {f"ret_{k}": F.col(f"ret_{k}") for k in RETURNS}


def volatilities() -> dict[str, Column]:
    return {f"vol_{n}": E.deviation("ret_1", n) for n in VOLATILITIES}


def simple_rsis() -> dict[str, Column]:
    """Of simple means; null without losses in the window."""
    return {f"rsi_{n}": 100 - 100 / (1 + ratio(E.mean("gain", n), E.mean("loss", n))) for n in RSIS}


def average_distances() -> dict[str, Column]:
    return {f"sma_dist_{n}": ratio(F.col("close"), E.mean("close", n)) - 1 for n in AVERAGES}


def ml_columns() -> dict[str, Column]:
    return returns() | volatilities() | simple_rsis() | average_distances()


def zscores(columns: list[str], n: int = 20) -> dict[str, Column]:
    return {f"{c}_z": E.zscore(c, n) for c in columns}


def candle_metrics() -> dict[str, Column]:
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return {"upper_wick": ratio(F.col("high") - top, F.col("close")), "lower_wick": ratio(bottom - F.col("low"), F.col("close")), "body": ratio(F.abs(F.col("close") - F.col("open")), "close"), "hl_pct": ratio(F.col("high") - F.col("low"), "close")}


def volatility_compression() -> dict[str, Column]:
    return {f"vol_comp_{a}_{b}": ratio(E.deviation("ret_1", a), E.deviation("ret_1", b)) for a, b in ((5, 20), (10, 50))}


def shape() -> dict[str, Column]:
    return {"skew_20": E.rolling_skewness("ret_1", 20), "kurt_20": E.rolling_kurtosis("ret_1", 20)}


def volume_anomaly(n: int = 20) -> dict[str, Column]:
    surge = F.coalesce(F.col("volume") > 1.5 * E.mean("volume", n), F.lit(False)).cast("double")
    return {"volume_z": E.zscore("volume", n), "volume_ratio": ratio(F.col("volume"), E.mean("volume", n)), "volume_surge": surge}


def regime_context() -> dict[str, Column]:
    a14, a50, v20, v100 = E.mean("tr", 14), E.mean("tr", 50), E.deviation("ret_1", 20), E.deviation("ret_1", 100)
    s20, s50 = E.slope("close", 20), E.slope("close", 50)
    sign = lambda s: F.coalesce(F.signum(s), F.lit(0.0))
    return {"atr14_norm": ratio(a14, "close"), "atr50_norm": ratio(a50, "close"), "atr_ratio": ratio(a14, a50), "vol20": v20, "vol100": v100, "vol_ratio": ratio(v20, v100), "trend_slope_20": s20, "trend_slope_50": s50, "trend_sign": sign(s20)}


def with_microstructure(df: DataFrame, prefix: str = "", windows: tuple[int, ...] = CONTEXT_WINDOWS) -> DataFrame:
    """Adds liquidity, pressure and range volatility for each window."""
    r, v = F.col("ret_1"), F.col("volume")
    impact, illiquidity = F.abs(F.col("change")) / F.col("volume_safe"), F.abs(r) / F.col("volume_safe")
    parkinson = F.pow(F.col("log_hl"), 2) / (4 * LN2)
    garman = F.col("log_hl") * F.col("log_hl") * 0.5 - (2 * LN2 - 1) * F.col("log_co") * F.col("log_co")
    rogers = F.col("log_ho") * F.col("log_hc") + F.col("log_lo") * F.col("log_lc")
    both = r.isNotNull() & F.col("ret_lag").isNotNull()
    x, y = F.when(both, r), F.when(both, F.col("ret_lag"))
    shared, out = E.Shared(), {}
    for n in windows:
        k = 0.34 / (1.34 + (n + 1) / (n - 1))
        volume, variance = shared.full(F.sum, "volume", "volume", n), shared.full(F.var_samp, "ret_1", "ret_1", n)
        yang = shared.full(F.var_samp, "oc1", "log_oc1", n) + k * shared.full(F.var_samp, "co", "log_co", n) + (1 - k) * shared.full(F.avg, "rogers", rogers, n)
        apart = shared.over("sd_x", F.stddev_pop(x), n) * shared.over("sd_y", F.stddev_pop(y), n)
        out |= {
            f"amihud_{n}": shared.full(F.avg, "illiquidity", illiquidity, n), f"impact_per_vol_{n}": shared.full(F.avg, "impact", impact, n), f"volume_ratio_{n}": ratio(v, volume / n),
            f"signed_vol_imbalance_{n}": ratio(shared.full(F.sum, "signed", F.signum(r) * v, n), volume),
            f"up_vol_ratio_{n}": ratio(shared.full(F.sum, "up", F.when(r > 0, v).otherwise(0.0), n), volume),
            f"parkinson_vol_{n}": F.sqrt(shared.full(F.avg, "parkinson", parkinson, n)), f"gk_vol_{n}": F.sqrt(shared.full(F.avg, "garman", E.clip(garman, 0.0), n)), f"yz_vol_{n}": F.sqrt(E.clip(yang, 0.0)),
            f"return_autocorr_1_{n}": F.when(shared.over("n_pairs", F.count(x), n) >= n, ratio(shared.over("covar", F.covar_pop(x, y), n), apart)),
            f"variance_ratio_{n}_k2": ratio(shared.full(F.var_samp, "ret_2", "ret_2", n), 2 * variance),
            f"drawdown_min_{n}": shared.full(F.min, "drawdown", "drawdown", n), f"return_min_{n}": shared.full(F.min, "ret_1", "ret_1", n),
        }
    return shared.add(df, {f"{prefix}{c}": x for c, x in out.items()})


def drawdown_islands(df: DataFrame) -> DataFrame:
    """Adds drawdown_depth and drawdown_duration (rows since the last new high)."""
    df = df.withColumn("__island", F.count(F.when(F.col("close") == F.col("peak"), 1)).over(E.so_far()))
    place = F.row_number().over(Window.partitionBy(KEY, "__island").orderBy(TIME)) - 1
    return df.withColumns({"drawdown_depth": F.col("drawdown"), "drawdown_duration": place.cast("double")}).drop("__island")


def with_linreg_channel(df: DataFrame, prefix: str = "", n: int = 100, width: float = 2.0) -> DataFrame:
    """Adds the least-squares line of the last n closes and its band: windows in
    one projection, the line's deviation in the next, the band in the last."""
    x, y = F.col("bar_idx").cast("double"), F.col("close")
    shared = E.Shared()
    full = lambda c: F.when(shared.over("n_close", F.count(y), n) >= n, c)
    slope, middle = full(shared.over("slope", F.regr_slope(y, x), n)), full(shared.over("middle", F.avg(y), n))
    spread = shared.over("var_y", F.var_pop(y), n) - slope * slope * shared.over("var_x", F.var_pop(x), n)
    half = (n - 1) / 2.0
    df = shared.add(df, {f"{prefix}lr_slope": slope, f"{prefix}lr_mid": middle + slope * half, f"{prefix}lr_intercept": middle - slope * half, f"{prefix}lr_dev": full(F.sqrt(F.greatest(spread, F.lit(0.0))))})
    mid, dev = F.col(f"{prefix}lr_mid"), F.col(f"{prefix}lr_dev")
    low, band = mid - width * dev, 2 * width * dev
    return df.withColumns({f"{prefix}lr_upper": mid + width * dev, f"{prefix}lr_lower": low, f"{prefix}lr_width": band, f"{prefix}lr_pos": E.clip(ratio(y - low, band), 0.0, 1.0)})


def rolling_stats(columns: list[str], windows: tuple[int, ...] = (5, 20)) -> dict[str, Column]:
    """From the first row on: windows needn't be full."""
    out: dict[str, Column] = {}
    for c in columns:
        for n in windows:
            out |= {f"{c}_mean_{n}": E.mean(c, n, 1), f"{c}_std_{n}": E.deviation(c, n, 1), f"{c}_max_{n}": E.highest(c, n, 1), f"{c}_min_{n}": E.lowest(c, n, 1), f"{c}_slope_{n}": E.slope(c, n), f"{c}_zscore_{n}": E.zscore(c, n, 1)}
    return out


def signal_streak(df: DataFrame, signal: str, name: str) -> DataFrame:
    """Rows of the same signal in a row, 0 when flat."""
    before = E.lag(signal)
    df = df.withColumn("__new", F.coalesce(before != F.col(signal), F.lit(True)).cast("int"))
    df = df.withColumn("__island", F.sum("__new").over(E.so_far()))
    place = F.row_number().over(Window.partitionBy(KEY, "__island").orderBy(TIME))
    return df.withColumn(name, F.when(F.col(signal) == 0, 0).otherwise(place).cast("int")).drop("__new", "__island")


def rows_since(signal: str, target: int) -> Column:
    """Rows since the signal last had a value; null before."""
    return F.col("bar_idx") - F.last(F.when(F.col(signal) == target, F.col("bar_idx")), ignorenulls=True).over(E.so_far())


def distance_to_extreme(x: str, n: int = 100) -> Column:
    top, bottom = E.highest(x, n, 1), E.lowest(x, n, 1)
    return F.least(F.abs(ratio(F.col(x) - top, top)), F.abs(ratio(F.col(x) - bottom, bottom)))


def daily_pivot() -> dict[str, Column]:
    """(high + low + last close) / 3 of the bar's whole day: it looks ahead within the day."""
    day = Window.partitionBy(KEY, F.to_date(TIME)).orderBy(TIME).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return {"pivot": (F.max("high").over(day) + F.min("low").over(day) + F.last("close").over(day)) / 3.0}


def with_previous_day_pivot(df: DataFrame) -> DataFrame:
    """Adds pivot_prev_day: the pivot of the last day with bars before the bar's own."""
    daily = df.groupBy(KEY, F.to_date(TIME).alias("__day")).agg(F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", TIME).alias("c"))
    before = Window.partitionBy(KEY).orderBy("__day")
    daily = daily.select(KEY, "__day", F.lag((F.col("h") + F.col("l") + F.col("c")) / 3.0).over(before).alias("pivot_prev_day"))
    return df.withColumn("__day", F.to_date(TIME)).join(daily, [KEY, "__day"], "left").drop("__day")


def as_of(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Each left row with the right row's columns of the latest time not after its
    own. One shuffle by symbol: the tables are interleaved and carried forward."""
    keyed = right.select(KEY, TIME, F.struct(*columns).alias("__right"), F.lit(0).alias("__side"))
    asked = left.withColumn("__side", F.lit(1))
    both = asked.unionByName(keyed, allowMissingColumns=True)
    order = Window.partitionBy(KEY).orderBy(TIME, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__right", F.last("__right", ignorenulls=True).over(order)).where("__side = 1")
    return both.select(*left.columns, *(F.col(f"__right.{c}").alias(c) for c in columns))


def clean(df: DataFrame, columns: list[str], backfill: bool = False) -> DataFrame:
    """Infinite to null, carried forward, (if asked, back,) then 0."""
    df = df.withColumns({c: E.finite(c) for c in columns})
    carried = {c: E.carried(c) for c in columns}
    df = df.withColumns(carried)
    if backfill:
        df = df.withColumns({c: E.backfilled(c) for c in columns})
    return df.fillna(0, subset=columns)
