"""Signal and context modules: kernel columns first, windows over them after.

A module names the kernels it needs and builds its columns on a frame that has
them and ``with_base``'s. Signal modules end in ``signal``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions.exprs import ratio
from . import features as X


@dataclass(frozen=True)
class Module:
    """``build``: a frame with the kernels and base columns to one with ``columns`` (prefixed by the name) added."""

    name: str
    kernels: tuple[str, ...]
    columns: tuple[str, ...]
    build: Callable[[DataFrame], DataFrame]
    signal: str | None = None

    def names(self) -> list[str]:
        return [f"{self.name}_{c}" for c in self.columns]


def _hull(length: int = 1):
    """2 * SMA(half) - SMA(length), volume-weighted over its root; null without volume."""
    half, root = max(round(length / 2), 1), max(round(length**0.5), 1)
    raw = 2 * E.mean("close", half) - E.mean("close", length) if length > 1 else F.col("close")
    return raw, root


def _with_hull(df: DataFrame, name: str, length: int = 1) -> DataFrame:
    raw, root = _hull(length)
    return df.withColumn("__raw", raw).withColumn(name, E.weighted_mean("__raw", "volume", root)).drop("__raw")


def superma(df: DataFrame) -> DataFrame:
    df = _with_hull(df, "superma_hull")
    df = df.withColumns({"superma_topvecMA": E.mean("superma_topvector01", 20), "superma_botvecMA": E.mean("superma_botvector01", 18), "superma_decayt": F.col("atr_17") * 0.005, "superma_decayb": F.col("atr_43") * 0.005})
    up, down = E.crosses_over("superma_hull", "superma_topvecMA"), E.crosses_under("superma_hull", "superma_botvecMA")
    return df.withColumn("superma_signal", F.when(down == 1, -1).when(up == 1, 1).otherwise(0))


def zigzag(df: DataFrame, hls: str, name: str, extreme: int = 3) -> DataFrame:
    """The low or high of the last rows at each turn of ``hls``, carried on."""
    df = df.withColumn("__rising", F.coalesce(F.col(hls) >= E.lag(hls), F.lit(False)))
    before = F.coalesce(E.lag("__rising"), F.lit(False))
    turn = F.when(F.col("__rising") & ~before, E.lowest("close", extreme)).when(~F.col("__rising") & before, E.highest("close", extreme))
    return df.withColumn("__turn", turn).withColumn(name, E.carried("__turn")).drop("__rising", "__turn")


def pyramiding(df: DataFrame, long: str, short: str, prefix: str = "") -> DataFrame:
    """Adds sectionLongs and sectionShorts: raw signals of a side since the last
    of the other side. In a row of both the short counts last."""
    df = df.withColumns({"__shorts": F.sum(short).over(E.so_far()), "__longs": F.sum(long).over(E.so_far())})
    since = lambda island: Window.partitionBy(E.KEY, island).orderBy(E.TIME).rowsBetween(Window.unboundedPreceding, 0)
    longs = F.sum(F.when(F.col(short) == 1, 0).otherwise(F.col(long))).over(since("__shorts"))
    shorts = F.sum(short).over(since("__longs"))
    return df.withColumns({f"{prefix}sectionLongs": longs.cast("int"), f"{prefix}sectionShorts": shorts.cast("int")}).drop("__shorts", "__longs")


def trendmagic(df: DataFrame) -> DataFrame:
    p = "trendmagic_"
    df = zigzag(df, "hls_10", p + "zigzag")
    df = df.withColumns({p + "price": F.col("close"), p + "hls": F.col("hls_8"), "__t": (F.col(p + "topvector01") + F.col("close")) / 2, "__b": (F.col(p + "botvector01") + F.col("close")) / 2})
    df = df.withColumns({p + "topavg": E.weighted_mean("__t", "volume", 9), p + "botavg": E.weighted_mean("__b", "volume", 9)})
    df = df.withColumns({p + "topsig": F.col(p + "topavg") * (1 + 0.01 / 100), p + "botsig": F.col(p + "botavg") * (1 - 0.055 / 100)})
    df = df.withColumn(p + "width", ratio(F.col(p + "topsig") - F.col(p + "botsig"), (F.col(p + "avg_vec") + F.col("close")) / 2))
    df = df.withColumns({p + "long_raw": E.crosses_under(p + "zigzag", p + "botsig"), p + "short_raw": E.crosses_over(p + "zigzag", p + "topsig")})
    df = pyramiding(df, p + "long_raw", p + "short_raw", p)
    allowed = lambda raw, n: ((F.col(raw) == 1) & ((F.col(n) <= 1) | (F.col(n) >= 1_000_000))).cast("int")
    df = df.withColumns({p + "longCondition": allowed(p + "long_raw", p + "sectionLongs"), p + "shortCondition": allowed(p + "short_raw", p + "sectionShorts")})
    return df.withColumn(p + "signal", F.when(F.col(p + "shortCondition") == 1, -1).when(F.col(p + "longCondition") == 1, 1).otherwise(0)).drop("__t", "__b")


def pvt_residual(df: DataFrame, length: int = 23, factor: float = 10_000.0, bound: float = 520.0) -> DataFrame:
    """Adds nRes and the latched signal: the last strong move by a candle of its own direction."""
    df = df.withColumn("pvt_nRes", (F.col("close") - E.mean("close", length)) * factor)
    event = F.when((F.col("pvt_nRes") > bound) & (F.col("close") > F.col("open")), 1).when((F.col("pvt_nRes") < -bound) & (F.col("close") < F.col("open")), -1)
    return df.withColumn("__event", event).withColumn("pvt_sig_pvt", F.coalesce(E.carried("__event"), F.lit(0))).drop("__event")


def pvt(df: DataFrame) -> DataFrame:
    df = _with_hull(pvt_residual(df), "pvt_hull")
    df = df.withColumns({"pvt_topvecMA": E.mean("pvt_topvector01", 20), "pvt_botvecMA": E.mean("pvt_botvector01", 18)})
    df = df.withColumns({"pvt_vecavg": (F.col("pvt_topvecMA") + F.col("pvt_botvecMA")) / 2, "__up": E.crosses_over("pvt_hull", "pvt_topvecMA"), "__down": E.crosses_under("pvt_hull", "pvt_botvecMA"), "__before": E.lag("pvt_sig_pvt")})
    last = lambda c: F.max(F.when(F.col(c) == 1, F.col("bar_idx")).otherwise(0)).over(E.so_far())
    df = df.withColumns({"__long": last("__up") > last("__down"), "__short": last("__down") > last("__up")})
    turned = lambda side: F.coalesce(F.col("__before") != side, F.lit(True)) & (F.col("pvt_sig_pvt") == side)
    df = df.withColumns({"pvt_finallongcond": E.flag(~F.col("__long") & turned(1) & (F.col("pvt_hull") > F.col("pvt_vecavg"))), "pvt_finalshortcond": E.flag(~F.col("__short") & turned(-1) & (F.col("pvt_hull") < F.col("pvt_vecavg")))})
    return df.withColumn("pvt_signal", F.when(F.col("pvt_finalshortcond") == 1, -1).when(F.col("pvt_finallongcond") == 1, 1).otherwise(0)).drop("__up", "__down", "__before", "__long", "__short")


def pivots_rsi(df: DataFrame) -> DataFrame:
    p = "pivots_rsi_"
    df = df.withColumns({p + "macd": F.col("ema_13") - F.col("ema_21"), p + "pivot": X.daily_pivot()["pivot"], p + "rsi": F.col("rsi_14")})
    df = df.withColumn(p + "macd_signal", E.mean(p + "macd", 8))
    return df.withColumns({p + "macd_hist": F.col(p + "macd") - F.col(p + "macd_signal"), p + "rsi_overbought": E.flag(F.col(p + "rsi") > 70), p + "rsi_oversold": E.flag(F.col(p + "rsi") < 30)})


def linreg(df: DataFrame) -> DataFrame:
    return X.with_linreg_channel(df, "linreg_")


def ohlcv(df: DataFrame) -> DataFrame:
    share = F.nullif(ratio("atr_14", "close"), F.lit(0.0))
    df = df.withColumns({"ohlcv_mem_vol": F.col("mem_vol"), "ohlcv_mem_vol_resid": F.ln(F.nullif("close", F.lit(0.0))) - F.col("mem_vol"), "ohlcv_mem_vol_slope": F.col("mem_vol") - E.lag("mem_vol")})
    df = df.withColumn("ohlcv_mem_vol_resid_norm", F.col("ohlcv_mem_vol_resid") / share)
    df = X.drawdown_islands(df).withColumnsRenamed({"drawdown_depth": "ohlcv_drawdown_depth", "drawdown_duration": "ohlcv_drawdown_duration"})
    return X.with_microstructure(df, "ohlcv_")


MODULES = {
    m.name: m
    for m in (
        Module("superma", ("superma_topvector01", "superma_botvector01", "atr_17", "atr_43"), ("hull", "topvector01", "botvector01", "topvecMA", "botvecMA", "decayt", "decayb"), superma, "superma_signal"),
        Module("trendmagic", ("hls_8", "hls_10", "trendmagic_topvector01", "trendmagic_botvector01", "trendmagic_avg_vec"), ("zigzag", "topvector01", "botvector01", "price", "hls", "avg_vec", "topavg", "botavg", "topsig", "botsig", "width", "long_raw", "short_raw", "sectionLongs", "sectionShorts", "longCondition", "shortCondition"), trendmagic, "trendmagic_signal"),
        Module("pvt", ("pvt_topvector01", "pvt_botvector01"), ("nRes", "sig_pvt", "hull", "topvector01", "botvector01", "topvecMA", "botvecMA", "vecavg", "finallongcond", "finalshortcond"), pvt, "pvt_signal"),
        Module("pivots_rsi", ("ema_13", "ema_21", "rsi_14"), ("macd", "macd_signal", "macd_hist", "pivot", "rsi", "rsi_overbought", "rsi_oversold"), pivots_rsi),
        Module("linreg", (), ("lr_mid", "lr_slope", "lr_intercept", "lr_dev", "lr_upper", "lr_lower", "lr_width", "lr_pos"), linreg),
        Module("ohlcv", ("mem_vol", "atr_14"), ("mem_vol", "mem_vol_resid", "mem_vol_resid_norm", "mem_vol_slope", "drawdown_depth", "drawdown_duration", *(f"{n}_{w}{s}" for w in X.CONTEXT_WINDOWS for n, s in (("amihud", ""), ("impact_per_vol", ""), ("volume_ratio", ""), ("signed_vol_imbalance", ""), ("up_vol_ratio", ""), ("parkinson_vol", ""), ("gk_vol", ""), ("yz_vol", ""), ("return_autocorr_1", ""), ("variance_ratio", "_k2"), ("drawdown_min", ""), ("return_min", "")))), ohlcv),
    )
}
