"""Recurrences over one series: what window frames can't express.

Each kernel is a plain function on NumPy arrays in time order; ``run_kernels``
runs those asked for in one grouped pass, one group per symbol, and returns the
bars with their columns. Smoothing follows pandas' ``ewm(adjust=False)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.exprs import KEY, TIME


def ema(x: np.ndarray, span: int) -> np.ndarray:
    return pd.Series(x).ewm(span=span, adjust=False, min_periods=span).mean().to_numpy()


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return pd.Series(x).ewm(alpha=1.0 / n, adjust=False, min_periods=n).mean().to_numpy()


def triple_ema(x: np.ndarray, n: int) -> np.ndarray:
    """EMAs of n, 0.628 n and 0.314 n rows, one over the other."""
    for share in (1.0, 0.628, 0.314):
        x = ema(x, int(round(n * share)))
    return x


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate(([np.nan], close[:-1]))
    return np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))


def rsi(close: np.ndarray, n: int) -> np.ndarray:
    """Wilder's; 100 without losses, null without movement."""
    delta = np.concatenate(([np.nan], np.diff(close)))
    gain, loss = wilder(np.where(delta > 0, delta, delta * 0), n), wilder(np.where(delta < 0, -delta, delta * 0), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 100 - 100 / (1 + gain / loss)


def adx(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> np.ndarray:
    up, down = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    atr = wilder(true_range(high, low, close), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        atr = np.where(atr == 0, np.nan, atr)
        p, m = 100 * wilder(plus, n) / atr, 100 * wilder(minus, n) / atr
        both = p + m
        return wilder(100 * np.abs(p - m) / np.where(both == 0, np.nan, both), n)


@dataclass(frozen=True)
class Stages:
    """Decay factors by rows since the last touch: the first up to its limit, and so on."""

    factors: tuple[float, float, float]
    limits: tuple[int, int]

    def at(self, since: int) -> float:
        return self.factors[0] if since <= self.limits[0] else self.factors[1] if since <= self.limits[1] else self.factors[2]


def decaying_extreme(price: np.ndarray, decay: np.ndarray, stages: Stages, side: int) -> np.ndarray:
    """The running extreme (side 1 above, -1 below) that gives way by
    decay * factor in each row that doesn't touch it."""
    out = np.empty(len(price))
    decay = np.nan_to_num(decay, nan=0.0)
    level, factor, touched = np.nan, stages.factors[0], None
    for i, x in enumerate(price):
        if level != level:
            level = x
        if side * (x - level) >= 0:
            level, touched = x, i
        else:
            level -= side * decay[i] * factor
        out[i] = level
        factor = stages.at(0 if touched is None else i - touched)
    return out


def adaptive_memory(x: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """EMA whose weight is given by row; a null value or weight carries the last."""
    out, last = np.full(len(x), np.nan), np.nan
    for i, (v, a) in enumerate(zip(x, alpha, strict=True)):
        if v == v:
            if last != last:
                last = v
            elif a == a:
                last += a * (v - last)
        out[i] = last
    return out


def memory_alpha(atr: np.ndarray, close: np.ndarray, base: float = 0.20, low: float = 0.02, high: float = 0.60) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        share = atr / np.where(close == 0, np.nan, close)
        return np.clip(base / (np.where(share == 0, np.nan, share) + 1e-9), low, high)


def skip_ahead_trades(signal: np.ndarray, close: np.ndarray, horizon: int) -> np.ndarray:
    """The gross return of each trade taken, at its entry: a signal is traded for
    ``horizon`` rows and those in between are skipped."""
    out, i = np.full(len(close), np.nan), 0
    while i + horizon < len(close):
        a, b = close[i], close[i + horizon]
        if signal[i] == 0 or not (np.isfinite(a) and np.isfinite(b)) or a == 0:
            i += 1
            continue
        out[i] = (b / a - 1.0) * np.sign(signal[i])
        i += horizon
    return out


SUPERMA = (Stages((35, 15, 12), (87, 348)), Stages((30, 15, 12), (87, 348)))
PVT = (Stages((35, 15, 12), (87, 174)), Stages((28, 9, 25), (87, 174)))
TRENDMAGIC = (Stages((18, 12, 12), (87, 87)), Stages((24, 12, 12), (87, 87)))
#: Share of the ATR that an envelope gives way by, for each unit of its factor.
DECAY = 0.005


class SeriesFrame:
    """One symbol's columns, and what kernels share."""

    def __init__(self, frame: pd.DataFrame):
        self.frame = frame
        self.kept: dict[str, np.ndarray] = {}

    def __getattr__(self, name: str) -> np.ndarray:
        return self.frame[name].to_numpy(float)

    def once(self, name: str, make: Callable[[], np.ndarray]) -> np.ndarray:
        if name not in self.kept:
            self.kept[name] = make()
        return self.kept[name]

    def atr(self, n: int) -> np.ndarray:
        tr = self.once("tr", lambda: true_range(self.high, self.low, self.close))
        return self.once(f"atr{n}", lambda: wilder(tr, n))


def _average_vector(s: SeriesFrame) -> np.ndarray:
    top, bottom = (KERNELS[f"trendmagic_{x}"](s) for x in ("topvector01", "botvector01"))
    return ema((top + bottom) / 2.0, 9)


KERNELS: dict[str, Callable[[SeriesFrame], np.ndarray]] = {
    **{f"ema_{n}": (lambda s, n=n: ema(s.close, n)) for n in (5, 10, 12, 13, 20, 21, 26, 50)},
    **{f"atr_{n}": (lambda s, n=n: s.atr(n)) for n in (7, 10, 14, 17, 21, 43)},
    "rsi_14": lambda s: rsi(s.close, 14),
    "adx_14": lambda s: adx(s.high, s.low, s.close, 14),
    "hls_8": lambda s: triple_ema(s.close, 8),
    "hls_10": lambda s: triple_ema(s.close, 10),
    "superma_topvector01": lambda s: s.once("st", lambda: decaying_extreme(s.close, s.atr(17) * DECAY, SUPERMA[0], 1)),
    "superma_botvector01": lambda s: s.once("sb", lambda: decaying_extreme(s.close, s.atr(43) * DECAY, SUPERMA[1], -1)),
    "pvt_topvector01": lambda s: s.once("pt", lambda: decaying_extreme(s.close, s.atr(17) * DECAY, PVT[0], 1)),
    "pvt_botvector01": lambda s: s.once("pb", lambda: decaying_extreme(s.close, s.atr(43) * DECAY, PVT[1], -1)),
    "trendmagic_topvector01": lambda s: s.once("tt", lambda: decaying_extreme(s.close, s.atr(10) * DECAY, TRENDMAGIC[0], 1)),
    "trendmagic_botvector01": lambda s: s.once("tb", lambda: decaying_extreme(s.close, s.atr(10) * DECAY, TRENDMAGIC[1], -1)),
    "trendmagic_avg_vec": _average_vector,
    "mem_vol": lambda s: adaptive_memory(np.log(np.where(s.close > 0, s.close, np.nan)), memory_alpha(s.atr(14), s.close)),
}


def _grouped(df: DataFrame, fields: dict[str, Callable[[SeriesFrame], np.ndarray]]) -> DataFrame:
    schema = StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in fields)])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(TIME, kind="stable")
        series = SeriesFrame(frame)
        with np.errstate(all="ignore"):
            made = {n: np.asarray(f(series), float) for n, f in fields.items()}
        return frame.assign(**{n: np.where(np.isfinite(v), v, np.nan) for n, v in made.items()})

    out = df.groupBy(KEY).applyInPandas(run, schema)
    return out.withColumns({n: F.nanvl(F.col(n), F.lit(None).cast("double")) for n in fields})


def run_kernels(bars: DataFrame, names: Iterable[str]) -> DataFrame:
    """``bars`` with the named kernels' columns (see KERNELS), in one pass."""
    wanted = {n: KERNELS[n] for n in dict.fromkeys(names)}
    return _grouped(bars, wanted) if wanted else bars


def greedy_trades(bars: DataFrame, signal: str = "signal", horizon: int = 12) -> DataFrame:
    """``bars`` with trade_gross double at each trade's entry, else null."""
    return _grouped(bars, {"trade_gross": lambda s: skip_ahead_trades(getattr(s, signal), s.close, horizon)})
