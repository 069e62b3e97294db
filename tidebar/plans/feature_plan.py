"""Compiling a feature configuration to one plan: kernels, then windows.

Modules left out and columns filtered out never enter the plan: only the kernels
that the chosen modules need run, and Spark prunes windows that nothing reads.
Training, backtests and inference all use the plan of one configuration.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FeatureConfig
from ..functions import exprs as E
from ..functions.exprs import KEY, TIME
from ..operators import features as X
from ..operators.kernels import run_kernels
from ..operators.modules import MODULES, Module

BARS = [KEY, TIME, "open", "high", "low", "close", "volume", "bar_idx"]


def chosen_modules(config: FeatureConfig, registry: dict[str, Module] | None = None) -> list[Module]:
    known = {k.lower(): m for k, m in (registry or MODULES).items()}
    missing = [m for m in config.modules if m.lower() not in known]
    if missing:
        raise KeyError(f"unknown modules: {', '.join(missing)}")
    return [known[m.lower()] for m in config.modules]


def filtered(names: Iterable[str], config: FeatureConfig) -> list[str]:
    """Distinct names, first ones first, that match include and not exclude."""
    kept = [n for n in dict.fromkeys(names) if (not config.include or re.search(config.include, n)) and not (config.exclude and re.search(config.exclude, n))]
    if not kept:
        raise ValueError("no feature is left")
    if len(kept) > config.most_columns:
        raise ValueError(f"{len(kept)} features; at most {config.most_columns}")
    return kept


def _dynamics(df: DataFrame, signals: list[str], have: set[str]) -> tuple[DataFrame, list[str]]:
    names: list[str] = []
    for s in signals:
        df = X.signal_streak(df, f"{s}_signal", f"dyn_{s}_streak")
        df = df.withColumns({f"dyn_{s}_since_long": X.rows_since(f"{s}_signal", 1), f"dyn_{s}_since_short": X.rows_since(f"{s}_signal", -1)})
        names += [f"dyn_{s}_streak", f"dyn_{s}_since_long", f"dyn_{s}_since_short"]
        if f"{s}_hull" in have:
            df = df.withColumn(f"dyn_{s}_extreme", X.distance_to_extreme(f"{s}_hull"))
            names.append(f"dyn_{s}_extreme")
        ends = {f"dyn_{s}_{side}_diff": F.col(f"{s}_{side}vector01") - E.lag(f"{s}_{side}vector01") for side in ("top", "bot")}
        df = df.withColumns(ends)
        names += list(ends)
    return df, names


def build(bars: DataFrame, config: FeatureConfig = FeatureConfig(), registry: dict[str, Module] | None = None) -> DataFrame:
    """Key, bars and features, cleaned; and each signal module's signal."""
    modules = chosen_modules(config, registry)
    kernels = [k for m in modules for k in m.kernels] + (["atr_7", "atr_14", "atr_21"] if "ml" in config.groups else [])
    df = X.with_base(run_kernels(bars.select(*BARS), kernels))
    names: list[str] = []
    for m in modules:
        df = m.build(df)
        names += m.names()
    have = set(names)
    signals = [m.name for m in modules if m.signal]
    if "ml" in config.groups:
        ml = X.ml_columns()
        df = df.withColumns({f"ml_{k}": v for k, v in ml.items()})
        more = X.zscores([f"ml_{k}" for k in ml]) | {f"ml_{k}": v for k, v in (X.candle_metrics() | X.volatility_compression() | X.shape() | X.volume_anomaly()).items()} | {f"ml_atr_pct_{n}": E.ratio(f"atr_{n}", "close") for n in (7, 14, 21)}
        df = df.withColumns(more)
        names += [f"ml_{k}" for k in ml] + list(more)
    if "regime" in config.groups:
        context = {f"regime_{k}": v for k, v in X.regime_context().items()}
        df = df.withColumns(context)
        names += list(context)
    if "dynamics" in config.groups and signals:
        df, more_names = _dynamics(df, signals, have)
        names += more_names
    if "rolling" in config.groups:
        sources = [c for c in ("superma_hull", "trendmagic_hls", "pvt_hull") if c in have]
        stats = {f"stats_{k}": v for k, v in X.rolling_stats(sources).items()}
        if stats:
            df = df.withColumns(stats)
        names += list(stats)
    kept = filtered(names, config)
    df = df.select(*BARS, *kept, *(f"{s}_signal" for s in signals))
    df = X.clean(df.withColumns({c: F.col(c).cast("double") for c in kept}), kept, config.backfill)
    return df.withColumns({c: F.col(c).cast("float") for c in kept}) if config.float32 else df


def module_columns(features: DataFrame, module: str) -> DataFrame:
    """One module's columns without its prefix."""
    p = f"{module}_"
    return features.select(KEY, TIME, *(F.col(c).alias(c[len(p) :]) for c in features.columns if c.startswith(p)))


def in_model_order(features: DataFrame, columns: list[str]) -> DataFrame:
    have = set(features.columns)
    return features.select(KEY, TIME, *(F.col(c) if c in have else F.lit(0.0).alias(c) for c in columns))
