"""Defaults as data."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field

REGIMES = ("trend_up", "trend_down", "chop")


@dataclass(frozen=True)
class CostModel:
    fee_bps: float = 4.5
    slippage_bps: float = 1.0

    @property
    def per_side(self) -> float:
        return (self.fee_bps + self.slippage_bps) / 10_000.0


@dataclass(frozen=True)
class LabelConfig:
    horizon: int = 12
    threshold: float = 0.0005
    smoothing: int = 12
    cost_bps_per_side: float = 5.5
    cost_adjusted: bool = False


@dataclass(frozen=True)
class SplitConfig:
    train_months: int = 6
    validation_months: int = 1
    slide_months: int = 1
    purge_bars: int = 0
    embargo_days: int = 0


@dataclass(frozen=True)
class FeatureConfig:
    modules: tuple[str, ...] = ("superma", "trendmagic", "pvt", "pivots_rsi", "linreg", "ohlcv")
    groups: tuple[str, ...] = ("ml", "regime", "dynamics", "rolling")
    include: str | None = None
    exclude: str | None = None
    regime_minimum_rows: int = 0
    backfill: bool = False
    float32: bool = False
    most_columns: int = 2000

    def fingerprint(self) -> str:
        return digest(self)


@dataclass(frozen=True)
class Policy:
    """What each regime allows; ``skip_chop`` drops chop before all else."""

    long: dict[str, bool] = field(default_factory=lambda: {"trend_up": True, "trend_down": False, "chop": False})
    short: dict[str, bool] = field(default_factory=lambda: {"trend_up": False, "trend_down": True, "chop": False})
    skip_chop: bool = True
    disable_shorts: bool = False
    p_long: float = 0.60
    p_short: float = 0.60
    trend_factor: float = 0.8
    agreement_floor: float = 0.25
    require_agreement: bool = True
    min_ev: float = 0.0
    short_cap: float = 0.70
    seed: int = 42


def _only(*regimes: str) -> dict[str, bool]:
    return {r: r in regimes for r in REGIMES}


#: The regimes each named profile allows longs and shorts in.
PROFILES: dict[str, Policy] = {
    "default": Policy(),
    "trend_up_only": Policy(long=_only("trend_up"), short=_only(), disable_shorts=True),
    "short_only": Policy(long=_only(), short=_only("trend_down")),
    "full": Policy(long=_only("trend_up"), short=_only("trend_down")),
    "full_aggressive": Policy(long=_only("trend_up", "chop"), short=_only("trend_down", "chop"), skip_chop=False),
}


def profile(name: str) -> Policy:
    if name not in PROFILES:
        raise KeyError(f"unknown profile {name!r}; known: {', '.join(sorted(PROFILES))}")
    return PROFILES[name]


def digest(config: object) -> str:
    """A stable name for a configuration."""
    return hashlib.sha256(json.dumps(dataclasses.asdict(config), sort_keys=True, default=str).encode()).hexdigest()[:16]  # type: ignore[call-overload]
