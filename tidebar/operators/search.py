"""Choosing among configurations: grids, ablations, a bandit."""

from __future__ import annotations

import dataclasses
import math
import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FeatureConfig, digest
from .splits import positional_trimmed_mean


def grid_summary(results: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, median, trimmed mean, share above 0 and extremes of each configuration."""
    v = F.col(value)
    plain = results.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.avg((v > 0).cast("double")).alias("positive_share"), F.min(v).alias("worst"), F.max(v).alias("best"))
    return plain.join(positional_trimmed_mean(results, keys, value), keys)


def configurations(base: FeatureConfig, subsets: int = 10, seed: int = 42) -> list[FeatureConfig]:
    """The base, it without each group, it without each module, and random subsets."""
    out = [base]
    out += [dataclasses.replace(base, groups=tuple(x for x in base.groups if x != g)) for g in base.groups]
    out += [dataclasses.replace(base, modules=tuple(x for x in base.modules if x != m)) for m in base.modules]
    rng = random.Random(seed)
    for _ in range(subsets):
        out.append(dataclasses.replace(base, modules=tuple(m for m in base.modules if rng.random() < 0.6) or base.modules[:1], groups=tuple(g for g in base.groups if rng.random() < 0.6)))
    return list({digest(c): c for c in out}.values())


@dataclass
class Arm:
    """Running mean and sum of squares of an arm's rewards."""

    n: int = 0
    mean: float = 0.0
    m2: float = 0.0

    def add(self, reward: float) -> None:
        self.n += 1
        delta = reward - self.mean
        self.mean += delta / self.n
        self.m2 += delta * (reward - self.mean)

    @property
    def variance(self) -> float:
        return self.m2 / (self.n - 1) if self.n > 1 else 0.0


@dataclass
class Bandit:
    """Thompson sampling: an arm's deviation is at least ``prior``, over the root of
    its plays and one; arms of too few plays come first, one of them at random."""

    arms: dict[str, Arm] = field(default_factory=dict)
    least_plays: int = 1
    prior: float = 0.05
    seed: int = 42

    def choose(self, names: list[str]) -> str:
        rng = random.Random(f"{self.seed}:{sum(a.n for a in self.arms.values())}")
        fresh = [n for n in names if self.arms.setdefault(n, Arm()).n < self.least_plays]
        if fresh:
            return rng.choice(fresh)
        draw = lambda a: rng.gauss(a.mean, max(math.sqrt(a.variance), self.prior) / math.sqrt(a.n + 1))
        return max(names, key=lambda n: draw(self.arms[n]))


def reward(value: float, drawdown: float, penalty: float = 0.5) -> float:
    return value - penalty * abs(min(drawdown, 0.0))


def acceptable(drawdown: float, most: float = 0.30) -> bool:
    return abs(drawdown) <= most


def best_run(runs: list[dict], value: str = "reward", drawdown: str = "max_drawdown", most: float = 0.30) -> dict | None:
    good = [r for r in runs if acceptable(r[drawdown], most)]
    return max(good, key=lambda r: r[value]) if good else None
