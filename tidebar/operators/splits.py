"""Walk-forward windows and purged folds."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SplitConfig
from ..functions.exprs import KEY, TIME, ratio


#: Rows of a range of the digest, about.
RANGE_ROWS = 4096


@dataclass(frozen=True)
class Split:
    """start <= train < train_end, validation_start <= validation < validation_end."""

    number: int
    train_start: datetime
    train_end: datetime
    validation_start: datetime
    validation_end: datetime


def add_months(at: datetime, months: int) -> datetime:
    """A day the month lacks becomes its last."""
    year, month = divmod(at.year * 12 + at.month - 1 + months, 12)
    for day in range(at.day, 27, -1):
        try:
            return at.replace(year=year, month=month + 1, day=day)
        except ValueError:
            continue
    return at.replace(year=year, month=month + 1)


def calendar_splits(start: datetime, end: datetime, config: SplitConfig = SplitConfig()) -> list[Split]:
    """Windows that slide by months from ``start`` while validation ends by
    ``end``. Starts are stepped one from the other, so a clamped day stays clamped."""
    out, at = [], start
    while True:
        middle = add_months(at, config.train_months)
        stop = add_months(middle, config.validation_months)
        if stop > end:
            return out
        out.append(Split(len(out), at, middle, middle, stop))
        at = add_months(at, config.slide_months)


def median_step(bars: DataFrame) -> timedelta:
    """The median time between bars, over all series."""
    step = F.expr(f"timestampdiff(MICROSECOND, lag({TIME}) over (partition by {KEY} order by {TIME}), {TIME})")
    value = bars.select(step.alias("step")).agg(F.percentile("step", F.lit(0.5))).first()[0]
    return timedelta(microseconds=float(value or 0))


def purged(splits: list[Split], step: timedelta, config: SplitConfig) -> list[Split]:
    """Training ends purge_bars earlier and validation starts embargo_days later;
    windows left empty are dropped."""
    out = []
    for s in splits:
        end, start = s.train_end - step * config.purge_bars, s.validation_start + timedelta(days=config.embargo_days)
        if end > s.train_start and start < s.validation_end and end <= start:
            out.append(Split(s.number, s.train_start, end, start, s.validation_end))
    return out


def splits_frame(bars: DataFrame, splits: list[Split]) -> DataFrame:
    rows = [(s.number, s.train_start, s.train_end, s.validation_start, s.validation_end) for s in splits]
    return bars.sparkSession.createDataFrame(rows, "split int, train_start timestamp_ntz, train_end timestamp_ntz, validation_start timestamp_ntz, validation_end timestamp_ntz")


def assign(bars: DataFrame, splits: list[Split]) -> DataFrame:
    """``bars`` with split and part ("train" or "validation"), a row for each
    window that holds the bar. The windows are a short list on the driver; each
    bar looks its own up, so there is no join and no shuffle."""
    schema = "array<struct<split:int,part:string,a:timestamp_ntz,b:timestamp_ntz>>"
    parts = [F.struct(F.lit(s.number).alias("split"), F.lit(p).alias("part"), F.lit(a).cast("timestamp_ntz").alias("a"), F.lit(b).cast("timestamp_ntz").alias("b")) for s in splits for p, a, b in (("train", s.train_start, s.train_end), ("validation", s.validation_start, s.validation_end))]
    held = F.filter(F.array(*parts).cast(schema) if parts else F.array().cast(schema), lambda x: (F.col(TIME) >= x.a) & (F.col(TIME) < x.b))
    return bars.withColumn("__part", F.explode(held)).withColumns({"split": F.col("__part.split"), "part": F.col("__part.part")}).drop("__part")


def _size() -> Column:
    return F.count("*").over(Window.partitionBy(KEY))


def chronological(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds part: the first ``share`` of each series trains."""
    return df.withColumn("part", F.when(F.col("bar_idx") < F.floor(_size() * share), "train").otherwise("validation"))


def stratified(df: DataFrame, label: str, share: float = 0.2, seed: int = 42, most: int | None = None) -> DataFrame:
    """Adds held_out: ``share`` of each label's rows (at most its part of ``most``
    in all) by a seeded digest of symbol and time; rows that repeat both at the cut
    are all held out. Labels are few: a row for each is broadcast. Rows of a null
    label aren't held out."""
    rank = F.md5(F.concat_ws("|", KEY, F.date_format(TIME, "yyyy-MM-dd HH:mm:ss"), F.lit(str(seed))))
    total = df.count()
    share = min(share, most / total) if most is not None and total else share
    digits = max(1, math.ceil(math.log(max(total / RANGE_ROWS, 1), 16)))
    ranked = df.select(F.col(label).alias("__of"), rank.alias("__rank")).withColumn("__range", F.substring("__rank", 1, digits))
    # A label's rows are never sorted in one place: only those of the range that holds the cut are.
    own = Window.partitionBy("__of")
    sums = ranked.groupBy("__of", "__range").agg(F.count("*").alias("n"))
    sums = sums.withColumns({"wanted": F.floor(F.sum("n").over(own) * share), "end": F.sum("n").over(own.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0))})
    edge = sums.where("end >= wanted and end - n < wanted").select("__of", "__range", (F.col("wanted") - F.col("end") + F.col("n")).alias("__rest"))
    place = F.row_number().over(own.orderBy("__rank"))
    cuts = ranked.join(edge, ["__of", "__range"]).withColumn("__place", place).where("__place = __rest").select("__of", F.col("__rank").alias("__cut"))
    kept = df.withColumn("__rank", rank).join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("__of")), "left")  # a row for each label
    return kept.withColumn("held_out", F.coalesce(F.col("__rank") <= F.col("__cut"), F.lit(False))).drop("__of", "__rank", "__cut")


def purged_folds(df: DataFrame, folds: int = 5, gap: int = 0) -> DataFrame:
    """(bar, fold, part): each fold tests one stretch and trains on what ends
    ``gap`` bars before it; a fold without training rows is skipped."""
    size = F.floor(F.col("n") / folds)
    df = df.withColumn("n", _size()).withColumn("own", F.least(F.floor(F.col("bar_idx") / F.greatest(size, F.lit(1))), F.lit(folds - 1)))
    rows = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    before = F.col("fold") * size - gap
    part = F.when(F.col("own") == F.col("fold"), "test").when(F.col("bar_idx") < before, "train")
    return rows.withColumn("part", part).where(F.col("part").isNotNull() & (before > 0)).drop("n", "own")


def combinatorial_folds(n: int, folds: int = 6, tests: int = 2, gap: int = 0) -> Iterator[tuple[range, list[range]]]:
    """(training rows, test stretches) of every choice of ``tests`` folds; what
    comes before the first of them trains, less ``gap`` rows if there are more."""
    size = n // folds
    stretch = [range(k * size, n if k == folds - 1 else (k + 1) * size) for k in range(folds)]
    for chosen in itertools.combinations(range(folds), tests):
        end = stretch[chosen[0]].start
        end -= gap if end > gap else 0
        if end > 0:
            yield range(end), [stretch[k] for k in chosen]


def combinatorial_assign(df: DataFrame, folds: int = 6, tests: int = 2, gap: int = 0) -> DataFrame:
    """(bar, choice, part): ``combinatorial_folds`` of each series' own length. Choices are
    numbered in order of their folds; those without training rows are left out. A
    list of choices is looked up by each row: there is no join."""
    chosen = [(k, list(c)) for k, c in enumerate(itertools.combinations(range(folds), tests))]
    every = F.array(*(F.struct(F.lit(k).alias("choice"), F.array(*(F.lit(f) for f in c)).alias("tests")) for k, c in chosen))
    size = F.floor(_size() / folds)
    df = df.withColumns({"__size": size, "__fold": F.least(F.floor(F.col("bar_idx") / F.greatest(size, F.lit(1))), F.lit(folds - 1)).cast("int")})
    rows = df.withColumn("__c", F.explode(every))
    first = F.col("__c.tests")[0] * F.col("__size")
    end = F.when(first > gap, first - gap).otherwise(first)
    part = F.when(F.array_contains("__c.tests", F.col("__fold")), "test").when(F.col("bar_idx") < end, "train")
    return rows.where(end > 0).withColumns({"choice": F.col("__c.choice"), "part": part}).where("part is not null").drop("__size", "__fold", "__c")


def embargo_periods(horizon: int) -> int:
    return int(horizon * 1.2)


def walk_forward_report(df: DataFrame, signal: Callable[[DataFrame], DataFrame], folds: int = 5, train_share: float = 0.7, gap: int = 0, anchored: bool = False, periods: int = 252) -> DataFrame:
    """(symbol, fold, part, n, sharpe, total_return) of a strategy. ``signal``
    adds a column signal; returns restart in each part of each fold."""
    sized = df.withColumn("__n", _size()).withColumn("__size", F.floor(F.col("__n") / folds))
    rows = sized.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    start, stop = F.col("fold") * F.col("__size"), (F.col("fold") + 1) * F.col("__size")
    cut = start + F.floor(F.col("__size") * train_share)
    i = F.col("bar_idx")
    part = F.when((i >= (F.lit(0) if anchored else start)) & (i < cut), "train").when((i >= cut + gap) & (i < stop), "test")
    rows = rows.withColumn("part", part).where("part is not null").drop("__n", "__size")
    rows = signal(rows)
    own = Window.partitionBy(KEY, "fold", "part").orderBy(TIME)
    r = F.lag("signal").over(own) * (ratio(F.col("close"), F.lag("close").over(own)) - 1)
    rows = rows.withColumn("r", r)
    sharpe = F.coalesce(F.lit(float(periods) ** 0.5) * F.avg("r") / F.nullif(F.stddev_samp("r"), F.lit(0.0)), F.lit(0.0))
    return rows.groupBy(KEY, "fold", "part").agg(F.count("r").alias("n"), sharpe.alias("sharpe"), (F.product(1 + F.col("r")) - 1).alias("total_return"))


def summary(results: DataFrame, value: str) -> DataFrame:
    """Mean, median, share above 0, mean within the 5th and 95th percentiles."""
    low, high = (results.agg(F.percentile(value, F.lit(p))).first()[0] for p in (0.05, 0.95))
    v = F.col(value)
    inside = v.between(low, high) if low is not None else F.lit(False)
    return results.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.avg(F.when(inside, v)).alias("trimmed_mean"), F.avg((v > 0).cast("double")).alias("positive_share"))


def positional_trimmed_mean(results: DataFrame, keys: list[str], value: str, cut: float = 0.05) -> DataFrame:
    """Mean of the values between their 5% and 95% places, by group (a row a fold: groups are small)."""
    own = Window.partitionBy(*keys)
    ranked = results.where(F.col(value).isNotNull()).withColumns({"__k": F.row_number().over(own.orderBy(value)) - 1, "__n": F.count("*").over(own)})
    a, b = F.floor(F.col("__n") * cut), F.floor(F.col("__n") * (1 - cut))
    inside = (F.col("__k") >= a) & (F.col("__k") < b) | (b <= a)
    return ranked.groupBy(*keys).agg(F.avg(F.when(inside, F.col(value))).alias("trimmed_mean"))


