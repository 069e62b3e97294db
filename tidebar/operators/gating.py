"""From probabilities to signals: expected value and the gates, in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Policy
from ..functions.exprs import KEY, TIME, clip

#: Calibration tables are broadcast up to this many rows; larger ones are refused.
MOST_BINS = 10_000


def expected_value(df: DataFrame, bins: DataFrame, prob: str = "prob", side: str = "side", regime: str = "regime") -> DataFrame:
    """Adds ev: the mean value of the bins that hold the row's probability (both
    ends included), of the first tier that has one: own regime and side, own
    side, own regime, any. If none does, the nearest bin of the first tier that
    has rows (the first in order of edges of several as near). A null side or
    regime in ``bins`` (prob_min, prob_max, ev, side, regime) matches any. An
    empty table gives null."""
    rows = bins.where("ev is not null and prob_max > prob_min").limit(MOST_BINS + 1).orderBy("prob_min", "prob_max", "side", "regime").collect()
    if len(rows) > MOST_BINS:
        raise ValueError(f"over {MOST_BINS} calibration bins")
    if not rows:
        return df.withColumn("ev", F.lit(None).cast("double"))
    spark = df.sparkSession
    packed = spark.createDataFrame([([(float(r.prob_min), float(r.prob_max), float(r.ev), r.side, r.regime) for r in rows],)], "bins array<struct<a:double,b:double,ev:double,side:string,regime:string>>")
    with_bins = df.join(F.broadcast(packed), F.lit(True))  # one row
    p, s, g = F.col(prob), F.col(side), F.col(regime)
    wild = lambda x, v: x.isNull() | (x == v)
    tiers = [lambda x: wild(x.side, s) & wild(x.regime, g), lambda x: wild(x.side, s), lambda x: wild(x.regime, g), lambda x: F.lit(True)]
    mean = lambda found: F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda acc, x: acc + x.ev) / F.size(found))
    holding = lambda t: lambda x: t(x) & (x.a <= p) & (p <= x.b)
    held = [mean(F.filter("bins", holding(t))) for t in tiers]
    gap = lambda x: F.abs((x.a + x.b) / 2 - p)
    nearest = []
    for t in tiers:
        keyed = F.transform(F.filter("bins", t), lambda x, i: F.struct(gap(x).alias("d"), i.alias("i"), x.ev.alias("ev")))
        nearest.append(F.array_min(keyed).ev)
    return with_bins.withColumn("ev", F.when(p.isNotNull(), F.coalesce(*held, *nearest))).drop("bins")


def _side_allowed(policy: Policy) -> Column:
    allowed = lambda table: reduce(lambda acc, kv: acc.when(F.col("regime") == kv[0], kv[1]), table.items(), F.when(F.lit(False), False)).otherwise(False)
    return F.when(F.col("signal") > 0, allowed(policy.long)).when(F.col("signal") < 0, allowed(policy.short)).otherwise(True)


def gate(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Adds final_signal. ``df``: signal, prob, regime, ev and, if agreement is
    asked for, blend_signal and blend_prob (it is an error if they are missing).
    In order: chop, confidence, agreement (of shorts alone), expected value, side
    policy, shorts off, short cap."""
    if policy.require_agreement and (missing := {"blend_signal", "blend_prob"} - set(df.columns)):
        raise ValueError(f"the policy asks for agreement; missing: {', '.join(sorted(missing))}")
    trend = F.col("regime").isin("trend_up", "trend_down")
    needed = lambda p: F.when(trend, p * policy.trend_factor).otherwise(p)
    s, p = F.col("signal"), F.col("prob")
    ok = F.when(s > 0, p >= needed(policy.p_long)).when(s < 0, p >= needed(policy.p_short)).otherwise(True)
    if policy.skip_chop:
        ok = ok & (F.col("regime") != "chop")
    if policy.require_agreement:
        ok = ok & ((s >= 0) | ((F.col("blend_signal") < 0) & (F.col("blend_prob") >= policy.agreement_floor)))
    if policy.min_ev > 0:
        ok = ok & (F.coalesce(F.col("ev"), F.lit(0.0)) >= policy.min_ev)
    ok = ok & _side_allowed(policy)
    if policy.disable_shorts:
        ok = ok & (s >= 0)
    return cap_shorts(df.withColumn("final_signal", F.when(F.coalesce(ok, F.lit(False)), s).otherwise(0).cast("int")), policy)


def cap_shorts(df: DataFrame, policy: Policy, signal: str = "final_signal") -> DataFrame:
    """Within each series, shorts beyond ``short_cap`` of all signals become 0,
    those first by a seeded digest of symbol and time."""
    own = Window.partitionBy(KEY)
    shorts, total = F.count_if(F.col(signal) < 0).over(own), F.count_if(F.col(signal) != 0).over(own)
    excess = F.floor(F.round(shorts - policy.short_cap * total, 9)).cast("int")
    rank = F.md5(F.concat_ws("|", KEY, F.col("bar_idx").cast("string"), F.lit(str(policy.seed))))
    order = F.row_number().over(Window.partitionBy(KEY, F.col(signal) < 0).orderBy(rank))
    return df.withColumn(signal, F.when((F.col(signal) < 0) & (order <= excess), 0).otherwise(F.col(signal)))


def confidence(regime_probs: str = "regime_probs", direction_probs: str = "direction_probs") -> Column:
    """The product of the largest probabilities."""
    return F.array_max(regime_probs) * F.array_max(direction_probs)


def argmax_signal(probs: str = "probs", classes: tuple[int, ...] = (-1, 0, 1), least: float = 0.0) -> Column:
    """The likeliest class (the first of several); 0 if it isn't likely enough."""
    top = F.array_max(probs)
    return F.when(top < least, 0).otherwise(F.array(*(F.lit(c) for c in classes))[F.array_position(probs, top).cast("int") - 1]).cast("int")


def risk_clip(signal: Column, most: float = 1.0) -> Column:
    return clip(signal.cast("double"), -most, most)


def ev_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("ev").alias("n"), F.avg("ev").alias("mean_ev"), F.percentile("ev", F.lit(0.5)).alias("median_ev"), F.count_if(F.col("ev") > 0).alias("n_positive"), F.count_if(F.col("final_signal") != 0).alias("n_signals"))


def regime_code() -> Column:
    """trend_up 0, trend_down 1, chop 2."""
    return F.when(F.col("regime") == "trend_up", 0).when(F.col("regime") == "trend_down", 1).otherwise(2)


def blend_inputs(features: DataFrame, columns: list[str], modules: list[str]) -> DataFrame:
    """Key, features in order (0 where missing), each module's signal, the regime's code."""
    have = set(features.columns)
    return features.select(KEY, TIME, *(F.col(c) if c in have else F.lit(0.0).alias(c) for c in columns), *(F.col(f"{m}_signal") for m in modules), regime_code().alias("regime"))
