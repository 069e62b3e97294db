"""Registered queries of the bar operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import CostModel, LabelConfig, Policy, SplitConfig
from .functions import exprs as E
from .operators import backtest as B
from .operators import checks as T
from .operators import features as X
from .operators import gating as G
from .operators import labels as L
from .operators import models as M
from .operators import modules as O
from .operators import splits as W
from .operators.kernels import greedy_trades, run_kernels
from .operators.search import grid_summary
from .plans.feature_plan import build
from .sources import bars as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, keys: list[str], columns: list[str] | dict[str, Column], places: int = 6) -> DataFrame:
    named = columns if isinstance(columns, dict) else {c: F.col(c) for c in columns}
    return df.select(*keys, *(F.round(v.cast("double"), places).alias(k) for k, v in named.items()))


def of_bars(df: DataFrame, columns: list[str] | dict[str, Column], places: int = 6) -> DataFrame:
    return rounded(df, ["symbol", "bar_idx"], columns, places)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.with_base(S.hourly_bars(spark, sf_dir))


@query
def bars_hourly(spark, sf_dir):
    return of_bars(S.hourly_bars(spark, sf_dir), ["open", "high", "low", "close", "volume"])


@query
def bars_daily_orders(spark, sf_dir):
    return of_bars(S.daily_order_bars(spark, sf_dir), ["open", "high", "low", "close", "volume"], 2)


@query
def bars_resampled(spark, sf_dir):
    return of_bars(S.numbered(S.resample(S.hourly_bars(spark, sf_dir), "6 hours")), ["open", "high", "low", "close", "volume"])


@query
def first_of_each_time(spark, sf_dir):
    ticks = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("close"))
    return rounded(S.first_of_each_time(ticks, "key"), ["symbol", "key"], ["close"], 2)


@query
def bar_quality(spark, sf_dir):
    return T.quality_counts(S.hourly_bars(spark, sf_dir))


@query
def bars_tail(spark, sf_dir):
    return of_bars(S.tail(S.hourly_bars(spark, sf_dir), 24), ["close"])


@query
def bars_between(spark, sf_dir):
    return of_bars(S.between(S.hourly_bars(spark, sf_dir), datetime(2024, 1, 8), datetime(2024, 1, 15)), ["close"])


@query
def true_range_atr_sma(spark, sf_dir):
    return of_bars(base(spark, sf_dir), {"tr": F.col("tr"), "atr_14": E.mean("tr", 14), "atr_50": E.mean("tr", 50)})


@query
def sma_vwma_cross(spark, sf_dir):
    df = base(spark, sf_dir).withColumns({"sma_5": F.round(E.mean("close", 5), 9), "sma_20": F.round(E.mean("close", 20), 9), "vwma_10": E.weighted_mean("close", "volume", 10)})
    return of_bars(df, {"sma_5": F.col("sma_5"), "sma_20": F.col("sma_20"), "vwma_10": F.col("vwma_10"), "over": E.crosses_over("sma_5", "sma_20"), "under": E.crosses_under("sma_5", "sma_20")})


def kernel_query(name: str, kernels: list[str]) -> None:
    def run(spark, sf_dir):
        return of_bars(run_kernels(S.hourly_bars(spark, sf_dir), kernels), kernels)

    run.__name__ = name
    query(run)


for _name, _kernels in {
    "ema": ["ema_12", "ema_26"],
    "wilder_atr": ["atr_7", "atr_14"],
    "rsi_wilder": ["rsi_14"],
    "adx": ["adx_14"],
    "triple_ema": ["hls_8", "hls_10"],
    "envelopes": ["superma_topvector01", "superma_botvector01", "pvt_topvector01", "pvt_botvector01", "trendmagic_topvector01", "trendmagic_botvector01"],
    "vol_memory": ["mem_vol"],
}.items():
    kernel_query(_name, _kernels)


@query
def macd(spark, sf_dir):
    df = run_kernels(S.hourly_bars(spark, sf_dir), ["ema_13", "ema_21"]).withColumn("macd", F.col("ema_13") - F.col("ema_21"))
    df = df.withColumn("macd_signal", E.mean("macd", 8))
    return of_bars(df, {"macd": F.col("macd"), "macd_signal": F.col("macd_signal"), "macd_hist": F.col("macd") - F.col("macd_signal")})


@query
def rsi_sma(spark, sf_dir):
    return of_bars(base(spark, sf_dir), X.simple_rsis())


@query
def linreg_channel(spark, sf_dir):
    names = ["lr_mid", "lr_slope", "lr_intercept", "lr_dev", "lr_upper", "lr_lower", "lr_width", "lr_pos"]
    return of_bars(X.with_linreg_channel(S.hourly_bars(spark, sf_dir)), names, 5)


@query
def rolling_slope_zscore(spark, sf_dir):
    return of_bars(S.hourly_bars(spark, sf_dir), X.rolling_stats(["close"]), 5)


@query
def ml_returns_vol(spark, sf_dir):
    return of_bars(base(spark, sf_dir), X.returns() | X.volatilities() | X.average_distances())


@query
def zscores(spark, sf_dir):
    df = base(spark, sf_dir).withColumns(X.volatilities())
    return of_bars(df, X.zscores(["ret_1", "ret_5", "vol_5", "vol_20"]), 5)


@query
def candle_metrics(spark, sf_dir):
    return of_bars(S.hourly_bars(spark, sf_dir), X.candle_metrics())


@query
def skew_kurt(spark, sf_dir):
    return of_bars(base(spark, sf_dir), X.shape(), 4)


@query
def volume_anomaly(spark, sf_dir):
    return of_bars(S.hourly_bars(spark, sf_dir), X.volume_anomaly())


@query
def vol_compression(spark, sf_dir):
    return of_bars(base(spark, sf_dir), X.volatility_compression())


@query
def regime_context(spark, sf_dir):
    return of_bars(base(spark, sf_dir), X.regime_context(), 4)


@query
def microstructure(spark, sf_dir):
    df = base(spark, sf_dir)
    made = X.with_microstructure(df)
    return of_bars(made, [c for c in made.columns if c not in df.columns], 5)


@query
def drawdown_islands(spark, sf_dir):
    return of_bars(X.drawdown_islands(base(spark, sf_dir)), ["drawdown_depth", "drawdown_duration"])


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with an SMA-cross signal, a rule's regime and a probability by rank of the last move."""
    df = base(spark, sf_dir).withColumns({"sma_5": E.mean("close", 5), "sma_10": E.mean("close", 10), "sma_20": E.mean("close", 20), "sma_40": E.mean("close", 40)})
    gap, trend = F.round(F.col("sma_5") - F.col("sma_20"), 9), F.round(F.col("sma_10") - F.col("sma_40"), 9)
    regime = F.when(trend > 0, "trend_up").when(trend < 0, "trend_down").otherwise("chop")
    rank = F.percent_rank().over(Window.partitionBy("symbol").orderBy(F.abs(F.coalesce("ret_1", F.lit(0.0))), "ts"))
    return df.withColumns({"signal": F.coalesce(F.signum(gap), F.lit(0.0)).cast("int"), "regime": regime, "prob": 0.5 + 0.5 * rank})


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_returns(signals(spark, sf_dir), cost=CostModel())


@query
def signal_streak_since(spark, sf_dir):
    df = X.signal_streak(signals(spark, sf_dir), "signal", "streak")
    return of_bars(df, {"streak": F.col("streak"), "since_long": X.rows_since("signal", 1), "since_short": X.rows_since("signal", -1)})


@query
def distance_to_extreme(spark, sf_dir):
    return of_bars(S.hourly_bars(spark, sf_dir), {"distance": X.distance_to_extreme("close")})


@query
def pvt_latch(spark, sf_dir):
    return of_bars(O.pvt_residual(S.hourly_bars(spark, sf_dir)), ["pvt_nRes", "pvt_sig_pvt"], 4)


@query
def pyramiding(spark, sf_dir):
    df = base(spark, sf_dir).withColumns({"long_raw": E.flag(F.col("ret_1") > 0.5), "short_raw": E.flag(F.col("ret_1") < -0.4)})
    return of_bars(O.pyramiding(df, "long_raw", "short_raw"), ["sectionLongs", "sectionShorts"])


def module_query(name: str, key: str) -> None:
    def run(spark, sf_dir):
        m = O.MODULES[name]
        df = m.build(X.with_base(run_kernels(S.hourly_bars(spark, sf_dir), m.kernels)))
        return of_bars(df, m.names() + ([m.signal] if m.signal else []), 5)

    run.__name__ = key
    query(run)


for _name in ("superma", "trendmagic", "pvt", "pivots_rsi", "ohlcv"):
    module_query(_name, f"module_{_name}")


@query
def feature_plan(spark, sf_dir):
    df = build(S.hourly_bars(spark, sf_dir))
    return of_bars(df, [c for c in df.columns if c not in ("symbol", "ts", "bar_idx")], 4)


@query
def daily_pivot(spark, sf_dir):
    return of_bars(X.with_previous_day_pivot(S.hourly_bars(spark, sf_dir).withColumns(X.daily_pivot())), ["pivot", "pivot_prev_day"])


@query
def as_of_join(spark, sf_dir):
    """Every 6-hour bar, 17 minutes on, with the last of all hourly bars of its series."""
    bars = S.hourly_bars(spark, sf_dir)
    asked = S.numbered(S.resample(bars, "6 hours")).select("symbol", (F.col("ts") + F.expr("INTERVAL 17 MINUTES")).alias("ts"), "bar_idx")
    known = bars.select("symbol", "ts", F.col("close").alias("known_close"), F.col("bar_idx").alias("known_idx"))
    return of_bars(X.as_of(asked, known, ["known_close", "known_idx"]), ["known_close", "known_idx"])


@query
def direction_labels(spark, sf_dir):
    df = L.direction_labels(S.hourly_bars(spark, sf_dir), LabelConfig(cost_adjusted=True))
    return of_bars(df, ["future_return", "smoothed_return", "blend_label", "threshold", "effective_threshold", "round_trip_cost"])


@query
def label_stats(spark, sf_dir):
    return rounded(L.label_report(L.direction_labels(S.hourly_bars(spark, sf_dir))), ["blend_label", "n", "n_return"], ["mean_return", "std_return", "p25", "median_return", "p75"])


@query
def regime_labels_rule(spark, sf_dir):
    df = L.channel_regime(X.with_linreg_channel(S.hourly_bars(spark, sf_dir), n=30))
    return df.select("symbol", "bar_idx", "regime")


@query
def regime_labels_adx(spark, sf_dir):
    return L.adx_regime(S.hourly_bars(spark, sf_dir)).select("symbol", "bar_idx", "regime")


ORDER_SPLITS = SplitConfig(train_months=12, validation_months=2, slide_months=6)


@query
def walk_forward_assign(spark, sf_dir):
    bars = S.daily_order_bars(spark, sf_dir)
    splits = W.calendar_splits(datetime(1992, 1, 31), datetime(1998, 12, 31), ORDER_SPLITS)
    return W.assign(bars, splits).groupBy("symbol", "split", "part").agg(F.count("*").alias("n"), F.min("bar_idx").alias("first_idx"), F.max("bar_idx").alias("last_idx"))


@query
def purged_kfold(spark, sf_dir):
    df = W.purged_folds(S.hourly_bars(spark, sf_dir), 5, 12)
    return df.groupBy("symbol", "fold", "part").agg(F.count("*").alias("n"), F.min("bar_idx").alias("first_idx"), F.max("bar_idx").alias("last_idx"))


@query
def chronological_split(spark, sf_dir):
    return W.chronological(S.hourly_bars(spark, sf_dir)).groupBy("symbol", "part").agg(F.count("*").alias("n"), F.max("bar_idx").alias("last_idx"))


@query
def walk_forward_strategy(spark, sf_dir):
    cross = lambda df: df.withColumn("signal", F.coalesce(F.signum(F.col("close") - F.col("open")), F.lit(0.0)))
    return rounded(W.walk_forward_report(S.hourly_bars(spark, sf_dir), cross, folds=4, gap=6), ["symbol", "fold", "part", "n"], ["sharpe", "total_return"], 4)


def scaled(kind: str) -> None:
    def run(spark, sf_dir):
        items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.lit(1.0).alias("constant"))
        columns = ["l_quantity", "l_extendedprice", "constant"]
        return rounded(M.fit_scaler(items, columns, kind).apply(items), ["l_orderkey", "l_linenumber"], columns, 5)

    run.__name__ = f"scale_{kind}"
    query(run)


for _name in ("zscore", "minmax", "robust"):
    scaled(_name)


@query
def positions_costs(spark, sf_dir):
    return of_bars(log(spark, sf_dir), ["position", "pnl_raw", "turn", "cost", "pnl"])


@query
def equity_curve(spark, sf_dir):
    df = B.with_returns(small(signals(spark, sf_dir)))
    return of_bars(B.equity_curve(df), ["equity", "equity_drawdown"], 5)


def small(df: DataFrame) -> DataFrame:
    """Positions for synthetic prices that swing by more than half: closes on a narrow scale."""
    return df.withColumn("close", 1000 + F.col("close"))


@query
def trade_segments(spark, sf_dir):
    return rounded(B.trade_segments(log(spark, sf_dir)), ["symbol", "segment", "position", "bars", "entry_idx", "regime"], ["trade_pnl_raw", "trade_pnl"])


@query
def flip_trades(spark, sf_dir):
    return rounded(B.flip_trades(log(spark, sf_dir)), ["symbol", "segment", "position", "entry_idx"], ["entry", "exit", "trade_return"])


@query
def trade_metrics(spark, sf_dir):
    found = B.trade_metrics(B.trade_segments(log(spark, sf_dir)), "trade_pnl", ["symbol"])
    return rounded(found, ["symbol", "trades"], ["win_rate", "avg_trade", "profit_factor", "avg_win", "avg_loss", "gross_profit", "gross_loss"], 5)


@query
def drawdown_stats(spark, sf_dir):
    return rounded(B.drawdown_stats(B.equity_curve(B.with_returns(small(signals(spark, sf_dir))))), ["symbol", "max_drawdown_duration"], ["max_drawdown"])


@query
def metrics_overall(spark, sf_dir):
    found = B.metrics(B.equity_curve(B.with_returns(small(signals(spark, sf_dir)))))
    return rounded(found, ["symbol", "bars"], ["total_return", "total_return_from_1", "sharpe", "max_drawdown", "hit_rate", "long_accuracy", "short_accuracy", "total_cost", "turnover"], 5)


@query
def metrics_grouping_sets(spark, sf_dir):
    return rounded(B.breakdown(log(spark, sf_dir)).withColumn("level", F.col("level").cast("long")), ["regime", "side", "level", "bars"], ["mean_pnl", "mean_pnl_raw", "sum_pnl", "sum_cost", "sharpe", "hit_rate"], 5)


@query
def return_metrics(spark, sf_dir):
    found = B.return_metrics(B.with_returns(small(signals(spark, sf_dir))))
    return rounded(found, ["symbol", "samples"], [c for c in found.columns if c not in ("symbol", "samples")], 5)


@query
def cost_percentiles(spark, sf_dir):
    return rounded(B.cost_percentiles(log(spark, sf_dir)).withColumn("level", F.col("level").cast("long")), ["regime", "side", "level", "bars"], ["mean_gross", "mean_cost", "p5", "p25", "p50", "p75", "p95"], 5)


@query
def nonoverlap_trades(spark, sf_dir):
    df = greedy_trades(signals(spark, sf_dir).select("symbol", "ts", "bar_idx", "close", "signal"), "signal", 12)
    return of_bars(df.where("trade_gross is not null"), ["trade_gross"], 5)


@query
def prob_bins(spark, sf_dir):
    return of_bars(B.quantile_bins(signals(spark, sf_dir)), ["prob_bin", "prob_min", "prob_max"])


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = signals(spark, sf_dir).withColumn("future_return", L.future_return(1))
    return B.calibration_report(B.quantile_bins(df.where("future_return is not null")))


@query
def calibration_report(spark, sf_dir):
    found = calibrated(spark, sf_dir).withColumns({"level": F.col("level").cast("long"), "prob_bin": F.col("prob_bin").cast("long")})
    return rounded(found, ["level", "regime", "side", "prob_bin", "count"], ["prob_min", "prob_max", "hit_rate", "avg_gross_return", "median_gross_return", "avg_abs_return"], 5)


@query
def ev_lookup(spark, sf_dir):
    bins = calibrated(spark, sf_dir).where("level = 0 or level = 3").select("prob_min", "prob_max", F.round("avg_gross_return", 9).alias("ev"), "side", "regime")
    df = signals(spark, sf_dir).withColumn("side", F.when(F.col("signal") > 0, "long").when(F.col("signal") < 0, "short").otherwise("flat"))
    return of_bars(G.expected_value(df, bins), ["ev"], 5)


@query
def policy_gating(spark, sf_dir):
    policy = Policy(short_cap=1.0, require_agreement=False, p_long=0.7, p_short=0.7)
    return of_bars(G.gate(signals(spark, sf_dir).withColumn("ev", F.lit(0.0)), policy), ["final_signal"])


@query
def short_ratio_cap(spark, sf_dir):
    df = signals(spark, sf_dir).withColumn("final_signal", F.when(F.col("signal") < 0, -1).when(F.col("bar_idx") % 4 == 0, F.col("signal")).otherwise(0))
    return of_bars(G.cap_shorts(df, Policy()), ["final_signal"])


@query
def ev_diagnostics(spark, sf_dir):
    df = signals(spark, sf_dir).withColumns({"future_return": L.future_return(1), "ev": F.col("prob") - 0.75})
    return rounded(B.ev_diagnostics(df), ["bin", "n"], ["hit_rate", "avg_return", "median_return", "correlation"], 5)


@query
def describe_bars(spark, sf_dir):
    return rounded(B.describe(S.hourly_bars(spark, sf_dir), ["open", "close", "volume"]), ["column", "count"], ["mean", "std", "min", "p25", "p50", "p75", "max"], 5)


@query
def price_gaps(spark, sf_dir):
    return of_bars(T.price_gaps(S.daily_order_bars(spark, sf_dir), 3.0), ["log_ret", "z"], 5)


@query
def volume_spikes(spark, sf_dir):
    return of_bars(T.volume_spikes(S.hourly_bars(spark, sf_dir), 2.0), ["volume", "volume_mean"], 5)


@query
def gap_detect(spark, sf_dir):
    return T.time_gaps(S.hourly_bars(spark, sf_dir))


@query
def drift(spark, sf_dir):
    return rounded(T.drift(S.hourly_bars(spark, sf_dir)), ["symbol", "half", "n"], ["mean", "vol", "skew", "kurt"], 4)


@query
def recent_volatility(spark, sf_dir):
    return rounded(T.recent_volatility(S.hourly_bars(spark, sf_dir), 100), ["symbol"], ["recent_vol_ratio"], 5)


@query
def ks_two_sample(spark, sf_dir):
    df = S.hourly_bars(spark, sf_dir).withColumn("half", (F.col("bar_idx") >= F.floor(F.count("*").over(Window.partitionBy("symbol")) / 2)).cast("int"))
    return rounded(T.kolmogorov_smirnov(df, ["symbol"], "close", "half"), ["symbol", "n0", "n1"], ["d"])


@query
def quality_score(spark, sf_dir):
    return rounded(T.quality_score(S.hourly_bars(spark, sf_dir)), ["symbol"], ["errors", "warnings", "outlier_rate", "score"])


def all_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_returns(small(signals(spark, sf_dir))).select("symbol", "ts", "pnl")


@query
def nonoverlap_metrics(spark, sf_dir):
    trades = greedy_trades(small(signals(spark, sf_dir)).select("symbol", "ts", "bar_idx", "close", "signal"), "signal", 12)
    found = B.nonoverlap_return_metrics(trades)
    return rounded(found, ["symbol", "trade_count", "max_drawdown_duration"], [c for c in found.columns if c not in ("symbol", "trade_count", "max_drawdown_duration")], 5)


@query
def ev_details(spark, sf_dir):
    found = B.ev_details(B.with_returns(signals(spark, sf_dir).withColumn("ev", F.col("prob") - 0.75)))
    return rounded(found, ["symbol", "bar_idx", "regime", "side"], ["prob", "ev", "future_return"])


@query
def cost_sanity(spark, sf_dir):
    return rounded(B.cost_sanity(log(spark, sf_dir)), ["symbol", "entries", "trade_bars"], ["total_cost", "avg_cost", "raw_total", "net_total"], 5)


@query
def agreement_gating(spark, sf_dir):
    """Shorts need a second signal that agrees; all need an expected value."""
    df = signals(spark, sf_dir).withColumns({"blend_signal": F.signum(F.col("close") - F.col("open")).cast("int"), "blend_prob": F.col("prob") / 2, "ev": F.col("prob") - 0.7})
    return of_bars(G.gate(df, Policy(short_cap=1.0, min_ev=0.02)), ["final_signal"])


@query
def ev_summary(spark, sf_dir):
    df = signals(spark, sf_dir).withColumns({"ev": F.when(F.col("prob") > 0.6, F.col("prob") - 0.75), "final_signal": F.col("signal")})
    return rounded(G.ev_summary(df), ["n", "n_positive", "n_signals"], ["mean_ev", "median_ev"])


@query
def probability_histogram(spark, sf_dir):
    return M.probability_histogram(signals(spark, sf_dir), "prob")


@query
def sharpened(spark, sf_dir):
    df = signals(spark, sf_dir).withColumn("s", M.sharpen(F.array(F.col("prob"), 1 - F.col("prob")), 2.0))
    return of_bars(df, {"p_0": F.col("s")[0], "p_1": F.col("s")[1]})


@query
def signal_confusion(spark, sf_dir):
    df = signals(spark, sf_dir).withColumn("predicted", F.signum(F.col("close") - F.col("open")).cast("int").cast("string"))
    return M.confusion(df, "signal", "predicted", ["-1", "0", "1"])


@query
def regime_counts(spark, sf_dir):
    return B.value_counts(signals(spark, sf_dir), "regime")


@query
def stratified_split(spark, sf_dir):
    return W.stratified(signals(spark, sf_dir), "regime").select("symbol", "bar_idx", "held_out")


@query
def combinatorial_folds(spark, sf_dir):
    df = W.combinatorial_assign(S.hourly_bars(spark, sf_dir), 6, 2, 12)
    return df.groupBy("symbol", "choice", "part").agg(F.count("*").alias("n"), F.min("bar_idx").alias("first_idx"), F.max("bar_idx").alias("last_idx"))


@query
def period_comparison(spark, sf_dir):
    bars = S.hourly_bars(spark, sf_dir)
    first = F.col("ts") < datetime(2024, 1, 16)
    found = T.compare_periods(bars.where(first), bars.where(~first))
    return rounded(found, ["symbol", "n0", "n1"], ["d", "mean_0", "mean_1", "vol_0", "vol_1"], 5)


@query
def rolling_stats(spark, sf_dir):
    stats = X.rolling_stats(["open", "volume"])
    return of_bars(S.hourly_bars(spark, sf_dir).withColumns(stats), list(stats), 5)


@query
def array_drawdown(spark, sf_dir):
    """The deepest fall of closes themselves, by series."""
    df = base(spark, sf_dir)
    return rounded(df.groupBy("symbol").agg(F.min("drawdown").alias("worst")), ["symbol"], ["worst"])


@query
def atr_share(spark, sf_dir):
    kernels = ["atr_7", "atr_14", "atr_21"]
    return of_bars(run_kernels(S.hourly_bars(spark, sf_dir), kernels), {f"atr_pct_{k[4:]}": E.ratio(k, "close") for k in kernels})


@query
def bootstrap_equity(spark, sf_dir):
    return T.bootstrap_summary(T.bootstrap(all_series(spark, sf_dir), key="symbol"), keys=("symbol",))


@query
def overfit_pbo(spark, sf_dir):
    return T.overfit(all_series(spark, sf_dir), key="symbol")


@query
def grid_labels(spark, sf_dir):
    return rounded(L.grid_labels(S.hourly_bars(spark, sf_dir), [6, 12], [6, 12]), ["symbol", "horizon", "smoothing", "n", "n_long", "n_short"], ["mean_return"])


@query
def grid_report(spark, sf_dir):
    found = L.grid_labels(S.hourly_bars(spark, sf_dir), [6, 12], [6, 12])
    return rounded(grid_summary(found, ["horizon", "smoothing"], "mean_return"), ["horizon", "smoothing", "n"], ["mean", "median", "positive_share", "worst", "best", "trimmed_mean"])


MODEL_COLUMNS = ["ret_1", "ret_5", "drawdown", "body", "hl_pct"]
SMALL_FOREST = M.Forest(trees=20, depth=5, bins=32)


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = signals(spark, sf_dir).withColumns(X.candle_metrics())
    return df.fillna(0, subset=MODEL_COLUMNS)


@query
def rf_regime(spark, sf_dir):
    df = W.chronological(model_rows(spark, sf_dir))
    model = M.fit_forest(df.where("part = 'train'"), MODEL_COLUMNS, "regime", M.REGIME_FOREST)
    return M.accuracy(model.predict(df), "regime", "predicted", ["part"])


@query
def blender_proba(spark, sf_dir):
    df = model_rows(spark, sf_dir)
    model = M.fit_forest(df, MODEL_COLUMNS, "signal", SMALL_FOREST)
    return model.probabilities(df).select("symbol", "bar_idx", *(F.col("probs")[k].alias(f"p_{k}") for k in range(len(model.labels))), G.argmax_signal("probs", tuple(int(x) for x in model.labels), 0.4).alias("predicted"))


@query
def isotonic_calibration(spark, sf_dir):
    df = model_rows(spark, sf_dir)
    model = M.calibrate(M.fit_forest(df, MODEL_COLUMNS, "signal", SMALL_FOREST), df, "signal")
    return M.confusion(model.predict(df), "signal", "predicted", model.labels)
