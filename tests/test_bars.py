"""Kernels and features against pandas, causality, and edge cases."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.config import FeatureConfig, LabelConfig, Policy, SplitConfig, profile
from tidebar.functions import exprs as E
from tidebar.operators import backtest as B
from tidebar.operators import checks as T
from tidebar.operators import features as X
from tidebar.operators import gating as G
from tidebar.operators import kernels as K
from tidebar.operators import labels as L
from tidebar.operators import modules as O
from tidebar.operators import search, splits
from tidebar.operators.models import Forest, calibrate, fit_forest, fit_scaler, pruned_columns
from tidebar.plans.feature_plan import build, filtered
from tidebar.queries import QUERIES
from tidebar.sources import bars as S
from tidebar.sources.sinks import append_run, cached_features, read_text, run_log, write_json

START = datetime(2024, 1, 1)


def random_bars(n=300, symbols=("a", "b"), seed=0, constant=False):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        close = np.full(n, 100.0) if constant else 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        open_ = np.concatenate(([close[0]], close[:-1]))
        high, low = np.maximum(open_, close) * (1 + (0 if constant else rng.uniform(0, 0.01, n))), np.minimum(open_, close) * (1 - (0 if constant else rng.uniform(0, 0.01, n)))
        volume = np.where(rng.uniform(size=n) < 0.05, 0.0, rng.uniform(1, 10, n))
        rows.append(pd.DataFrame({"symbol": s, "ts": [START + timedelta(minutes=5 * i) for i in range(n)], "open": open_, "high": high, "low": low, "close": close, "volume": volume, "bar_idx": np.arange(n)}))
    return pd.concat(rows, ignore_index=True)


def to_spark(spark, frame):
    df = spark.createDataFrame(frame.sample(frac=1, random_state=1))
    numbers = {c: E.finite(c) for c, t in df.dtypes if t == "double"}
    return df.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), **numbers}).repartition(3)


@pytest.fixture(scope="module")
def frame():
    return random_bars()


@pytest.fixture(scope="module")
def bars(spark, frame):
    return to_spark(spark, frame)


def of(df, symbol="a"):
    return df.toPandas().query(f"symbol == '{symbol}'").sort_values("bar_idx").reset_index(drop=True)


def test_smoothing_follows_pandas(bars, frame):
    got, close = of(K.run_kernels(bars, ["ema_12", "atr_14", "rsi_14"])), of_frame(frame)["close"]
    np.testing.assert_allclose(got["ema_12"], close.ewm(span=12, adjust=False, min_periods=12).mean())
    delta = close.diff()
    up, down = (x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for x in (delta.clip(lower=0), -delta.clip(upper=0)))
    np.testing.assert_allclose(got["rsi_14"], 100 - 100 / (1 + up / down))


def of_frame(frame, symbol="a"):
    return frame[frame.symbol == symbol].reset_index(drop=True)


def test_interior_null_decays_the_old_weight():
    np.testing.assert_allclose(K.ema(np.array([1.0, np.nan, 2.0]), 3)[2:], pd.Series([1.0, np.nan, 2.0]).ewm(span=3, adjust=False, min_periods=3).mean()[2:])


def test_envelope_by_hand():
    stages = K.Stages((2, 1, 1), (1, 2))
    got = K.decaying_extreme(np.array([10.0, 9.0, 9.0, 9.0, 11.0]), np.full(5, 0.1), stages, 1)
    np.testing.assert_allclose(got, [10, 9.8, 9.6, 9.5, 11])


def test_greedy_trades_skip():
    got = K.skip_ahead_trades(np.array([1, 1, 0, -1, 1, 1]), np.array([1.0, 2, 4, 8, 4, 2]), 2)
    np.testing.assert_allclose(got, [3, np.nan, np.nan, 0.75, np.nan, np.nan])


def test_latch_and_pyramiding_match_their_loops(spark):
    rng = np.random.default_rng(5)
    frame = random_bars(200, ("a",), 3)
    long, short = (rng.uniform(size=200) < 0.2).astype(int), (rng.uniform(size=200) < 0.2).astype(int)
    got = of(O.pyramiding(to_spark(spark, frame.assign(long=long, short=short)), "long", "short"))
    longs = shorts = 0
    for i in range(200):
        if long[i] and not short[i]:
            longs, shorts = longs + 1, 0
        elif short[i] and not long[i]:
            longs, shorts = 0, shorts + 1
        elif long[i] and short[i]:
            break
        assert (got.sectionLongs[i], got.sectionShorts[i]) == (longs, shorts)


@pytest.mark.parametrize("pick", ["ml", "micro", "channel", "context", "stats"])
def test_features_never_look_ahead(spark, frame, pick):
    columns = lambda chosen: lambda df: df.withColumns(chosen)
    add = {"ml": columns(X.ml_columns()), "micro": X.with_microstructure, "channel": lambda df: X.with_linreg_channel(df, n=30), "context": columns(X.regime_context()), "stats": columns(X.rolling_stats(["close"]))}[pick]
    whole, part = (of(add(X.with_base(to_spark(spark, f)))) for f in (frame, frame[frame.bar_idx < 150]))
    pd.testing.assert_frame_equal(whole[whole.bar_idx < 150], part, rtol=1e-9, atol=1e-12)


def test_plan_is_causal_without_the_day_pivot(spark, frame):
    config = FeatureConfig(exclude="pivots_rsi_pivot")
    whole, part = (of(build(to_spark(spark, f), config)) for f in (frame, frame[frame.bar_idx < 150]))
    pd.testing.assert_frame_equal(whole[whole.bar_idx < 150].drop(columns="ts"), part.drop(columns="ts"), rtol=1e-7, atol=1e-9, check_dtype=False)


def test_plan_counts_and_filters(bars):
    names = [c for c in build(bars).columns if c not in ("symbol", "ts", "open", "high", "low", "close", "volume", "bar_idx") and not c.endswith("_signal") or c == "pivots_rsi_macd_signal"]
    assert len(names) >= 214
    only = build(bars, FeatureConfig(modules=("LinReg",), groups=()))
    assert [c for c in only.columns if c.startswith("linreg_")] == list(f"linreg_{c}" for c in O.MODULES["linreg"].columns)
    assert "FlatMapGroupsInPandas" not in only._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        filtered(["a"], FeatureConfig(include="zzz"))
    with pytest.raises(KeyError):
        build(bars, FeatureConfig(modules=("none",)))


def test_constant_prices_and_short_series(spark):
    for f in (random_bars(120, ("a",), constant=True), random_bars(3, ("a",)), random_bars(5, ("a",)).iloc[:0]):
        if len(f):
            df = build(to_spark(spark, f))
        else:
            df = build(to_spark(spark, random_bars(1, ("a",))).where("false"))
        out = df.toPandas()
        assert len(out) == len(f) and not out.drop(columns=["symbol", "ts"]).isna().any().any()


def test_cleaning_sources(spark, tmp_path):
    path = tmp_path / "bars.csv"
    path.write_text("Timestamp,Open,High,Low,Close,Vol\n2024-01-01 00:00:00,1,2,0.5,1.5,10\nbad,1,2,0.5,1.5,10\n2024-01-01 00:05:00,x,2,0.5,1.5,10\n2024-01-01 00:10:00,1,0.5,2,1.5,10\n2024-01-01 00:15:00,1,2,0.5,1.5,10\n")
    got = S.read_csv(spark, str(path), "s", end=datetime(2024, 1, 1, 0, 15))
    assert got.count() == 2
    S.validate(got)
    assert S.read_csv(spark, str(path), check=False).count() == 3
    with pytest.raises(ValueError):
        S.validate(S.read_csv(spark, str(path), check=False))
    with pytest.raises(FileNotFoundError):
        S.first_readable(spark, [str(tmp_path / "none.csv")])
    assert S.first_readable(spark, [str(tmp_path / "none.csv"), str(path)]).count() == 2


def test_resample_skips_null_opens(spark, frame):
    holed = frame.assign(open=frame["open"].where(frame.bar_idx % 3 > 0))
    got = S.numbered(S.resample(to_spark(spark, holed), "15 minutes")).where("symbol = 'a'").orderBy("ts").toPandas()
    want = of_frame(holed).set_index("ts").resample("15min").agg({"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"})
    np.testing.assert_allclose(got[["open", "high", "low", "close", "volume"]], want)


def test_as_of_takes_the_latest_not_after(spark, bars, frame):
    right = to_spark(spark, frame[frame.bar_idx % 10 == 0]).select("symbol", "ts", F.col("bar_idx").alias("known"))
    got = of(X.as_of(bars, right, ["known"]))
    assert (got.known == got.bar_idx // 10 * 10).all()


def test_registered_as_of_join_asks_every_bar(spark, sf_dir):
    asked = QUERIES["bars_resampled"](spark, sf_dir).select("symbol", "bar_idx").toPandas()
    got = QUERIES["as_of_join"](spark, sf_dir).toPandas()
    assert set(zip(got.symbol, got.bar_idx)) == set(zip(asked.symbol, asked.bar_idx)) and len(got) == len(asked)
    assert {int(i) % 7 for i in got.known_idx.dropna()} == set(range(7))


def test_labels(bars, frame):
    got, close = of(L.direction_labels(bars, LabelConfig(horizon=3, smoothing=2))), of_frame(frame)["close"]
    ahead = close.shift(-3) / close - 1
    smooth = ahead.rolling(2, min_periods=1).mean()
    np.testing.assert_allclose(got.future_return, ahead)
    assert (got.blend_label == np.where(smooth > 0.0005, 1, np.where(smooth < -0.0005, -1, 0))).all()


def test_month_steps_stay_clamped():
    got = splits.calendar_splits(datetime(2023, 1, 31), datetime(2023, 12, 31), SplitConfig(1, 1, 1))
    assert [s.train_start.day for s in got[:3]] == [31, 28, 28]


def test_purge_and_embargo_leave_gaps():
    made = splits.calendar_splits(datetime(2023, 1, 1), datetime(2024, 1, 1), SplitConfig(3, 1, 1))
    cut = splits.purged(made, timedelta(hours=1), SplitConfig(purge_bars=12, embargo_days=2))
    assert all(b.train_end == a.train_end - timedelta(hours=12) and b.validation_start == a.validation_start + timedelta(days=2) for a, b in zip(made, cut))
    assert splits.purged(made, timedelta(days=100), SplitConfig(purge_bars=12)) == []


def test_combinatorial_folds_train_before_the_test():
    found = list(splits.combinatorial_folds(60, 6, 2, 3))
    assert len(found) == 10 and all(t.stop <= min(r.start for r in tests) for t, tests in found)


def test_equity_identities(bars):
    df = bars.withColumn("signal", F.when(F.col("bar_idx") % 7 < 3, 1).when(F.col("bar_idx") % 7 < 5, -1).otherwise(0)).withColumn("regime", F.lit("chop"))
    log = B.with_returns(df)
    curve, segments = of(B.equity_curve(log)), B.trade_segments(log).where("symbol = 'a'").toPandas()
    np.testing.assert_allclose(curve.equity, np.cumprod(1 + curve.pnl))
    np.testing.assert_allclose(segments.trade_pnl.sum(), curve[curve.position != 0].pnl.sum())
    flips = (curve.position * curve.position.shift(1)) == -1
    assert (curve.turn[flips] == 2).all()
    assert T.audit(B.equity_curve(log)).passed
    assert not T.audit(log.withColumn("pnl", F.col("pnl") + 1)).passed


def test_quantile_bins_edges(spark):
    df = spark.createDataFrame([(0.5, 1)] * 5 + [(0.6, 1)] * 5 + [(None, 1)], "prob double, signal int")
    got = B.quantile_bins(df, bins=4).groupBy("prob_bin").count().toPandas()
    assert got["count"].sum() == 11 and set(got.prob_bin.dropna()) == {0, 1}
    one = B.quantile_bins(spark.createDataFrame([(0.7,)] * 3, "prob double")).toPandas()
    assert (one.prob_bin == 0).all()
    assert B.quantile_bins(df.where("false")).count() == 0


def test_expected_value_tiers(spark):
    rows = spark.createDataFrame([(0.55, "long", "chop"), (0.6, "long", "trend_up"), (0.95, "short", "chop"), (None, "long", "chop")], "prob double, side string, regime string")
    bins = spark.createDataFrame([(0.5, 0.6, 0.1, "long", "trend_up"), (0.6, 0.7, 0.3, "long", "trend_up"), (0.5, 0.6, 0.5, "long", None), (0.5, 0.7, 0.9, None, None)], "prob_min double, prob_max double, ev double, side string, regime string")
    got = {(r.prob, r.side): r.ev for r in G.expected_value(rows, bins).collect()}
    assert got[(0.55, "long")] == pytest.approx((0.5 + 0.9) / 2)
    assert got[(0.6, "long")] == pytest.approx((0.1 + 0.3 + 0.5 + 0.9) / 4)
    assert got[(0.95, "short")] == pytest.approx(0.9) and got[(None, "long")] is None
    assert G.expected_value(rows, bins.where("false")).where("ev is null").count() == 4


def test_gates(spark):
    rows = spark.createDataFrame([("a", 0, 1, 0.5, "trend_up"), ("a", 1, 1, 0.4, "trend_up"), ("a", 2, -1, 0.9, "trend_up"), ("a", 3, -1, 0.9, "trend_down"), ("a", 4, 1, 0.9, "chop")], "symbol string, bar_idx long, signal int, prob double, regime string").withColumn("ev", F.lit(0.0))
    got = [r.final_signal for r in G.gate(rows, Policy(short_cap=1.0, require_agreement=False)).orderBy("bar_idx").collect()]
    assert got == [1, 0, 0, -1, 0]
    assert [r.final_signal for r in G.gate(rows, Policy(disable_shorts=True, require_agreement=False)).orderBy("bar_idx").collect()] == [1, 0, 0, 0, 0]
    agreeing = rows.withColumns({"blend_signal": F.lit(-1), "blend_prob": F.when(F.col("bar_idx") == 3, 0.2).otherwise(0.3)})
    assert [r.final_signal for r in G.gate(agreeing, Policy(short_cap=1.0)).orderBy("bar_idx").collect()] == [1, 0, 0, 0, 0]
    with pytest.raises(ValueError):
        G.gate(rows, Policy())
    with pytest.raises(KeyError):
        profile("none")
    assert profile("full_aggressive").short == {"trend_up": False, "trend_down": True, "chop": True}


def test_audit_warns_of_gaps_and_confidence(spark):
    bars = to_spark(spark, random_bars(60, ("a",)))
    log = B.equity_curve(B.with_returns(bars.withColumns({"signal": F.lit(1), "prob": F.lit(0.7), "ev": F.lit(-0.1)})))
    found = T.audit(log)
    assert found.passed and found.warnings == ["probabilities all alike", "no expected value above 0"]
    assert T.audit(log.where("bar_idx < 20 or bar_idx > 40")).warnings[0] == "gaps of over three median steps"
    assert not T.audit(log.unionByName(log.limit(1))).passed
    assert not T.audit(log, strict=True).passed


def test_records_are_written_where_spark_writes(spark, tmp_path):
    write_json({"a": [1, "é"]}, f"file://{tmp_path}/x.json")
    assert read_text(f"file://{tmp_path}/x.json").count("é") or "\\u00e9" in read_text(f"file://{tmp_path}/x.json")
    for k in range(2):
        append_run(spark, {"run": k}, f"file://{tmp_path}/runs")
    assert sorted(r["run"] for r in run_log(spark, f"file://{tmp_path}/runs")) == [0, 1]


def test_scalers_with_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0)], "x double, c double")
    for kind in ("zscore", "minmax", "robust"):
        got = fit_scaler(df, ["x", "c"], kind).apply(df).toPandas()
        assert (got.c == 0).all() and got.x.isna().sum() == 1


def test_forest_learns_and_probabilities_sum(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 2))
    df = spark.createDataFrame(pd.DataFrame({"x": x[:, 0], "y": x[:, 1], "label": np.where(x[:, 0] > 0.4, 1, np.where(x[:, 0] < -0.4, -1, 0))}))
    model = calibrate(fit_forest(df, ["x", "y"], "label", Forest(10, 5, 32)), df, "label")
    out = model.probabilities(df).withColumn("s", F.aggregate("probs", F.lit(0.0), lambda a, p: a + p)).toPandas()
    np.testing.assert_allclose(out.s, 1)
    assert model.predict(df).where("cast(label as string) = predicted").count() > 540
    assert pruned_columns(model.importances(), 50) == ["x"]


def test_bootstrap_does_not_depend_on_partitions(spark):
    r = spark.createDataFrame([(START + timedelta(hours=i), 0.01 * ((i % 5) - 1.5)) for i in range(60)], "ts timestamp, pnl double")
    a = T.bootstrap(r, replicates=40).orderBy("replicate").toPandas()
    b = T.bootstrap(r.repartition(7), replicates=40).orderBy("replicate").toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert T.bootstrap(r.limit(5), replicates=40).count() == 0


def test_bootstrap_and_overfit_take_every_series(spark, sf_dir):
    rows = [(s, START + timedelta(hours=i), w * ((i % 5) - 1.5)) for s, w in (("a", 0.01), ("b", -0.02)) for i in range(60)] + [("c", START, 0.1)]
    r = spark.createDataFrame(rows, "symbol string, ts timestamp, pnl double")
    both, one = (T.bootstrap(x, replicates=40, key="symbol").where("symbol = 'b'").orderBy("replicate").toPandas() for x in (r, r.where("symbol = 'b'")))
    pd.testing.assert_frame_equal(both, one)
    assert {x.symbol for x in T.bootstrap(r, replicates=40, key="symbol").select("symbol").distinct().collect()} == {"a", "b"}
    x = np.array([v for s, _, v in rows if s == "b"])
    got = T.overfit(r, permutations=20, key="symbol").where("symbol = 'b'").first()
    np.testing.assert_allclose([got.sharpe_in, got.sharpe_out], [np.sqrt(252) * y.mean() / y.std(ddof=1) for y in (x[:42], x[42:])])
    symbols = {x.symbol for x in QUERIES["bars_hourly"](spark, sf_dir).select("symbol").distinct().collect()}
    found = QUERIES["bootstrap_equity"](spark, sf_dir).groupBy("symbol").count().collect()
    assert {x.symbol: x["count"] for x in found} == dict.fromkeys(symbols, 3)
    assert {x.symbol for x in QUERIES["overfit_pbo"](spark, sf_dir).collect()} == symbols


def test_bandit_and_configurations():
    arm = search.Arm()
    values = [0.1, 0.4, -0.2, 0.3]
    for v in values:
        arm.add(v)
    assert arm.mean == pytest.approx(np.mean(values)) and arm.variance == pytest.approx(np.var(values, ddof=1))
    bandit = search.Bandit({"good": search.Arm(50, 1.0, 0.01), "bad": search.Arm(50, 0.0, 0.01)})
    assert bandit.choose(["good", "bad"]) == "good"
    found = search.configurations(FeatureConfig(), 3)
    assert found[0] == FeatureConfig() and len({c.fingerprint() for c in found}) == len(found)


def test_cache_is_keyed_by_configuration(spark, bars, tmp_path):
    calls = []

    def make(b, c):
        calls.append(c)
        return build(b, c)

    small = FeatureConfig(modules=("linreg",), groups=())
    for c in (small, small, FeatureConfig(modules=("linreg",), groups=(), include="slope")):
        cached_features(spark, bars, c, str(tmp_path), "x", make).count()
    assert len(calls) == 2


def test_stream_equals_batch(spark, bars, tmp_path):
    from tidebar.streaming.bars import resampled, smoothed

    rows = bars.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "open", "high", "low", "close", "volume")
    for k, cut in enumerate(((0, 100), (100, 300))):
        bars.where(F.col("bar_idx").between(cut[0], cut[1] - 1)).select(rows.columns).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df in (("ema", smoothed(stream, 12)), ("bars", resampled(stream, "15 minutes"))):
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start().awaitTermination()
    got = spark.table("ema").where("symbol = 'a'").orderBy("ts").toPandas().ema
    np.testing.assert_allclose(got, of(K.run_kernels(bars, ["ema_12"])).ema_12)
    late = spark.table("bars").where("symbol = 'a'").count()
    assert 0 < late <= 100


def test_rolling_statistics_follow_pandas(bars, frame):
    df = X.with_base(bars).select("symbol", "bar_idx", E.rolling_skewness("ret_1", 20).alias("skew"), E.rolling_kurtosis("ret_1", 20).alias("kurt"), E.zscore("close", 20).alias("z"))
    got, f = of(df), of_frame(frame)
    r = f.close.pct_change()
    np.testing.assert_allclose(got["skew"], r.rolling(20).skew(), atol=1e-8)
    np.testing.assert_allclose(got["kurt"], r.rolling(20).kurt(), atol=1e-7)
    np.testing.assert_allclose(got["z"], (f.close - f.close.rolling(20).mean()) / f.close.rolling(20).std(), atol=1e-8)
