from pyspark.sql import functions as F

from tests.test_bars import random_bars, to_spark
from tidebar.config import FeatureConfig, LabelConfig, SplitConfig
from tidebar.engine import Models, backtest, cross_validate, histogram_points, infer, labelled_features, scored, train_direction, train_window, validate_window
from tidebar.operators import splits
from tidebar.operators.models import Forest

SMALL = FeatureConfig(modules=("linreg",), groups=("ml",), include="linreg_lr_|ml_ret_|ml_vol_5$|ml_body")


def test_train_validate_backtest_infer(spark, tmp_path):
    bars = to_spark(spark, random_bars(400, ("a",), 7))
    rows, columns = labelled_features(bars, SMALL, LabelConfig(horizon=3, smoothing=2))
    parts = splits.chronological(rows).persist()
    models = train_window(parts.where("part = 'train'"), columns, Forest(8, 4, 32))
    found = validate_window(parts.where("part = 'validation'").drop("part"), models).collect()
    assert len(found) == 1 and 0 <= found[0].signal_accuracy <= 1 and found[0].samples == 79
    models.save(str(tmp_path / "m"))
    again = Models.load(str(tmp_path / "m"))
    assert again.columns == models.columns
    a, b = (infer(bars, m, SMALL, rows=3).orderBy("bar_idx").collect() for m in (models, again))
    assert a == b and [r.bar_idx for r in a] == [397, 398, 399]
    assert train_direction(rows, columns) is None
    assert train_direction(rows, columns, Forest(4, 3, 32), 50).labels == ["-1", "1"]
    assert [k for k, _ in cross_validate(rows, columns, "regime", 3, 6, Forest(4, 3, 32))] == [1, 2]
    least = {"direction": 20, "regime_signal": 40, "regime_direction": 20}
    many = train_window(parts.where("part = 'train'"), columns, Forest(4, 3, 32), least=least)
    assert many.direction.labels == ["-1", "1"] and many.by_regime and many.direction_by_regime
    many.save(f"file://{tmp_path}/n")
    assert sorted(Models.load(f"file://{tmp_path}/n").direction_by_regime) == sorted(many.direction_by_regime)
    df = scored(rows.drop("regime", "blend_label"), many).persist()
    assert df.where("signal = 0 or prob < 0.5").isEmpty()  # a direction model has no flat class
    own = df.where(F.col("regime") == sorted(many.by_regime)[0])
    alone = many.by_regime[sorted(many.by_regime)[0]].probabilities(own, "alone").withColumn("alone", F.array_max("alone"))
    assert alone.where("abs(alone - blend_prob) > 1e-9").isEmpty()
    report = backtest(bars, many, SMALL)
    assert report.audit.passed and report.ev_details.columns[-1] == "future_return" and report.cost_sanity.count() == 1
    report = backtest(bars, models, SMALL)
    assert report.curve.count() == 399 and report.metrics.count() == 1
    assert report.breakdown.where("level = 3").first().bars == 399
    assert sum(r.n for r in histogram_points(bars, "close", 10).collect()) == 400


def test_windows_cover_what_they_say(spark):
    from datetime import datetime

    bars = to_spark(spark, random_bars(100, ("a",)))
    made = [splits.Split(0, datetime(2024, 1, 1), datetime(2024, 1, 1, 4), datetime(2024, 1, 1, 4), datetime(2024, 1, 1, 6))]
    got = {r.part: r["count"] for r in splits.assign(bars, made).groupBy("part").count().collect()}
    assert got == {"train": 48, "validation": 24}
    assert splits.assign(bars, []).count() == 0
    assert SplitConfig().train_months == 6
