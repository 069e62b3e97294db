"""End-to-end runs: training by windows, backtests, inference.

All three build features by the plan of one ``FeatureConfig``, which is saved
beside the models, so what is served is what was trained.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CostModel, FeatureConfig, LabelConfig, Policy, SplitConfig
from .functions.exprs import KEY, TIME
from .operators import backtest as B
from .operators import checks as T
from .operators import gating as G
from .operators import labels as L
from .operators import models as M
from .operators import splits as W
from .plans.feature_plan import BARS, build
from .sources.bars import between, tail
from .sources.sinks import read_text, write_text

#: Windows trained at once; each is a Spark job of its own.
THREADS = 4


@dataclass
class Models:
    """A regime model, a signal model (long, short or flat) and a direction model
    (long or short), the last two also of single regimes where rows sufficed."""

    columns: list[str]
    regime: M.Classifier
    signal: M.Classifier
    by_regime: dict[str, M.Classifier] = field(default_factory=dict)
    direction: M.Classifier | None = None
    direction_by_regime: dict[str, M.Classifier] = field(default_factory=dict)

    def _parts(self) -> dict[str, M.Classifier]:
        parts = {"regime": self.regime, "signal": self.signal} | {f"signal_{k}": v for k, v in self.by_regime.items()}
        parts |= {"direction": self.direction} if self.direction else {}
        return parts | {f"direction_{k}": v for k, v in self.direction_by_regime.items()}

    def save(self, folder: str) -> None:
        """Forests go to ``folder``, in any store that Spark writes to; names and calibrators to JSON beside them."""
        for name, model in self._parts().items():
            model.save(f"{folder}/{name}", f"{folder}/{name}.json")
        write_text(f"{folder}/models.json", json.dumps({"columns": self.columns, "by_regime": sorted(self.by_regime), "direction": self.direction is not None, "direction_by_regime": sorted(self.direction_by_regime)}))

    @staticmethod
    def load(folder: str) -> Models:
        kept = json.loads(read_text(f"{folder}/models.json"))
        read = lambda name: M.Classifier.load(f"{folder}/{name}", f"{folder}/{name}.json")
        return Models(kept["columns"], read("regime"), read("signal"), {k: read(f"signal_{k}") for k in kept["by_regime"]}, read("direction") if kept["direction"] else None, {k: read(f"direction_{k}") for k in kept["direction_by_regime"]})


def labelled_features(bars: DataFrame, features: FeatureConfig, labels: LabelConfig) -> tuple[DataFrame, list[str]]:
    """Features with blend_label and regime labels, and the features' names."""
    built = build(bars, features)
    columns = [c for c in built.columns if c not in BARS]
    built = L.direction_labels(built, labels)
    return L.adx_regime(built).drop("adx_14"), columns


def train_window(rows: DataFrame, columns: Sequence[str], forest: M.Forest = M.BLENDER_FOREST, method: str = "isotonic", alpha: float = 2.0, least: dict[str, int] = M.MINIMUM) -> Models:
    """Fit on labelled rows; calibrators are fitted on a stratified fifth held out.
    ``least``: fewest rows for a direction model and for models of single regimes."""
    parts = W.stratified(rows.withColumn("__label", F.col("blend_label").cast("string")), "__label").drop("__label")
    fit, held = parts.where("not held_out"), parts.where("held_out")
    regime = M.fit_forest(fit, list(columns), "regime", M.REGIME_FOREST if forest is M.BLENDER_FOREST else forest)
    signal = M.calibrate(M.fit_forest(fit, list(columns), "blend_label", forest), held, "blend_label", method, alpha)
    by_regime = M.regime_models(fit, list(columns), "blend_label", least["regime_signal"], forest)
    direction = train_direction(fit, columns, forest, least["direction"])
    of_regimes = M.regime_models(fit.where("blend_label <> 0"), list(columns), "blend_label", least["regime_direction"], forest, ["-1", "1"])
    return Models(list(columns), regime, signal, by_regime, direction, of_regimes if direction else {})


def train_direction(rows: DataFrame, columns: Sequence[str], forest: M.Forest = M.BLENDER_FOREST, least: int = M.MINIMUM["direction"]) -> M.Classifier | None:
    """Long against short, from the bars labelled as a trade; None if they are too few."""
    trades = rows.where("blend_label <> 0")
    return M.fit_forest(trades, list(columns), "blend_label", forest, ["-1", "1"]) if trades.count() >= least else None


def cross_validate(rows: DataFrame, columns: Sequence[str], label: str, folds: int = 5, gap: int = 12, forest: M.Forest = M.BLENDER_FOREST, least: tuple[int, int] = (10, 5)) -> list[tuple[int, float]]:
    """(fold, accuracy) over purged folds; folds of too few rows are skipped."""
    parts = W.purged_folds(rows.where(F.col(label).isNotNull()), folds, gap).persist()

    def one(k: int) -> tuple[int, float] | None:
        train, test = (parts.where((F.col("fold") == k) & (F.col("part") == p)).drop("fold", "part") for p in ("train", "test"))
        if train.limit(least[0]).count() < least[0] or test.limit(least[1]).count() < least[1]:
            return None
        model = M.fit_forest(train, list(columns), label, forest)
        return k, M.accuracy(model.predict(test), label, "predicted").first().accuracy

    with ThreadPoolExecutor(THREADS) as pool:
        found = [r for r in pool.map(one, range(folds)) if r is not None]
    parts.unpersist()
    return found


def scored(features: DataFrame, models: Models) -> DataFrame:
    """Adds regime (predicted), signal and prob (of the signal's class), blend_signal
    and blend_prob (the signal model's), and confidence.

    In a regime that has a signal or direction model of its own, that model
    speaks. The direction model makes the signal; without one the signal model does."""
    df = models.regime.probabilities(features, "regime_probs")
    names = F.array(*(F.lit(x) for x in models.regime.labels))
    df = df.withColumn("regime", names[F.array_position("regime_probs", F.array_max("regime_probs")).cast("int") - 1])
    df = M.by_regime(df, models.signal, models.by_regime, "blend_probs")
    classes = tuple(int(x) for x in models.signal.labels)
    df = df.withColumns({"blend_signal": G.argmax_signal("blend_probs", classes), "blend_prob": F.array_max("blend_probs")})
    if models.direction:
        df = M.by_regime(df, models.direction, models.direction_by_regime, "direction_probs")
        classes = tuple(int(x) for x in models.direction.labels)
    else:
        df = df.withColumn("direction_probs", F.col("blend_probs"))
    df = df.withColumns({"signal": G.argmax_signal("direction_probs", classes), "prob": F.array_max("direction_probs")})
    return df.withColumn("confidence", G.confidence())


def validate_window(rows: DataFrame, models: Models, cost: CostModel = CostModel()) -> DataFrame:
    """A row for each series: accuracies and per-bar return metrics."""
    df = scored(rows.withColumnRenamed("regime", "true_regime"), models)
    right = M.accuracy(df, "true_regime", "regime", [KEY]).withColumnRenamed("accuracy", "regime_accuracy").join(M.accuracy(df, "blend_label", "signal", [KEY]).drop("n").withColumnRenamed("accuracy", "signal_accuracy"), KEY)
    return right.join(B.return_metrics(B.with_returns(df.drop("future_return"), "signal", cost)), KEY, "left")


def walk_forward(bars: DataFrame, config: SplitConfig = SplitConfig(), features: FeatureConfig = FeatureConfig(), labels: LabelConfig = LabelConfig(), forest: M.Forest = M.BLENDER_FOREST, cost: CostModel = CostModel()) -> tuple[DataFrame, Models]:
    """Results by window and series, and the models of the window that earned most.

    Features are built once, before the windows. Windows train side by side."""
    rows, columns = labelled_features(bars, features, labels)
    rows = rows.persist()
    first, last = rows.agg(F.min(TIME), F.max(TIME)).first()
    splits = W.purged(W.calendar_splits(first, last, config), W.median_step(bars), config)
    if not splits:
        raise ValueError("the bars are too few for one window")

    def one(split: W.Split) -> tuple[int, Models, list]:
        models = train_window(between(rows, split.train_start, split.train_end), columns, forest)
        found = validate_window(between(rows, split.validation_start, split.validation_end), models, cost)
        return split.number, models, [r.asDict() for r in found.collect()]  # a row for each series

    with ThreadPoolExecutor(THREADS) as pool:
        done = list(pool.map(one, splits))
    rows.unpersist()
    results = bars.sparkSession.createDataFrame([{"split": k} | r for k, _, found in done for r in found])
    earned = lambda found: sum(r["cumulative_return"] or 0.0 for r in found)
    return results, max(done, key=lambda d: earned(d[2]))[1]


@dataclass
class Backtest:
    log: DataFrame
    curve: DataFrame
    trades: DataFrame
    metrics: DataFrame
    breakdown: DataFrame
    costs: DataFrame
    calibration: DataFrame
    ev_details: DataFrame
    cost_sanity: DataFrame
    audit: T.Audit


def backtest(bars: DataFrame, models: Models, features: FeatureConfig = FeatureConfig(), policy: Policy = Policy(), bins: DataFrame | None = None, cost: CostModel = CostModel()) -> Backtest:
    """Gated signals on bars, their trade log and every report of it. ``bins``: a
    calibration table of an earlier run, for expected values."""
    df = scored(build(bars, features), models)
    df = df.withColumn("side", F.when(F.col("signal") > 0, "long").when(F.col("signal") < 0, "short").otherwise("flat"))
    df = G.expected_value(df, bins) if bins is not None else df.withColumn("ev", F.lit(None).cast("double"))
    gated = G.gate(df, policy).select(*BARS, "regime", "prob", "ev", F.col("final_signal").alias("signal"))
    log = B.with_returns(gated, "signal", cost)
    curve = B.equity_curve(log)
    trades = B.trade_segments(log)
    return Backtest(log, curve, trades, B.metrics(curve), B.breakdown(log), B.cost_percentiles(log), B.calibration_report(B.quantile_bins(log)), B.ev_details(log), B.cost_sanity(log), T.audit(curve))


def infer(bars: DataFrame, models: Models, features: FeatureConfig = FeatureConfig(), policy: Policy = Policy(), rows: int = 1) -> DataFrame:
    """Signals of each series' last ``rows`` bars, from features over all bars given."""
    df = G.gate(scored(build(bars, features), models).withColumn("ev", F.lit(None).cast("double")), policy)
    return tail(df.select(KEY, TIME, "bar_idx", "regime", "signal", "prob", "confidence", "final_signal", G.risk_clip(F.col("final_signal")).alias("position")), rows)


def write_manifest(path: str, features: FeatureConfig, labels: LabelConfig, splits: SplitConfig, models: Models) -> None:
    parts = {"features": features, "labels": labels, "splits": splits}
    write_text(path, json.dumps({k: dataclasses.asdict(v) for k, v in parts.items()} | {"fingerprint": features.fingerprint(), "columns": models.columns, "written": datetime.now().isoformat()}, indent=2))


def histogram_points(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, low, high, n): what a histogram of the column shows."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    width = (high - low) / bins if low is not None and high > low else 1.0
    number = F.least(F.floor((F.col(column) - F.lit(low)) / width), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(number.alias("bin")).count().select("bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), F.col("count").alias("n"))


def session(name: str = "tidebar") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
