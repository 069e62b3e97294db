"""Positions, costs, equity, trades and their metrics.

``with_returns`` makes the trade log: for each bar the position (the signal of
the bar before isn't used: a signal earns its own next return), gross and net
return. Everything else is an aggregation of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CostModel
from ..functions import exprs as E
from ..functions.exprs import KEY, TIME, ratio

#: Fixed value: periods of a year that Sharpe ratios are scaled to.
PERIODS = 2190


def sharpe(r: Column, periods: int = PERIODS) -> Column:
    """Annualised; 0 for fewer than two returns or none that differ."""
    return F.coalesce(F.lit(float(periods) ** 0.5) * F.avg(r) / F.nullif(F.stddev_samp(r), F.lit(0.0)), F.lit(0.0))


def with_returns(df: DataFrame, signal: str = "signal", cost: CostModel = CostModel()) -> DataFrame:
    """Adds position, pnl_raw (position times the next return), turn (units
    traded; a flip is 2), cost, pnl. The last bar of a series has no return and goes."""
    df = df.withColumns({"position": F.col(signal).cast("int"), "future_return": ratio(E.lead("close"), "close") - 1})
    df = df.withColumn("turn", F.abs(F.col("position") - F.coalesce(E.lag("position"), F.lit(0))))
    df = df.where("future_return is not null and position is not null")
    raw, spent = F.col("position") * F.col("future_return"), F.col("turn") * cost.per_side
    return df.withColumns({"pnl_raw": raw, "cost": spent, "pnl": raw - spent})


def guard_min_return(df: DataFrame, least: float, signal: str = "signal", expected: str = "expected_return") -> DataFrame:
    """Signals whose expected gross return is below ``least`` become 0; a null counts as 0."""
    return df.withColumn(signal, F.when(F.abs(F.coalesce(F.col(expected), F.lit(0.0))) < least, 0).otherwise(F.col(signal)))


def equity_curve(log: DataFrame) -> DataFrame:
    """Adds equity, its peak and drawdown, by series."""
    log = log.withColumn("equity", F.product(1 + F.col("pnl")).over(E.so_far()))
    log = log.withColumn("equity_peak", F.max("equity").over(E.so_far()))
    return log.withColumn("equity_drawdown", ratio("equity", "equity_peak") - 1)


def _islands(log: DataFrame) -> DataFrame:
    changed = F.coalesce(F.col("position") != E.lag("position"), F.lit(True)).cast("int")
    return log.withColumn("__changed", changed).withColumn("segment", F.sum("__changed").over(E.so_far())).drop("__changed")


def trade_segments(log: DataFrame) -> DataFrame:
    """A row for each run of one position that isn't flat: returns are summed."""
    regime = F.coalesce(F.min_by("regime", TIME), F.lit("unknown")) if "regime" in log.columns else F.lit("unknown")
    parts = _islands(log).where("position <> 0").groupBy(KEY, "segment")
    return parts.agg(F.first("position").alias("position"), F.sum("pnl_raw").alias("trade_pnl_raw"), F.sum("pnl").alias("trade_pnl"), F.count("*").alias("bars"), F.min("bar_idx").alias("entry_idx"), regime.alias("regime"))


def flip_trades(log: DataFrame, cost: CostModel = CostModel()) -> DataFrame:
    """Trades between position changes: entry and exit at the first close of the
    run and of the next; a trade still open at the end is dropped."""
    runs = _islands(log).groupBy(KEY, "segment").agg(F.first("position").alias("position"), F.min_by("close", TIME).alias("entry"), F.min("bar_idx").alias("entry_idx"))
    after = Window.partitionBy(KEY).orderBy("segment")
    runs = runs.withColumn("exit", F.lead("entry").over(after)).where("position <> 0 and exit is not null")
    return runs.withColumn("trade_return", (ratio("exit", "entry") - 1) * F.col("position") - 2 * cost.per_side)


def trade_metrics(trades: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """profit_factor is null without losses; a side without trades has null averages."""
    v = F.col(value)
    won, lost = F.when(v > 0, v), F.when(v < 0, v)
    profit, loss = F.coalesce(F.sum(won), F.lit(0.0)), F.coalesce(F.sum(lost), F.lit(0.0))
    return trades.groupBy(*(keys or [])).agg(F.count(v).alias("trades"), F.avg((v > 0).cast("double")).alias("win_rate"), F.avg(v).alias("avg_trade"), (profit / F.nullif(-loss, F.lit(0.0))).alias("profit_factor"), F.avg(won).alias("avg_win"), F.avg(lost).alias("avg_loss"), profit.alias("gross_profit"), (-loss).alias("gross_loss"))


def drawdown_stats(curve: DataFrame) -> DataFrame:
    """(symbol, max_drawdown, max_drawdown_duration): the deepest fall and the
    longest run below the peak."""
    under = curve.withColumn("__up", F.count(F.when(F.col("equity_drawdown") >= 0, 1)).over(E.so_far()))
    runs = under.groupBy(KEY, "__up").agg(F.count(F.when(F.col("equity_drawdown") < 0, 1)).alias("n"), F.min("equity_drawdown").alias("dd"))
    return runs.groupBy(KEY).agg(F.least(F.min("dd"), F.lit(0.0)).alias("max_drawdown"), F.max("n").alias("max_drawdown_duration"))


def metrics(curve: DataFrame, periods: int = PERIODS) -> DataFrame:
    """A row for each series. total_return leaves the first bar's return out, as
    a curve's own growth does; total_return_from_1 has it."""
    sided = lambda s: F.avg(F.when(F.col("position") == s, (F.col("pnl_raw") > 0).cast("double")))
    first, last, n = F.min_by("equity", TIME), F.max_by("equity", TIME), F.count("*")
    moved = F.col("pnl") != 0
    out = curve.groupBy(KEY).agg(
        n.alias("bars"), (last / F.nullif(first, F.lit(0.0)) - 1).alias("total_return"), (last - 1).alias("total_return_from_1"),
        (F.pow(F.nullif(last, F.lit(0.0)) / F.nullif(first, F.lit(0.0)), F.lit(float(periods)) / n) - 1).alias("cagr"), sharpe(F.col("pnl"), periods).alias("sharpe"),
        F.coalesce(F.min("equity_drawdown"), F.lit(0.0)).alias("max_drawdown"), F.avg(F.when(moved, (F.col("pnl") > 0).cast("double"))).alias("hit_rate"),
        sided(1).alias("long_accuracy"), sided(-1).alias("short_accuracy"), F.sum("cost").alias("total_cost"), F.avg("turn").alias("turnover"),
    )
    return out


def breakdown(log: DataFrame, periods: int = PERIODS) -> DataFrame:
    """Overall, by side, by regime and by both, in one pass (GROUPING SETS);
    ``level`` tells which. Flat bars count overall and by regime."""
    side = F.when(F.col("position") > 0, "long").when(F.col("position") < 0, "short").otherwise("flat")
    rows = log.withColumn("side", side)
    grouped = rows.groupingSets([[], ["side"], ["regime"], ["regime", "side"]], "regime", "side")
    moved = F.col("pnl") != 0
    return grouped.agg(
        F.grouping_id().alias("level"), F.count("*").alias("bars"), F.avg("pnl").alias("mean_pnl"), F.avg("pnl_raw").alias("mean_pnl_raw"), F.sum("pnl").alias("sum_pnl"), F.sum("cost").alias("sum_cost"),
        sharpe(F.col("pnl"), periods).alias("sharpe"), F.avg(F.when(moved, (F.col("pnl") > 0).cast("double"))).alias("hit_rate"),
    )


def cost_percentiles(log: DataFrame) -> DataFrame:
    """Quantiles of net and gross trade returns with the same grouping sets."""
    side = F.when(F.col("position") > 0, "long").otherwise("short")
    rows = log.where("position <> 0").withColumn("side", side)
    q = F.percentile("pnl_raw", F.array(*(F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95))))
    out = rows.groupingSets([[], ["side"], ["regime", "side"]], "regime", "side").agg(F.grouping_id().alias("level"), F.count("*").alias("bars"), F.avg("pnl_raw").alias("mean_gross"), F.avg("cost").alias("mean_cost"), q.alias("q"))
    return out.select("regime", "side", "level", "bars", "mean_gross", "mean_cost", *(F.col("q")[i].alias(f"p{p}") for i, p in enumerate((5, 25, 50, 75, 95))))


def nonoverlap_metrics(trades: DataFrame, cost: CostModel = CostModel()) -> DataFrame:
    """Of ``kernels.greedy_trades``: a row for each series that traded."""
    return trade_metrics(trades.where("trade_gross is not null").withColumn("net", F.col("trade_gross") - 2 * cost.per_side), "net", [KEY])


def nonoverlap_return_metrics(trades: DataFrame, cost: CostModel = CostModel()) -> DataFrame:
    """Of ``kernels.greedy_trades`` over all bars: a row for each series with every
    figure of its non-overlapping trades, 0 where it has none. profit_factor is
    null for gains without losses, 0 without either; rates are by bar."""
    spent = 2 * cost.per_side
    bars = trades.groupBy(KEY).agg(F.count("*").alias("n"))
    taken = trades.where("trade_gross is not null").withColumns({"gross": F.col("trade_gross"), "pnl": F.col("trade_gross") - spent})
    falls = drawdown_stats(equity_curve(taken))
    like = lambda c: F.coalesce(F.avg(c) / F.nullif(F.stddev_samp(c), F.lit(0.0)), F.lit(0.0))
    grown = lambda c: F.product(1 + F.col(c)) - 1
    returns = taken.groupBy(KEY).agg(
        grown("pnl").alias("cumulative_return"), grown("gross").alias("gross_cumulative_return"), F.avg("pnl").alias("mean_return"), F.stddev_samp("pnl").alias("volatility"), like("pnl").alias("sharpe_like"),
        F.avg("gross").alias("gross_mean_return"), F.stddev_samp("gross").alias("gross_volatility"), like("gross").alias("gross_sharpe_like"),
    )
    joined = bars.join(returns, KEY, "left").join(trade_metrics(taken, "pnl", [KEY]), KEY, "left").join(falls, KEY, "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    count, won = number("trades"), F.coalesce("win_rate", F.lit(0.0))
    plain = ["cumulative_return", "gross_cumulative_return", "gross_mean_return", "gross_volatility", "gross_sharpe_like", "mean_return", "volatility", "sharpe_like", "win_rate"]
    return joined.select(
        KEY, count.alias("trade_count"), (count * spent).alias("total_cost"), (count / F.col("n")).alias("trade_rate"), (2.0 * count / F.col("n")).alias("turnover"),
        *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in plain), (number("gross_cumulative_return") - number("cumulative_return")).alias("cost_impact"), number("avg_trade").alias("avg_trade_return"),
        F.when((number("gross_loss") == 0) & (number("gross_profit") == 0), 0.0).otherwise(F.col("profit_factor")).alias("profit_factor"), (won * number("avg_win") + (1 - won) * number("avg_loss")).alias("expectancy"),
        *(number(c).alias(c) for c in ("avg_win", "avg_loss", "gross_profit", "gross_loss", "max_drawdown", "max_drawdown_duration")),
    )


def ev_details(log: DataFrame) -> DataFrame:
    """A row for each bar with a signal: when, regime, side, probability, expected value and what came."""
    side = F.when(F.col("signal") > 0, "long").otherwise("short")
    return log.where("signal <> 0").select(KEY, TIME, "bar_idx", "regime", side.alias("side"), "prob", "ev", "future_return")


def cost_sanity(log: DataFrame) -> DataFrame:
    """A row for each series: entries, bars held, costs in all and for each entry, and what was earned without and with them."""
    entries = F.count_if((F.col("position") != 0) & (F.col("turn") != 0))
    spent = F.sum("cost")
    return log.groupBy(KEY).agg(entries.alias("entries"), F.count_if(F.col("position") != 0).alias("trade_bars"), spent.alias("total_cost"), (spent / F.nullif(entries, F.lit(0))).alias("avg_cost"), F.sum("pnl_raw").alias("raw_total"), F.sum("pnl").alias("net_total"))


def return_metrics(log: DataFrame) -> DataFrame:
    """Per-bar mode: a row for each series of what a classifier's signals earn."""
    n = F.count("*")
    gross, net = F.product(1 + F.col("pnl_raw")) - 1, F.product(1 + F.col("pnl")) - 1
    ratio_of = lambda c: F.coalesce(F.avg(c) / F.nullif(F.stddev_samp(c), F.lit(0.0)), F.lit(0.0))
    return log.groupBy(KEY).agg(
        n.alias("samples"), F.sum("cost").alias("total_cost"), (F.sum("turn") / n).alias("turnover"), net.alias("cumulative_return"), gross.alias("gross_cumulative_return"), (gross - net).alias("cost_impact"),
        F.avg("pnl").alias("mean_return"), F.stddev_samp("pnl").alias("volatility"), ratio_of("pnl").alias("sharpe_like"), F.avg("pnl_raw").alias("gross_mean_return"), F.stddev_samp("pnl_raw").alias("gross_volatility"), ratio_of("pnl_raw").alias("gross_sharpe_like"),
    )


def bin_edges(df: DataFrame, prob: str = "prob", bins: int = 5) -> list[float]:
    """Distinct quantile edges, on the driver: ``bins`` + 1 numbers."""
    found = df.agg(F.percentile(prob, F.array(*(F.lit(k / bins) for k in range(bins + 1))))).first()[0]
    return sorted(set(found or []))


def quantile_bins(df: DataFrame, prob: str = "prob", bins: int = 5) -> DataFrame:
    """Adds prob_bin (from 0), prob_min, prob_max: right-closed quantile bins, the
    first closed on both sides. Equal edges merge; a single value is one bin."""
    edges = bin_edges(df, prob, bins)
    p = F.col(prob)
    if len(edges) < 2:
        one = F.when(p.isNotNull(), F.lit(0)) if edges else F.lit(None).cast("int")
        return df.withColumns({"prob_bin": one, "prob_min": F.lit(edges[0] if edges else None).cast("double"), "prob_max": F.lit(edges[0] if edges else None).cast("double")})
    number = F.coalesce(*(F.when(p <= e, F.lit(k)) for k, e in enumerate(edges[1:])))
    at = lambda i: F.array(*(F.lit(e) for e in edges))[i]
    return df.withColumn("prob_bin", F.when(p.isNotNull(), number)).withColumns({"prob_min": at(F.col("prob_bin")), "prob_max": at(F.col("prob_bin") + 1)})


def calibration_report(binned: DataFrame) -> DataFrame:
    """Overall, by side, and by regime and side: how each bin's signals did.
    Bins without rows are listed: with count 0 overall, with nulls beside a key."""
    traded = binned.where("signal <> 0 and prob_bin is not null").withColumn("side", F.when(F.col("signal") > 0, "long").otherwise("short"))
    r, hit = F.col("future_return"), (F.signum("future_return") == F.signum("signal")).cast("double")
    gross = r * F.col("signal")
    found = traded.groupingSets([["prob_bin"], ["prob_bin", "side"], ["prob_bin", "regime", "side"]], "prob_bin", "regime", "side").agg(
        F.grouping_id().alias("level"), F.count("*").alias("count"), F.avg(hit).alias("hit_rate"), F.avg(gross).alias("avg_gross_return"), F.percentile(gross, F.lit(0.5)).alias("median_gross_return"), F.avg(F.abs(r)).alias("avg_abs_return")
    )
    keys = found.select(F.col("level").alias("k_level"), F.col("regime").alias("k_regime"), F.col("side").alias("k_side")).distinct()
    edges = binned.where("prob_bin is not null").groupBy(F.col("prob_bin").alias("k_bin")).agg(F.min("prob_min").alias("k_min"), F.max("prob_max").alias("k_max"))
    every = keys.join(F.broadcast(edges), F.lit(True))  # a few bins to each key
    same = (F.col("level") == F.col("k_level")) & (F.col("prob_bin") == F.col("k_bin")) & F.col("regime").eqNullSafe(F.col("k_regime")) & F.col("side").eqNullSafe(F.col("k_side"))
    out = every.join(found.withColumnRenamed("count", "n"), same, "left")
    count = F.when(F.col("k_level") == 3, F.coalesce("n", F.lit(0))).otherwise(F.col("n"))
    named = [F.col(f"k_{c}").alias(n) for c, n in (("level", "level"), ("regime", "regime"), ("side", "side"), ("bin", "prob_bin"), ("min", "prob_min"), ("max", "prob_max"))]
    return out.select(*named, count.alias("count"), "hit_rate", "avg_gross_return", "median_gross_return", "avg_abs_return")


def ev_diagnostics(df: DataFrame, ev: str = "ev", realised: str = "future_return", bins: int = 10) -> DataFrame:
    """Equal-width bins of expected value with hit rate and returns; the whole is bin null."""
    low, high = df.agg(F.min(ev), F.max(ev)).first()
    width = ((high - low) / bins) if low is not None and high > low else 1.0
    number = F.least(F.greatest(F.ceil((F.col(ev) - F.lit(low)) / width) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    r = F.col(realised)
    return df.where(F.col(ev).isNotNull() & r.isNotNull()).withColumn("bin", number).groupingSets([[], ["bin"]], "bin").agg(F.count("*").alias("n"), F.avg((r > 0).cast("double")).alias("hit_rate"), F.avg(r).alias("avg_return"), F.percentile(r, F.lit(0.5)).alias("median_return"), E.correlation(ev, realised).alias("correlation"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles, a row for each column."""
    stats = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))
    v = F.col("x.v")
    return df.select(F.explode(stats).alias("x")).groupBy(F.col("x.column").alias("column")).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.percentile(v, F.lit(0.25)).alias("p25"), F.percentile(v, F.lit(0.5)).alias("p50"), F.percentile(v, F.lit(0.75)).alias("p75"), F.max(v).alias("max"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).count()
