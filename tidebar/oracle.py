"""The same queries in DuckDB SQL, written apart from the operators."""

from __future__ import annotations

from .operators.splits import calendar_splits
from .queries import ORDER_SPLITS

S = "PARTITION BY symbol ORDER BY ts"
BARS = """bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, sum(value) AS volume
  FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx FROM bars)"""
DAILY = """bars AS (
  SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, sum(o_totalprice) AS volume
  FROM orders GROUP BY 1, 2),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx FROM bars)"""


def over(n: int | None = None) -> str:
    return f"OVER ({S})" if n is None else f"OVER ({S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


UPTO = f"OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, n: int, need: int | None = None) -> str:
    need = n if need is None else need
    value = f"{f}({x}) {over(n)}"
    return value if need <= 1 else f"CASE WHEN count({x}) {over(n)} >= {need} THEN {value} END"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def z(x: str, n: int, need: int | None = None) -> str:
    return div(f"{x} - ({roll('avg', x, n, need)})", roll("stddev_samp", x, n, need))


def slope(x: str, n: int) -> str:
    return div(f"covar_samp(bar_idx, {x}) {over(n)}", f"var_samp(bar_idx) {over(n)}")


BASE = (
    BARS
    + f""",
lagged AS (SELECT *, {', '.join(f'lag(close, {k}) {over()} AS close_{k}' for k in (1, 2, 3, 5, 10, 20))}, max(close) {UPTO} AS peak FROM b),
moved AS (
  SELECT *, {', '.join(f'close / nullif(close_{k}, 0) - 1 AS ret_{k}' for k in (1, 2, 3, 5, 10, 20))}, close - close_1 AS change,
         greatest(high - low, abs(high - close_1), abs(low - close_1)) AS tr, close / nullif(peak, 0) - 1 AS drawdown, nullif(volume, 0) AS vs,
         ln(nullif(high / nullif(low, 0), 0)) AS hl, ln(nullif(close / nullif(open, 0), 0)) AS co, ln(nullif(open / nullif(close_1, 0), 0)) AS oc1,
         ln(nullif(high / nullif(open, 0), 0)) AS ho, ln(nullif(low / nullif(open, 0), 0)) AS lo, ln(nullif(high / nullif(close, 0), 0)) AS hc, ln(nullif(low / nullif(close, 0), 0)) AS lc
  FROM lagged),
x AS MATERIALIZED (SELECT *, lag(ret_1) {over()} AS ret_lag, CASE WHEN change > 0 THEN change ELSE 0 END AS gain, CASE WHEN change < 0 THEN -change ELSE 0 END AS loss FROM moved)"""
)
SIGNALS = (
    BASE
    + f""",
averaged AS (SELECT *, {', '.join(f"{roll('avg', 'close', n)} AS sma_{n}" for n in (5, 10, 20, 40))}, percent_rank() OVER (PARTITION BY symbol ORDER BY abs(coalesce(ret_1, 0)), ts) AS pr FROM x),
sig AS MATERIALIZED (
  SELECT *, CAST(coalesce(sign(round(sma_5 - sma_20, 9)), 0) AS INTEGER) AS signal, CASE WHEN round(sma_10 - sma_40, 9) > 0 THEN 'trend_up' WHEN round(sma_10 - sma_40, 9) < 0 THEN 'trend_down' ELSE 'chop' END AS regime, 0.5 + 0.5 * pr AS prob
  FROM averaged)"""
)


def trade_log(shift: int = 0) -> str:
    close = f"(close + {shift})"
    return (
        SIGNALS
        + f""",
ahead AS (SELECT *, {close} AS px, lead({close}) {over()} / nullif({close}, 0) - 1 AS future_return, signal AS position, abs(signal - coalesce(lag(signal) {over()}, 0)) AS turn FROM sig),
log AS MATERIALIZED (SELECT *, position * future_return AS pnl_raw, turn * 0.00055 AS cost, position * future_return - turn * 0.00055 AS pnl FROM ahead WHERE future_return IS NOT NULL),
curve AS MATERIALIZED (SELECT *, equity / nullif(max(equity) {UPTO}, 0) - 1 AS dd FROM (SELECT *, product(1 + pnl) {UPTO} AS equity FROM log)),
runs AS MATERIALIZED (SELECT *, sum(changed) {UPTO} AS segment FROM (SELECT *, CASE WHEN position IS DISTINCT FROM lag(position) {over()} OR lag(position) {over()} IS NULL THEN 1 ELSE 0 END AS changed FROM log))"""
    )


def pick(prefix: str, source: str, columns: dict[str, str], places: int = 6, keys: str = "symbol, bar_idx", where: str = "") -> str:
    return f"WITH RECURSIVE {prefix} SELECT {keys}, {', '.join(f'round(CAST({v} AS DOUBLE), {places}) AS {k}' for k, v in columns.items())} FROM {source} {where}"


def same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


def recursion(name: str, source: str, start: dict[str, str], step: dict[str, str]) -> str:
    """A CTE of states by bar: ``start`` over the first bar b, ``step`` over the state p and the next bar b."""
    return f"""{name} AS (
  SELECT b.symbol, b.bar_idx, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in start.items())} FROM {source} b WHERE b.bar_idx = 0
  UNION ALL
  SELECT b.symbol, b.bar_idx, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in step.items())} FROM {name} p JOIN {source} b ON b.symbol = p.symbol AND b.bar_idx = p.bar_idx + 1)"""


def smooth(names: dict[str, tuple[str, float]]) -> tuple[dict[str, str], dict[str, str]]:
    """Starts and steps of EMAs: name to (input, alpha)."""
    return {k: f"b.{x}" for k, (x, _) in names.items()}, {k: f"p.{k} + {a!r} * (b.{x} - p.{k})" for k, (x, a) in names.items()}


def warm(x: str, n: int) -> str:
    return f"CASE WHEN bar_idx >= {n - 1} THEN {x} END"


ORACLE_SQL: dict[str, str] = {}
Q = ORACLE_SQL
OHLCV = same("open", "high", "low", "close", "volume")
Q["bars_hourly"] = pick(BARS, "b", OHLCV)
Q["bars_daily_orders"] = pick(DAILY, "b", OHLCV, 2)
Q["bars_resampled"] = pick(BARS + ", r AS (SELECT symbol, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS t, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM b GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS bar_idx FROM r)", "n", OHLCV)
Q["first_of_each_time"] = "SELECT o_orderpriority AS symbol, o_orderkey AS key, round(o_totalprice, 2) AS close FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderdate ORDER BY o_orderkey) = 1"
_counts = ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}_null, count(*) FILTER (isinf({c})) AS {c}_inf, count(*) FILTER ({c} = 0) AS {c}_zero, count(*) FILTER ({c} < 0) AS {c}_negative" for c in OHLCV)
Q["bar_quality"] = f"WITH {BARS} SELECT symbol, count(*) AS bars, count(*) FILTER (NOT (high >= low AND high >= open AND high >= close AND low <= open AND low <= close AND volume >= 0)) AS ohlc_violations, {_counts} FROM b GROUP BY 1"
Q["bars_tail"] = pick(BARS, "b", same("close"), where="QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 24")
Q["bars_between"] = pick(BARS, "b", same("close"), where="WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'")
Q["true_range_atr_sma"] = pick(BASE, "x", {"tr": "tr", "atr_14": roll("avg", "tr", 14), "atr_50": roll("avg", "tr", 50)})
_cross = BASE + f", c AS (SELECT *, round({roll('avg', 'close', 5)}, 9) AS sma_5, round({roll('avg', 'close', 20)}, 9) AS sma_20, {div(roll('sum', 'close * volume', 10), roll('sum', 'volume', 10))} AS vwma_10 FROM x)"
Q["sma_vwma_cross"] = pick(_cross, "c", same("sma_5", "sma_20", "vwma_10") | {"over": f"coalesce(CAST(lag(sma_5) {over()} <= lag(sma_20) {over()} AND sma_5 > sma_20 AS INTEGER), 0)", "under": f"coalesce(CAST(lag(sma_5) {over()} >= lag(sma_20) {over()} AND sma_5 < sma_20 AS INTEGER), 0)"})

_start, _step = smooth({"ema_12": ("close", 2 / 13), "ema_26": ("close", 2 / 27)})
Q["ema"] = pick(f"{BARS}, {recursion('e', 'b', _start, _step)}", "e", {"ema_12": warm("ema_12", 12), "ema_26": warm("ema_26", 26)})
_start, _step = smooth({"atr_7": ("tr", 1 / 7), "atr_14": ("tr", 1 / 14)})
Q["wilder_atr"] = pick(f"{BASE}, {recursion('e', 'x', _start, _step)}", "e", {"atr_7": warm("atr_7", 7), "atr_14": warm("atr_14", 14)})
_later = "SELECT symbol, ts, bar_idx - 1 AS bar_idx, gain, loss FROM x WHERE bar_idx > 0"
_start, _step = smooth({"g": ("gain", 1 / 14), "l": ("loss", 1 / 14)})
Q["rsi_wilder"] = pick(f"{BASE}, d AS MATERIALIZED ({_later}), {recursion('e', 'd', _start, _step)}", "x LEFT JOIN (SELECT symbol AS s, bar_idx + 1 AS i, g, l FROM e) ON s = symbol AND i = bar_idx", {"rsi_14": "CASE WHEN bar_idx >= 14 THEN CASE WHEN l = 0 AND g > 0 THEN 100 WHEN l = 0 THEN NULL ELSE 100 - 100 / (1 + g / l) END END"})
_dm = f"u AS (SELECT *, high - lag(high) {over()} AS up, lag(low) {over()} - low AS down FROM x), m AS MATERIALIZED (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mdm FROM u)"
_start, _step = smooth({"a": ("tr", 1 / 14), "pl": ("pdm", 1 / 14), "mi": ("mdm", 1 / 14)})
_dx = "dx AS MATERIALIZED (SELECT symbol, bar_idx - 13 AS bar_idx, 100 * abs(pl - mi) / nullif(pl + mi, 0) AS dx FROM e WHERE bar_idx >= 13)"
_start2, _step2 = smooth({"adx": ("dx", 1 / 14)})
ADX = f"{BASE}, {_dm}, {recursion('e', 'm', _start, _step)}, {_dx}, {recursion('f', 'dx', _start2, _step2)}, adx AS MATERIALIZED (SELECT x.*, CASE WHEN x.bar_idx >= 26 THEN f.adx END AS adx_14 FROM x LEFT JOIN f ON f.symbol = x.symbol AND f.bar_idx = x.bar_idx - 13)"
Q["adx"] = pick(ADX, "adx", same("adx_14"))
_start, _step = smooth({"e13": ("close", 2 / 14), "e21": ("close", 2 / 22)})
_macd = f"{BARS}, {recursion('e', 'b', _start, _step)}, m AS (SELECT b.symbol, b.ts, b.bar_idx, CASE WHEN b.bar_idx >= 20 THEN e13 - e21 END AS macd FROM b JOIN e USING (symbol, bar_idx)), n AS (SELECT *, {roll('avg', 'macd', 8)} AS macd_signal FROM m)"
Q["macd"] = pick(_macd, "n", same("macd", "macd_signal") | {"macd_hist": "macd - macd_signal"})


def envelope(top: tuple[int, ...], bottom: tuple[int, ...], limits: tuple[int, int], atr_top: int, atr_bottom: int, prefix: str) -> str:
    """States of both extremes: level and rows since the last touch."""
    factor = lambda since, f: f"CASE WHEN {since} <= {limits[0]} THEN {f[0]} WHEN {since} <= {limits[1]} THEN {f[1]} ELSE {f[2]} END"
    fall = lambda lv, n, f, a, op: f"p.{lv} {op} (CASE WHEN b.bar_idx >= {a - 1} THEN p.a{a} + (1.0 / {a}) * (b.tr - p.a{a}) ELSE 0 END) * 0.005 * ({factor(f'p.{n}', f)})"
    start = {"t": "b.close", "bo": "b.close", "nt": "0", "nb": "0"} | {f"a{a}": "b.tr" for a in {atr_top, atr_bottom}}
    step = {
        "t": f"CASE WHEN b.close >= p.t THEN b.close ELSE {fall('t', 'nt', top, atr_top, '-')} END", "bo": f"CASE WHEN b.close <= p.bo THEN b.close ELSE {fall('bo', 'nb', bottom, atr_bottom, '+')} END",
        "nt": "CASE WHEN b.close >= p.t THEN 0 ELSE p.nt + 1 END", "nb": "CASE WHEN b.close <= p.bo THEN 0 ELSE p.nb + 1 END",
    } | {f"a{a}": f"p.a{a} + (1.0 / {a}) * (b.tr - p.a{a})" for a in {atr_top, atr_bottom}}
    return recursion(prefix, "x", start, step)


_env = ", ".join([BASE, envelope((35, 15, 12), (30, 15, 12), (87, 348), 17, 43, "su"), envelope((35, 15, 12), (28, 9, 25), (87, 174), 17, 43, "pv"), envelope((18, 12, 12), (24, 12, 12), (87, 87), 10, 10, "tm")])
Q["envelopes"] = pick(_env, "su JOIN pv USING (symbol, bar_idx) JOIN tm USING (symbol, bar_idx)", {"superma_topvector01": "su.t", "superma_botvector01": "su.bo", "pvt_topvector01": "pv.t", "pvt_botvector01": "pv.bo", "trendmagic_topvector01": "tm.t", "trendmagic_botvector01": "tm.bo"})

_start, _step = smooth({"m": ("tr", 1 / 14)})
_share = "nullif(b.atr / nullif(b.close, 0), 0)"
_alpha = f"least(greatest(0.20 / ({_share} + 1e-9), 0.02), 0.60)"
_vm = f"{BASE}, {recursion('e', 'x', _start, _step)}, a AS MATERIALIZED (SELECT x.symbol, x.bar_idx, x.close, CASE WHEN x.bar_idx >= 13 THEN e.m END AS atr FROM x JOIN e USING (symbol, bar_idx))"
_ln = "ln(nullif(b.close, 0))"
_mem = recursion("v", "a", {"y": _ln}, {"y": f"CASE WHEN {_ln} IS NULL THEN p.y WHEN p.y IS NULL THEN {_ln} WHEN {_share} IS NULL THEN p.y ELSE p.y + {_alpha} * ({_ln} - p.y) END"})
Q["vol_memory"] = pick(f"{_vm}, {_mem}", "v", {"mem_vol": "y"})


def _triple(n: int, spans: tuple[int, ...]) -> tuple[str, str, str]:
    """CTEs of EMAs over one another, each starting where the one before is first known."""
    ctes, source, shift = [], "b", 0
    for k, span in enumerate(spans):
        if k:
            ctes.append(f"s{n}_{k} AS MATERIALIZED (SELECT symbol, bar_idx - {spans[k - 1] - 1} AS bar_idx, y FROM t{n}_{k - 1} WHERE bar_idx >= {spans[k - 1] - 1})")
            source, shift = f"s{n}_{k}", shift + spans[k - 1] - 1
        x = "b.y" if k else "b.close"
        ctes.append(recursion(f"t{n}_{k}", source, {"y": x}, {"y": f"p.y + {2 / (span + 1)!r} * ({x} - p.y)"}))
    last = len(spans) - 1
    return ", ".join(ctes), f"LEFT JOIN t{n}_{last} q{n} ON q{n}.symbol = b.symbol AND q{n}.bar_idx = b.bar_idx - {shift}", f"CASE WHEN q{n}.bar_idx >= {spans[-1] - 1} THEN q{n}.y END"


_t8, _t10 = _triple(8, (8, 5, 3)), _triple(10, (10, 6, 3))
Q["triple_ema"] = pick(f"{BARS}, {_t8[0]}, {_t10[0]}", f"b {_t8[1]} {_t10[1]}", {"hls_8": _t8[2], "hls_10": _t10[2]}, keys="b.symbol, b.bar_idx")

Q["rsi_sma"] = pick(BASE, "x", {f"rsi_{n}": f"100 - 100 / (1 + {div(roll('avg', 'gain', n), roll('avg', 'loss', n))})" for n in (7, 14, 21)})


def channel(n: int) -> str:
    full = f"count(close) {over(n)} >= {n}"
    return f"ch AS (SELECT *, CASE WHEN {full} THEN regr_slope(close, bar_idx) {over(n)} END AS k, CASE WHEN {full} THEN avg(close) {over(n)} END AS m, var_pop(close) {over(n)} AS vy, var_pop(bar_idx) {over(n)} AS vx FROM b), li AS (SELECT *, m + k * {(n - 1) / 2} AS mid, sqrt(greatest(vy - k * k * vx, 0)) AS dev FROM ch)"


_pos = "(close - (mid - 2 * dev)) / nullif(4 * dev, 0)"
Q["linreg_channel"] = pick(f"{BARS}, {channel(100)}", "li", {"lr_mid": "mid", "lr_slope": "k", "lr_intercept": "m - k * 49.5", "lr_dev": "CASE WHEN k IS NOT NULL THEN dev END", "lr_upper": "CASE WHEN k IS NOT NULL THEN mid + 2 * dev END", "lr_lower": "CASE WHEN k IS NOT NULL THEN mid - 2 * dev END", "lr_width": "CASE WHEN k IS NOT NULL THEN 4 * dev END", "lr_pos": f"CASE WHEN k IS NOT NULL THEN least(greatest({_pos}, 0), 1) END"}, 5)
_stats = {}
for _n in (5, 20):
    _stats |= {f"close_mean_{_n}": roll("avg", "close", _n, 1), f"close_std_{_n}": roll("stddev_samp", "close", _n, 1), f"close_max_{_n}": roll("max", "close", _n, 1), f"close_min_{_n}": roll("min", "close", _n, 1), f"close_slope_{_n}": slope("close", _n), f"close_zscore_{_n}": z("close", _n, 1)}
Q["rolling_slope_zscore"] = pick(BARS, "b", _stats, 5)
Q["ml_returns_vol"] = pick(BASE, "x", same(*(f"ret_{k}" for k in (1, 2, 3, 5, 10, 20))) | {f"vol_{n}": roll("stddev_samp", "ret_1", n) for n in (5, 10, 20, 50)} | {f"sma_dist_{n}": f"{div('close', roll('avg', 'close', n))} - 1" for n in (10, 20, 50)})
_vols = BASE + f", v AS (SELECT *, {roll('stddev_samp', 'ret_1', 5)} AS vol_5, {roll('stddev_samp', 'ret_1', 20)} AS vol_20 FROM x)"
Q["zscores"] = pick(_vols, "v", {f"{c}_z": z(c, 20) for c in ("ret_1", "ret_5", "vol_5", "vol_20")}, 5)
Q["candle_metrics"] = pick(BARS, "b", {"upper_wick": div("high - greatest(open, close)", "close"), "lower_wick": div("least(open, close) - low", "close"), "body": div("abs(close - open)", "close"), "hl_pct": div("high - low", "close")})
Q["skew_kurt"] = pick(BASE, "x", {"skew_20": roll("skewness", "ret_1", 20), "kurt_20": roll("kurtosis", "ret_1", 20)}, 4)
Q["volume_anomaly"] = pick(BARS, "b", {"volume_z": z("volume", 20), "volume_ratio": div("volume", roll("avg", "volume", 20)), "volume_surge": f"coalesce(CAST(volume > 1.5 * ({roll('avg', 'volume', 20)}) AS INTEGER), 0)"})
Q["vol_compression"] = pick(BASE, "x", {f"vol_comp_{a}_{b}": div(roll("stddev_samp", "ret_1", a), roll("stddev_samp", "ret_1", b)) for a, b in ((5, 20), (10, 50))})
_a14, _a50, _v20, _v100 = roll("avg", "tr", 14), roll("avg", "tr", 50), roll("stddev_samp", "ret_1", 20), roll("stddev_samp", "ret_1", 100)
Q["regime_context"] = pick(BASE, "x", {"atr14_norm": div(_a14, "close"), "atr50_norm": div(_a50, "close"), "atr_ratio": div(_a14, _a50), "vol20": _v20, "vol100": _v100, "vol_ratio": div(_v20, _v100), "trend_slope_20": slope("close", 20), "trend_slope_50": slope("close", 50), "trend_sign": f"coalesce(sign({slope('close', 20)}), 0)"}, 4)
_micro: dict[str, str] = {}
for _n in (3, 6, 12, 24, 48):
    _k = 0.34 / (1.34 + (_n + 1) / (_n - 1))
    _yz = f"({roll('var_samp', 'oc1', _n)}) + {_k!r} * ({roll('var_samp', 'co', _n)}) + {1 - _k!r} * ({roll('avg', 'ho * hc + lo * lc', _n)})"
    _micro |= {
        f"amihud_{_n}": roll("avg", "abs(ret_1) / vs", _n), f"impact_per_vol_{_n}": roll("avg", "abs(change) / vs", _n), f"volume_ratio_{_n}": div("volume", roll("avg", "volume", _n)),
        f"signed_vol_imbalance_{_n}": div(roll("sum", "sign(ret_1) * volume", _n), roll("sum", "volume", _n)), f"up_vol_ratio_{_n}": div(roll("sum", "CASE WHEN ret_1 > 0 THEN volume ELSE 0 END", _n), roll("sum", "volume", _n)),
        f"parkinson_vol_{_n}": f"sqrt({roll('avg', 'hl * hl / (4 * ln(2))', _n)})", f"gk_vol_{_n}": f"sqrt({roll('avg', 'CASE WHEN hl IS NOT NULL AND co IS NOT NULL THEN greatest(0.5 * hl * hl - (2 * ln(2) - 1) * co * co, 0) END', _n)})",
        f"yz_vol_{_n}": f"CASE WHEN ({_yz}) IS NOT NULL THEN sqrt(greatest({_yz}, 0)) END",
        f"return_autocorr_1_{_n}": f"CASE WHEN count(ret_1 + ret_lag) {over(_n)} >= {_n} THEN CASE WHEN NOT isnan(corr(ret_1, ret_lag) {over(_n)}) THEN corr(ret_1, ret_lag) {over(_n)} END END",
        f"variance_ratio_{_n}_k2": div(roll("var_samp", "ret_2", _n), f"2 * ({roll('var_samp', 'ret_1', _n)})"), f"drawdown_min_{_n}": roll("min", "drawdown", _n), f"return_min_{_n}": roll("min", "ret_1", _n),
    }
Q["microstructure"] = pick(BASE, "x", _micro, 5)
Q["drawdown_islands"] = pick(BASE + f", i AS (SELECT *, count(*) FILTER (close = peak) {UPTO} AS island FROM x)", "i", {"drawdown_depth": "drawdown", "drawdown_duration": "row_number() OVER (PARTITION BY symbol, island ORDER BY ts) - 1"})
_streak = SIGNALS + f", n AS (SELECT *, CASE WHEN lag(signal) {over()} = signal THEN 0 ELSE 1 END AS fresh FROM sig), i AS (SELECT *, sum(fresh) {UPTO} AS island FROM n)"
Q["signal_streak_since"] = pick(_streak, "i", {"streak": "CASE WHEN signal = 0 THEN 0 ELSE row_number() OVER (PARTITION BY symbol, island ORDER BY ts) END", "since_long": f"bar_idx - max(CASE WHEN signal = 1 THEN bar_idx END) {UPTO}", "since_short": f"bar_idx - max(CASE WHEN signal = -1 THEN bar_idx END) {UPTO}"})
_top, _bot = roll("max", "close", 100, 1), roll("min", "close", 100, 1)
Q["distance_to_extreme"] = pick(BARS, "b", {"distance": f"least(abs({div(f'close - {_top}', _top)}), abs({div(f'close - {_bot}', _bot)}))"})
_latch = BARS + f", r AS (SELECT *, (close - ({roll('avg', 'close', 23)})) * 10000 AS res FROM b), v AS (SELECT *, CASE WHEN res > 520 AND close > open THEN 1 WHEN res < -520 AND close < open THEN -1 END AS ev FROM r)"
Q["pvt_latch"] = pick(_latch, "v", {"pvt_nRes": "res", "pvt_sig_pvt": f"coalesce(last_value(ev IGNORE NULLS) {UPTO}, 0)"}, 4)
_raw = BASE + f", r AS (SELECT *, CASE WHEN ret_1 > 0.5 THEN 1 ELSE 0 END AS lr, CASE WHEN ret_1 < -0.4 THEN 1 ELSE 0 END AS sr FROM x), i AS (SELECT *, sum(lr) {UPTO} AS nl, sum(sr) {UPTO} AS ns FROM r)"
Q["pyramiding"] = pick(_raw, "i", {"sectionLongs": "sum(lr) OVER (PARTITION BY symbol, ns ORDER BY ts ROWS UNBOUNDED PRECEDING)", "sectionShorts": "sum(sr) OVER (PARTITION BY symbol, nl ORDER BY ts ROWS UNBOUNDED PRECEDING)"})
_day = BARS + ", d AS (SELECT symbol, CAST(ts AS DATE) AS day, (max(high) + min(low) + arg_max(close, ts)) / 3 AS pv FROM b GROUP BY 1, 2), e AS (SELECT *, lag(pv) OVER (PARTITION BY symbol ORDER BY day) AS before FROM d)"
Q["daily_pivot"] = pick(_day, "b JOIN e ON e.symbol = b.symbol AND e.day = CAST(b.ts AS DATE)", {'"pivot"': "pv", "pivot_prev_day": "before"}, keys="b.symbol, b.bar_idx")
_whole = BARS + ", r AS (SELECT symbol, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS t FROM b GROUP BY 1, 2), a AS (SELECT symbol, t + INTERVAL 17 MINUTE AS ts, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS bar_idx FROM r)"
Q["as_of_join"] = pick(_whole, "a ASOF LEFT JOIN b ON a.symbol = b.symbol AND a.ts >= b.ts", {"known_close": "b.close", "known_idx": "b.bar_idx"}, keys="a.symbol, a.bar_idx")
_lab = BARS + f", f AS (SELECT *, lead(close, 12) {over()} / nullif(close, 0) - 1 AS fr FROM b), s AS (SELECT *, avg(fr) {over(12)} AS sr FROM f)"
Q["direction_labels"] = pick(_lab, "s", {"future_return": "fr", "smoothed_return": "sr", "blend_label": "CASE WHEN sr > 0.0016 THEN 1 WHEN sr < -0.0016 THEN -1 ELSE 0 END", "threshold": "0.0005", "effective_threshold": "0.0016", "round_trip_cost": "0.0011"})
_lab2 = _lab + ", t AS (SELECT *, CASE WHEN sr > 0.0005 THEN 1 WHEN sr < -0.0005 THEN -1 ELSE 0 END AS blend_label FROM s)"
Q["label_stats"] = pick(_lab2, "t", {"mean_return": "avg(fr)", "std_return": "stddev_samp(fr)", "p25": "quantile_cont(fr, 0.25)", "median_return": "quantile_cont(fr, 0.5)", "p75": "quantile_cont(fr, 0.75)"}, keys="blend_label, count(*) AS n, count(fr) AS n_return", where="GROUP BY GROUPING SETS ((blend_label), ())")
Q["regime_labels_rule"] = f"WITH {BARS}, {channel(30)} SELECT symbol, bar_idx, CASE WHEN k > 0.001 AND close > mid THEN 'trend_up' WHEN k < -0.001 AND close < mid THEN 'trend_down' ELSE 'chop' END AS regime FROM li"
_reg = ADX + f", r AS (SELECT *, ({roll('avg', 'close', 10)}) - ({roll('avg', 'close', 40)}) AS d FROM adx)"
Q["regime_labels_adx"] = f"WITH RECURSIVE {_reg} SELECT symbol, bar_idx, CASE WHEN adx_14 > 25 AND d > 0 THEN 'trend_up' WHEN adx_14 > 25 AND d < 0 THEN 'trend_down' ELSE 'chop' END AS regime FROM r"


def _splits_values() -> str:
    from datetime import datetime

    rows = []
    for s in calendar_splits(datetime(1992, 1, 31), datetime(1998, 12, 31), ORDER_SPLITS):
        for part, a, c in (("train", s.train_start, s.train_end), ("validation", s.validation_start, s.validation_end)):
            rows.append(f"({s.number}, '{part}', TIMESTAMP '{a}', TIMESTAMP '{c}')")
    return ", ".join(rows)


Q["walk_forward_assign"] = f"WITH {DAILY}, w(split, part, a, c) AS (VALUES {_splits_values()}) SELECT symbol, split, part, count(*) AS n, min(bar_idx) AS first_idx, max(bar_idx) AS last_idx FROM b JOIN w ON ts >= a AND ts < c GROUP BY 1, 2, 3"
_fold = BARS + ", n AS (SELECT *, count(*) OVER (PARTITION BY symbol) // 5 AS size FROM b), f AS (SELECT *, unnest(range(0, 5)) AS fold, least(bar_idx // size, 4) AS own FROM n), p AS (SELECT *, CASE WHEN own = fold THEN 'test' WHEN bar_idx < fold * size - 12 THEN 'train' END AS part FROM f WHERE fold * size - 12 > 0)"
Q["purged_kfold"] = f"WITH {_fold} SELECT symbol, CAST(fold AS INTEGER) AS fold, part, count(*) AS n, min(bar_idx) AS first_idx, max(bar_idx) AS last_idx FROM p WHERE part IS NOT NULL GROUP BY ALL"
Q["chronological_split"] = f"WITH {BARS}, n AS (SELECT *, CASE WHEN bar_idx < floor(count(*) OVER (PARTITION BY symbol) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'validation' END AS part FROM b) SELECT symbol, part, count(*) AS n, max(bar_idx) AS last_idx FROM n GROUP BY ALL"
_wf = BARS + """, n AS (SELECT *, count(*) OVER (PARTITION BY symbol) // 4 AS size FROM b), f AS (SELECT *, unnest(range(0, 4)) AS fold FROM n),
p AS (SELECT *, CASE WHEN bar_idx >= fold * size AND bar_idx < fold * size + floor(size * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN bar_idx >= fold * size + floor(size * CAST(0.7 AS DOUBLE)) + 6 AND bar_idx < (fold + 1) * size THEN 'test' END AS part, sign(close - open) AS s FROM f),
r AS (SELECT *, lag(s) OVER w * (close / nullif(lag(close) OVER w, 0) - 1) AS r FROM p WHERE part IS NOT NULL WINDOW w AS (PARTITION BY symbol, fold, part ORDER BY ts))"""
Q["walk_forward_strategy"] = pick(_wf, "r", {"sharpe": "coalesce(sqrt(252) * avg(r) / nullif(stddev_samp(r), 0), 0)", "total_return": "product(1 + r) - 1"}, 4, "symbol, CAST(fold AS INTEGER) AS fold, part, count(r) AS n", "GROUP BY symbol, fold, part")

_cols = ("l_quantity", "l_extendedprice")
_li = "l AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem)"
for _kind, _m, _s in (("zscore", "avg({c})", "stddev_samp({c})"), ("minmax", "min({c})", "max({c}) - min({c})"), ("robust", "quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")):
    _agg = ", ".join(f"{_m.format(c=c)} AS m_{c}, {_s.format(c=c)} AS s_{c}" for c in _cols)
    Q[f"scale_{_kind}"] = pick(f"{_li}, a AS (SELECT {_agg} FROM l)", "l, a", {c: f"({c} - m_{c}) / s_{c}" for c in _cols} | {"constant": "0.0"}, 5, "l_orderkey, l_linenumber")

Q["positions_costs"] = pick(trade_log(), "log", same("position", "pnl_raw", "turn", "cost", "pnl"))
Q["equity_curve"] = pick(trade_log(1000), "curve", {"equity": "equity", "equity_drawdown": "dd"}, 5)
_seg = trade_log() + ", seg AS (SELECT symbol, CAST(segment AS BIGINT) AS segment, first(position) AS position, count(*) AS bars, min(bar_idx) AS entry_idx, arg_min(regime, ts) AS regime, sum(pnl_raw) AS trade_pnl_raw, sum(pnl) AS trade_pnl FROM runs WHERE position <> 0 GROUP BY 1, 2)"
Q["trade_segments"] = pick(_seg, "seg", same("trade_pnl_raw", "trade_pnl"), keys="symbol, segment, position, bars, entry_idx, regime")
_flip = trade_log() + ", g AS (SELECT symbol, CAST(segment AS BIGINT) AS segment, first(position) AS position, arg_min(px, ts) AS entry, min(bar_idx) AS entry_idx FROM runs GROUP BY 1, 2), h AS (SELECT *, lead(entry) OVER (PARTITION BY symbol ORDER BY segment) AS exit FROM g)"
Q["flip_trades"] = pick(_flip, "h", {"entry": "entry", "exit": "exit", "trade_return": "(exit / nullif(entry, 0) - 1) * position - 0.0011"}, keys="symbol, segment, position, entry_idx", where="WHERE position <> 0 AND exit IS NOT NULL")
_v = "trade_pnl"
Q["trade_metrics"] = pick(_seg, "seg", {"win_rate": f"avg(CAST({_v} > 0 AS INTEGER))", "avg_trade": f"avg({_v})", "profit_factor": f"coalesce(sum({_v}) FILTER ({_v} > 0), 0) / nullif(-coalesce(sum({_v}) FILTER ({_v} < 0), 0), 0)", "avg_win": f"avg({_v}) FILTER ({_v} > 0)", "avg_loss": f"avg({_v}) FILTER ({_v} < 0)", "gross_profit": f"coalesce(sum({_v}) FILTER ({_v} > 0), 0)", "gross_loss": f"-coalesce(sum({_v}) FILTER ({_v} < 0), 0)"}, 5, "symbol, count(trade_pnl) AS trades", "GROUP BY symbol")
_dd = trade_log(1000) + f", u AS (SELECT *, count(*) FILTER (dd >= 0) {UPTO} AS up FROM curve), k AS (SELECT symbol, up, count(*) FILTER (dd < 0) AS n, min(dd) AS dd FROM u GROUP BY 1, 2)"
Q["drawdown_stats"] = pick(_dd, "k", {"max_drawdown": "least(min(dd), 0)"}, keys="symbol, max(n) AS max_drawdown_duration", where="GROUP BY symbol")
_sharpe = "coalesce(sqrt(2190) * avg(pnl) / nullif(stddev_samp(pnl), 0), 0)"
Q["metrics_overall"] = pick(trade_log(1000), "curve", {"total_return": "arg_max(equity, ts) / nullif(arg_min(equity, ts), 0) - 1", "total_return_from_1": "arg_max(equity, ts) - 1", "sharpe": _sharpe, "max_drawdown": "min(dd)", "hit_rate": "avg(CAST(pnl > 0 AS INTEGER)) FILTER (pnl <> 0)", "long_accuracy": "avg(CAST(pnl_raw > 0 AS INTEGER)) FILTER (position = 1)", "short_accuracy": "avg(CAST(pnl_raw > 0 AS INTEGER)) FILTER (position = -1)", "total_cost": "sum(cost)", "turnover": "avg(turn)"}, 5, "symbol, count(*) AS bars", "GROUP BY symbol")
_side = trade_log() + ", s AS (SELECT *, CASE WHEN position > 0 THEN 'long' WHEN position < 0 THEN 'short' ELSE 'flat' END AS side FROM log)"
Q["metrics_grouping_sets"] = pick(_side, "s", {"mean_pnl": "avg(pnl)", "mean_pnl_raw": "avg(pnl_raw)", "sum_pnl": "sum(pnl)", "sum_cost": "sum(cost)", "sharpe": _sharpe, "hit_rate": "avg(CAST(pnl > 0 AS INTEGER)) FILTER (pnl <> 0)"}, 5, "regime, side, grouping(regime, side) AS level, count(*) AS bars", "GROUP BY GROUPING SETS ((), (side), (regime), (regime, side))")
_g, _nt = "(product(1 + pnl_raw) - 1)", "(product(1 + pnl) - 1)"
Q["return_metrics"] = pick(trade_log(1000), "log", {"total_cost": "sum(cost)", "turnover": "avg(turn)", "cumulative_return": _nt, "gross_cumulative_return": _g, "cost_impact": f"{_g} - {_nt}", "mean_return": "avg(pnl)", "volatility": "stddev_samp(pnl)", "sharpe_like": "coalesce(avg(pnl) / nullif(stddev_samp(pnl), 0), 0)", "gross_mean_return": "avg(pnl_raw)", "gross_volatility": "stddev_samp(pnl_raw)", "gross_sharpe_like": "coalesce(avg(pnl_raw) / nullif(stddev_samp(pnl_raw), 0), 0)"}, 5, "symbol, count(*) AS samples", "GROUP BY symbol")
Q["cost_percentiles"] = pick(_side, "s", {"mean_gross": "avg(pnl_raw)", "mean_cost": "avg(cost)"} | {f"p{p}": f"quantile_cont(pnl_raw, {p / 100})" for p in (5, 25, 50, 75, 95)}, 5, "regime, side, grouping(regime, side) AS level, count(*) AS bars", "WHERE position <> 0 GROUP BY GROUPING SETS ((), (side), (regime, side))")
_greedy = SIGNALS + f""", h AS MATERIALIZED (SELECT symbol, bar_idx, (lead(close, 12) {over()} / nullif(close, 0) - 1) * signal AS r, signal, count(*) OVER (PARTITION BY symbol) AS n FROM sig),
w AS (SELECT symbol, bar_idx, 0 AS free, FALSE AS taken FROM h WHERE FALSE UNION ALL SELECT symbol, bar_idx, CASE WHEN signal <> 0 AND r IS NOT NULL THEN 12 ELSE 1 END, signal <> 0 AND r IS NOT NULL FROM h WHERE bar_idx = 0),
t AS (SELECT symbol, bar_idx, free, taken FROM w UNION ALL SELECT h.symbol, h.bar_idx, CASE WHEN h.signal <> 0 AND h.r IS NOT NULL THEN 12 ELSE 1 END, h.signal <> 0 AND h.r IS NOT NULL FROM t JOIN h ON h.symbol = t.symbol AND h.bar_idx = t.bar_idx + t.free)"""
Q["nonoverlap_trades"] = pick(_greedy, "t JOIN h USING (symbol, bar_idx)", {"trade_gross": "h.r"}, 5, where="WHERE taken")

_edges = """e AS (SELECT list_sort(list_distinct([quantile_cont(prob, 0.0), quantile_cont(prob, 0.2), quantile_cont(prob, 0.4), quantile_cont(prob, 0.6), quantile_cont(prob, 0.8), quantile_cont(prob, 1.0)])) AS ed FROM src),
bin AS MATERIALIZED (SELECT src.*, ed, greatest(len(list_filter(ed, lambda v: v < prob)) - 1, 0) AS prob_bin FROM src, e),
binned AS MATERIALIZED (SELECT *, ed[prob_bin + 1] AS prob_min, ed[prob_bin + 2] AS prob_max FROM bin)"""
Q["prob_bins"] = pick(SIGNALS + ", src AS (SELECT * FROM sig), " + _edges, "binned", same("prob_bin", "prob_min", "prob_max"))
CALIBRATION = SIGNALS + f""", src AS MATERIALIZED (SELECT * FROM (SELECT *, lead(close, 1) {over()} / nullif(close, 0) - 1 AS future_return FROM sig) WHERE future_return IS NOT NULL), {_edges},
traded AS (SELECT *, CASE WHEN signal > 0 THEN 'long' ELSE 'short' END AS side FROM binned WHERE signal <> 0),
found AS (
  SELECT prob_bin, regime, side, grouping(prob_bin, regime, side) AS level, count(*) AS n, avg(CAST(sign(future_return) = sign(signal) AS INTEGER)) AS hit_rate, avg(future_return * signal) AS avg_gross_return,
         quantile_cont(future_return * signal, 0.5) AS median_gross_return, avg(abs(future_return)) AS avg_abs_return
  FROM traded GROUP BY GROUPING SETS ((prob_bin), (prob_bin, side), (prob_bin, regime, side))),
keys AS (SELECT DISTINCT level, regime, side FROM found),
bounds AS (SELECT prob_bin, min(prob_min) AS prob_min, max(prob_max) AS prob_max FROM binned GROUP BY 1),
report AS MATERIALIZED (
  SELECT k.level, k.regime, k.side, o.prob_bin, o.prob_min, o.prob_max, CASE WHEN k.level = 3 THEN coalesce(n, 0) ELSE n END AS count, hit_rate, avg_gross_return, median_gross_return, avg_abs_return
  FROM keys k CROSS JOIN bounds o LEFT JOIN found f ON f.level = k.level AND f.prob_bin = o.prob_bin AND f.regime IS NOT DISTINCT FROM k.regime AND f.side IS NOT DISTINCT FROM k.side)"""
Q["calibration_report"] = pick(CALIBRATION, "report", same("prob_min", "prob_max", "hit_rate", "avg_gross_return", "median_gross_return", "avg_abs_return"), 5, "level, regime, side, prob_bin, count")
_ev = CALIBRATION + """, tab AS MATERIALIZED (SELECT row_number() OVER (ORDER BY prob_min, prob_max, side NULLS FIRST, regime NULLS FIRST) AS i, prob_min AS a, prob_max AS z, round(avg_gross_return, 9) AS ev, side, regime FROM report WHERE level IN (0, 3) AND avg_gross_return IS NOT NULL AND prob_max > prob_min),
ask AS MATERIALIZED (SELECT symbol, bar_idx, prob, regime, CASE WHEN signal > 0 THEN 'long' WHEN signal < 0 THEN 'short' ELSE 'flat' END AS side FROM sig),
pair AS MATERIALIZED (SELECT q.symbol, q.bar_idx, prob, t.*, CASE WHEN (t.side IS NULL OR t.side = q.side) AND (t.regime IS NULL OR t.regime = q.regime) THEN [1, 2, 3, 4] WHEN t.side IS NULL OR t.side = q.side THEN [2, 4] WHEN t.regime IS NULL OR t.regime = q.regime THEN [3, 4] ELSE [4] END AS tiers FROM ask q CROSS JOIN tab t),
leveled AS MATERIALIZED (SELECT symbol, bar_idx, prob, i, a, z, ev, unnest(tiers) AS tier FROM pair),
held AS (SELECT symbol, bar_idx, tier, avg(ev) AS ev FROM leveled WHERE prob BETWEEN a AND z GROUP BY 1, 2, 3),
h AS (SELECT symbol, bar_idx, arg_min(ev, tier) AS ev FROM held GROUP BY 1, 2),
near AS (SELECT symbol, bar_idx, arg_min(ev, (tier, abs((a + z) / 2 - prob), i)) AS ev FROM leveled GROUP BY 1, 2)"""
Q["ev_lookup"] = pick(_ev, "ask LEFT JOIN h USING (symbol, bar_idx) LEFT JOIN near USING (symbol, bar_idx)", {"ev": "coalesce(h.ev, near.ev)"}, 5)
Q["policy_gating"] = pick(SIGNALS, "sig", {"final_signal": "CASE WHEN signal = 1 AND regime = 'trend_up' AND prob >= 0.7 * 0.8 THEN 1 WHEN signal = -1 AND regime = 'trend_down' AND prob >= 0.7 * 0.8 THEN -1 ELSE 0 END"})
_cap = SIGNALS + """, f AS (SELECT symbol, bar_idx, CASE WHEN signal < 0 THEN -1 WHEN bar_idx % 4 = 0 THEN signal ELSE 0 END AS fs FROM sig),
c AS (SELECT *, count(*) FILTER (fs < 0) OVER (PARTITION BY symbol) AS sh, count(*) FILTER (fs <> 0) OVER (PARTITION BY symbol) AS tot, row_number() OVER (PARTITION BY symbol, fs < 0 ORDER BY md5(symbol || '|' || bar_idx || '|42')) AS k FROM f)"""
Q["short_ratio_cap"] = pick(_cap, "c", {"final_signal": "CASE WHEN fs < 0 AND k <= floor(round(sh - 0.7 * tot, 9)) THEN 0 ELSE fs END"})
_evd = SIGNALS + f", d AS (SELECT *, lead(close, 1) {over()} / nullif(close, 0) - 1 AS r, prob - 0.75 AS ev FROM sig), m AS (SELECT min(ev) AS e0, max(ev) AS e1 FROM d), n AS (SELECT *, CAST(least(greatest(ceil((ev - e0) / ((e1 - e0) / 10)) - 1, 0), 9) AS INTEGER) AS bin FROM d, m WHERE r IS NOT NULL)"
Q["ev_diagnostics"] = pick(_evd, "n", {"hit_rate": "avg(CAST(r > 0 AS INTEGER))", "avg_return": "avg(r)", "median_return": "quantile_cont(r, 0.5)", "correlation": "corr(ev, r)"}, 5, "bin, count(*) AS n", "GROUP BY GROUPING SETS ((), (bin))")
_desc = BARS + ", u AS (UNPIVOT (SELECT open, close, volume FROM b) ON open, close, volume INTO NAME column_ VALUE v)"
Q["describe_bars"] = pick(_desc, "u", {"mean": "avg(v)", "std": "stddev_samp(v)", "min": "min(v)", "p25": "quantile_cont(v, 0.25)", "p50": "quantile_cont(v, 0.5)", "p75": "quantile_cont(v, 0.75)", "max": "max(v)"}, 5, 'column_ AS "column", count(v) AS count', "GROUP BY column_")
_lr = f", lr AS (SELECT *, ln(nullif(close / nullif(lag(close) {over()}, 0), 0)) AS log_ret FROM b)"
Q["price_gaps"] = pick(DAILY + _lr + ", zz AS (SELECT *, (log_ret - avg(log_ret) OVER (PARTITION BY symbol)) / nullif(stddev_samp(log_ret) OVER (PARTITION BY symbol), 0) AS z FROM lr)", "zz", same("log_ret", "z"), 5, where="WHERE abs(z) > 3")
Q["volume_spikes"] = pick(BARS + f", v AS (SELECT *, {roll('avg', 'volume', 100, 20)} AS volume_mean FROM b)", "v", same("volume", "volume_mean"), 5, where="WHERE volume > 2 * volume_mean")
Q["gap_detect"] = f"WITH {BARS}, s AS (SELECT symbol, date_diff('second', lag(ts) {over()}, ts) AS step FROM b), m AS (SELECT symbol, quantile_cont(step, 0.5) AS median_step FROM s GROUP BY 1) SELECT symbol, CAST(first(median_step) AS DOUBLE) AS median_step, count(*) FILTER (step = 0) AS repeats, count(*) FILTER (step > 3 * median_step) AS gaps, count(*) FILTER (step > 10 * median_step) AS large_gaps, max(step) AS longest_step FROM s JOIN m USING (symbol) GROUP BY symbol"
_half = BARS + _lr + ", hf AS (SELECT *, CAST(bar_idx >= count(*) OVER (PARTITION BY symbol) // 2 AS INTEGER) AS half, count(*) OVER (PARTITION BY symbol) AS total FROM lr)"
Q["drift"] = pick(_half, "hf", {"mean": "avg(log_ret)", "vol": "stddev_samp(log_ret)", "skew": "skewness(log_ret)", "kurt": "kurtosis(log_ret)"}, 4, "symbol, half, count(log_ret) AS n", "GROUP BY symbol, half")
Q["recent_volatility"] = pick(_half, "hf", {"recent_vol_ratio": "stddev_samp(log_ret) FILTER (bar_idx >= total - 100) / nullif(stddev_samp(log_ret), 0)"}, 5, "symbol", "GROUP BY symbol")
_ks = _half + ", t AS (SELECT symbol, close, half, count(*) FILTER (half = 0) OVER (PARTITION BY symbol) AS n0, count(*) FILTER (half = 1) OVER (PARTITION BY symbol) AS n1, count(*) FILTER (half = 0) OVER (PARTITION BY symbol ORDER BY close) AS c0, count(*) FILTER (half = 1) OVER (PARTITION BY symbol ORDER BY close) AS c1 FROM hf)"
Q["ks_two_sample"] = pick(_ks, "t", {"d": "max(abs(c0 / n0 - c1 / n1))"}, 6, "symbol, n0, n1", "GROUP BY symbol, n0, n1")
_grid = BARS + f", f AS (SELECT *, {', '.join(f'lead(close, {h}) {over()} / nullif(close, 0) - 1 AS r{h}' for h in (6, 12))} FROM b), g AS (SELECT *, {', '.join(f'avg(r{h}) {over(s)} AS s{h}_{s}' for h in (6, 12) for s in (6, 12))} FROM f), o AS ({' UNION ALL '.join(f'SELECT symbol, {h} AS horizon, {s} AS smoothing, r{h} AS r, s{h}_{s} AS m FROM g' for h in (6, 12) for s in (6, 12))}), agg AS (SELECT symbol, horizon, smoothing, count(*) AS n, count(*) FILTER (m > 0.0005) AS n_long, count(*) FILTER (m < -0.0005) AS n_short, avg(r) AS mean_return FROM o GROUP BY 1, 2, 3)"
Q["grid_labels"] = pick(_grid, "agg", same("mean_return"), keys="symbol, horizon, smoothing, n, n_long, n_short")
_rank = _grid + ", k AS (SELECT *, row_number() OVER (PARTITION BY horizon, smoothing ORDER BY mean_return) - 1 AS i, count(*) OVER (PARTITION BY horizon, smoothing) AS c FROM agg)"
Q["grid_report"] = pick(_rank, "k", {"mean": "avg(mean_return)", "median": "quantile_cont(mean_return, 0.5)", "positive_share": "avg(CAST(mean_return > 0 AS INTEGER))", "worst": "min(mean_return)", "best": "max(mean_return)", "trimmed_mean": "avg(mean_return) FILTER (i >= floor(c * 0.05) AND i < floor(c * 0.95))"}, 6, "horizon, smoothing, count(mean_return) AS n", "GROUP BY horizon, smoothing")


def cross(a: str, b: str, up: bool = True) -> str:
    was, now = ("<=", ">") if up else (">=", "<")
    return f"coalesce(CAST(lag({a}) {over()} {was} lag({b}) {over()} AND {a} {now} {b} AS INTEGER), 0)"


_su = envelope((35, 15, 12), (30, 15, 12), (87, 348), 17, 43, "su")
_sm = f"""{BASE}, {_su}, e AS (SELECT x.symbol, x.ts, x.bar_idx, CASE WHEN volume <> 0 THEN close * volume / volume END AS hull, su.t, su.bo, CASE WHEN x.bar_idx >= 16 THEN a17 * 0.005 END AS dt, CASE WHEN x.bar_idx >= 42 THEN a43 * 0.005 END AS db FROM x JOIN su USING (symbol, bar_idx)),
f AS (SELECT *, {roll('avg', 't', 20)} AS tm, {roll('avg', 'bo', 18)} AS bm FROM e)"""
Q["module_superma"] = pick(_sm, "f", {"superma_hull": "hull", "superma_topvector01": "t", "superma_botvector01": "bo", "superma_topvecMA": "tm", "superma_botvecMA": "bm", "superma_decayt": "dt", "superma_decayb": "db", "superma_signal": f"CASE WHEN {cross('hull', 'bm', False)} = 1 THEN -1 WHEN {cross('hull', 'tm')} = 1 THEN 1 ELSE 0 END"}, 5)

_pv = envelope((35, 15, 12), (28, 9, 25), (87, 174), 17, 43, "pv")
_pm = f"""{BASE}, {_pv}, r AS (SELECT x.symbol, x.ts, x.bar_idx, open, close, CASE WHEN volume <> 0 THEN close * volume / volume END AS hull, pv.t, pv.bo, (close - ({roll('avg', 'close', 23)})) * 10000 AS res FROM x JOIN pv USING (symbol, bar_idx)),
v AS (SELECT *, CASE WHEN res > 520 AND close > open THEN 1 WHEN res < -520 AND close < open THEN -1 END AS ev, {roll('avg', 't', 20)} AS tm, {roll('avg', 'bo', 18)} AS bm FROM r),
c AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) {UPTO}, 0) AS sg, (tm + bm) / 2 AS va, {cross('hull', 'tm')} AS up, {cross('hull', 'bm', False)} AS dn FROM v),
d AS (SELECT *, coalesce(max(CASE WHEN up = 1 THEN bar_idx END) {UPTO}, 0) AS lu, coalesce(max(CASE WHEN dn = 1 THEN bar_idx END) {UPTO}, 0) AS ld, lag(sg) {over()} AS before FROM c),
g AS (SELECT *, coalesce(CAST(lu <= ld AND before IS DISTINCT FROM 1 AND sg = 1 AND hull > va AS INTEGER), 0) AS fl, coalesce(CAST(ld <= lu AND before IS DISTINCT FROM -1 AND sg = -1 AND hull < va AS INTEGER), 0) AS fs FROM d)"""
Q["module_pvt"] = pick(_pm, "g", {"pvt_nRes": "res", "pvt_sig_pvt": "sg", "pvt_hull": "hull", "pvt_topvector01": "t", "pvt_botvector01": "bo", "pvt_topvecMA": "tm", "pvt_botvecMA": "bm", "pvt_vecavg": "va", "pvt_finallongcond": "fl", "pvt_finalshortcond": "fs", "pvt_signal": "CASE WHEN fs = 1 THEN -1 WHEN fl = 1 THEN 1 ELSE 0 END"}, 5)

_start, _step = smooth({"e13": ("close", 2 / 14), "e21": ("close", 2 / 22)})
_start2, _step2 = smooth({"g": ("gain", 1 / 14), "l": ("loss", 1 / 14)})
_pr = f"""{BASE}, {recursion('e', 'x', _start, _step)}, d AS MATERIALIZED ({_later}), {recursion('q', 'd', _start2, _step2)},
m AS (SELECT x.symbol, x.ts, x.bar_idx, CASE WHEN x.bar_idx >= 20 THEN e13 - e21 END AS macd,
             (max(high) OVER dd + min(low) OVER dd + arg_max(close, x.ts) OVER dd) / 3 AS pv, CASE WHEN x.bar_idx >= 14 THEN CASE WHEN q.l = 0 AND q.g > 0 THEN 100 WHEN q.l = 0 THEN NULL ELSE 100 - 100 / (1 + q.g / q.l) END END AS rsi
      FROM x JOIN e USING (symbol, bar_idx) LEFT JOIN q ON q.symbol = x.symbol AND q.bar_idx = x.bar_idx - 1 WINDOW dd AS (PARTITION BY x.symbol, CAST(x.ts AS DATE))),
n AS (SELECT *, {roll('avg', 'macd', 8)} AS ms FROM m)"""
Q["module_pivots_rsi"] = pick(_pr, "n", {"pivots_rsi_macd": "macd", "pivots_rsi_macd_signal": "ms", "pivots_rsi_macd_hist": "macd - ms", "pivots_rsi_pivot": "pv", "pivots_rsi_rsi": "rsi", "pivots_rsi_rsi_overbought": "coalesce(CAST(rsi > 70 AS INTEGER), 0)", "pivots_rsi_rsi_oversold": "coalesce(CAST(rsi < 30 AS INTEGER), 0)"}, 5)

_om = f"""{_vm}, {_mem}, o AS (SELECT x.*, v.y, a.atr, count(*) FILTER (x.close = peak) {UPTO.replace('PARTITION BY symbol ORDER BY ts', 'PARTITION BY x.symbol ORDER BY x.ts')} AS island FROM x JOIN v USING (symbol, bar_idx) JOIN a USING (symbol, bar_idx))"""
_memory = {"ohlcv_mem_vol": "y", "ohlcv_mem_vol_resid": "ln(nullif(close, 0)) - y", "ohlcv_mem_vol_resid_norm": "(ln(nullif(close, 0)) - y) / nullif(atr / nullif(close, 0), 0)", "ohlcv_mem_vol_slope": f"y - lag(y) {over()}", "ohlcv_drawdown_depth": "drawdown", "ohlcv_drawdown_duration": "row_number() OVER (PARTITION BY symbol, island ORDER BY ts) - 1"}
Q["module_ohlcv"] = pick(_om, "o", _memory | {f"ohlcv_{k}": v for k, v in _micro.items()}, 5)

_t10 = _triple(10, (10, 6, 3))
_t8 = _triple(8, (8, 5, 3))
_tmv = envelope((18, 12, 12), (24, 12, 12), (87, 87), 10, 10, "tm")
_avg = recursion("av", "w", {"y": "(b.t + b.bo) / 2"}, {"y": f"p.y + {2 / 10!r} * ((b.t + b.bo) / 2 - p.y)"})
_tmm = f"""{BASE}, {_tmv}, {_t8[0]}, {_t10[0]}, w AS MATERIALIZED (SELECT symbol, bar_idx, t, bo FROM tm), {_avg},
h AS (SELECT b.symbol, b.ts, b.bar_idx, b.close, b.volume, tm.t, tm.bo, {_t8[2]} AS h8, {_t10[2]} AS h10, CASE WHEN b.bar_idx >= 8 THEN av.y END AS va
      FROM b JOIN tm ON tm.symbol = b.symbol AND tm.bar_idx = b.bar_idx JOIN av ON av.symbol = b.symbol AND av.bar_idx = b.bar_idx {_t8[1]} {_t10[1]}),
r AS (SELECT *, coalesce(h10 >= lag(h10) {over()}, FALSE) AS rising, {roll('min', 'close', 3)} AS lo3, {roll('max', 'close', 3)} AS hi3, {div(roll('sum', '(t + close) / 2 * volume', 9), roll('sum', 'volume', 9))} AS ta, {div(roll('sum', '(bo + close) / 2 * volume', 9), roll('sum', 'volume', 9))} AS ba FROM h),
u AS (SELECT *, coalesce(lag(rising) {over()}, FALSE) AS was, ta * (1 + 0.01 / 100) AS ts_, ba * (1 - 0.055 / 100) AS bs_ FROM r),
zz AS (SELECT *, last_value(CASE WHEN rising AND NOT was THEN lo3 WHEN NOT rising AND was THEN hi3 END IGNORE NULLS) {UPTO} AS zig FROM u),
k AS (SELECT *, {cross('zig', 'bs_', False)} AS lr, {cross('zig', 'ts_')} AS sr FROM zz),
s1 AS (SELECT *, sum(lr) {UPTO} AS nl, sum(sr) {UPTO} AS ns FROM k),
s2 AS (SELECT *, sum(CASE WHEN sr = 1 THEN 0 ELSE lr END) OVER (PARTITION BY symbol, ns ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sl, sum(sr) OVER (PARTITION BY symbol, nl ORDER BY ts ROWS UNBOUNDED PRECEDING) AS ss FROM s1),
s3 AS (SELECT *, CASE WHEN lr = 1 AND sl <= 1 THEN 1 ELSE 0 END AS lc, CASE WHEN sr = 1 AND ss <= 1 THEN 1 ELSE 0 END AS sc FROM s2)"""
Q["module_trendmagic"] = pick(_tmm, "s3", {f"trendmagic_{k}": v for k, v in {"zigzag": "zig", "topvector01": "t", "botvector01": "bo", "price": "close", "hls": "h8", "avg_vec": "va", "topavg": "ta", "botavg": "ba", "topsig": "ts_", "botsig": "bs_", "width": "(ts_ - bs_) / nullif((va + close) / 2, 0)", "long_raw": "lr", "short_raw": "sr", "sectionLongs": "sl", "sectionShorts": "ss", "longCondition": "lc", "shortCondition": "sc", "signal": "CASE WHEN sc = 1 THEN -1 WHEN lc = 1 THEN 1 ELSE 0 END"}.items()}, 5)

# Scoring, splits and summaries

_nov = (
    SIGNALS
    + f""", h AS MATERIALIZED (SELECT symbol, bar_idx, (lead(close + 1000, 12) {over()} / nullif(close + 1000, 0) - 1) * signal AS r, signal FROM sig),
w AS (SELECT symbol, bar_idx, 0 AS free, FALSE AS taken FROM h WHERE FALSE UNION ALL SELECT symbol, bar_idx, CASE WHEN signal <> 0 AND r IS NOT NULL THEN 12 ELSE 1 END, signal <> 0 AND r IS NOT NULL FROM h WHERE bar_idx = 0),
t AS (SELECT symbol, bar_idx, free, taken FROM w UNION ALL SELECT h.symbol, h.bar_idx, CASE WHEN h.signal <> 0 AND h.r IS NOT NULL THEN 12 ELSE 1 END, h.signal <> 0 AND h.r IS NOT NULL FROM t JOIN h ON h.symbol = t.symbol AND h.bar_idx = t.bar_idx + t.free),
tr AS MATERIALIZED (SELECT symbol, bar_idx, r AS g, r - 0.0011 AS p, count(*) OVER (PARTITION BY symbol) AS trades FROM t JOIN h USING (symbol, bar_idx) WHERE taken),
cu AS (SELECT *, product(1 + p) OVER (PARTITION BY symbol ORDER BY bar_idx) AS eq FROM tr),
dd AS (SELECT *, eq / max(eq) OVER (PARTITION BY symbol ORDER BY bar_idx) - 1 AS fall FROM cu),
isle AS (SELECT *, count(*) FILTER (fall >= 0) OVER (PARTITION BY symbol ORDER BY bar_idx) AS isle FROM dd),
runs AS (SELECT symbol, max(n) AS max_drawdown_duration, least(min(d), 0) AS max_drawdown FROM (SELECT symbol, isle, count(*) FILTER (fall < 0) AS n, min(fall) AS d FROM isle GROUP BY 1, 2) GROUP BY 1),
tot AS (SELECT symbol, count(*) AS bars FROM sig GROUP BY 1),
every AS (SELECT tr.*, bars, max_drawdown, max_drawdown_duration FROM tr JOIN runs USING (symbol) JOIN tot USING (symbol))"""
)
_win, _loss = "coalesce(sum(p) FILTER (p > 0), 0)", "-coalesce(sum(p) FILTER (p < 0), 0)"
_like = lambda c: f"coalesce(avg({c}) / nullif(stddev_samp({c}), 0), 0)"
_rate = "avg(CAST(p > 0 AS INTEGER))"
Q["nonoverlap_metrics"] = pick(
    _nov,
    "every",
    {
        "total_cost": "count(*) * 0.0011", "trade_rate": "count(*) / any_value(bars)", "turnover": "2.0 * count(*) / any_value(bars)", "cumulative_return": "product(1 + p) - 1", "gross_cumulative_return": "product(1 + g) - 1",
        "gross_mean_return": "avg(g)", "gross_volatility": "coalesce(stddev_samp(g), 0)", "gross_sharpe_like": _like("g"), "mean_return": "avg(p)", "volatility": "coalesce(stddev_samp(p), 0)", "sharpe_like": _like("p"), "win_rate": _rate,
        "cost_impact": "product(1 + g) - product(1 + p)", "avg_trade_return": "avg(p)", "profit_factor": f"CASE WHEN {_win} = 0 AND {_loss} = 0 THEN 0 ELSE {_win} / nullif({_loss}, 0) END",
        "expectancy": f"{_rate} * coalesce(avg(p) FILTER (p > 0), 0) + (1 - {_rate}) * coalesce(avg(p) FILTER (p < 0), 0)", "avg_win": "coalesce(avg(p) FILTER (p > 0), 0)", "avg_loss": "coalesce(avg(p) FILTER (p < 0), 0)",
        "gross_profit": _win, "gross_loss": _loss, "max_drawdown": "any_value(max_drawdown)",
    },
    5,
    "symbol, count(*) AS trade_count, any_value(max_drawdown_duration) AS max_drawdown_duration",
    "GROUP BY symbol",
)
Q["ev_details"] = pick(trade_log(), "log", {"prob": "prob", "ev": "prob - 0.75", "future_return": "future_return"}, keys="symbol, bar_idx, regime, CASE WHEN signal > 0 THEN 'long' ELSE 'short' END AS side", where="WHERE signal <> 0")
_entries = "count(*) FILTER (position <> 0 AND turn <> 0)"
Q["cost_sanity"] = pick(trade_log(), "log", {"total_cost": "sum(cost)", "avg_cost": f"sum(cost) / nullif({_entries}, 0)", "raw_total": "sum(pnl_raw)", "net_total": "sum(pnl)"}, 5, f"symbol, {_entries} AS entries, count(*) FILTER (position <> 0) AS trade_bars", "GROUP BY symbol")
Q["agreement_gating"] = pick(SIGNALS, "sig", {"final_signal": "CASE WHEN prob - 0.7 < 0.02 THEN 0 WHEN signal = 1 AND regime = 'trend_up' AND prob >= 0.6 * 0.8 THEN 1 WHEN signal = -1 AND regime = 'trend_down' AND prob >= 0.6 * 0.8 AND close < open AND prob / 2 >= 0.25 THEN -1 ELSE 0 END"})
Q["ev_summary"] = pick(SIGNALS + ", e AS (SELECT *, CASE WHEN prob > 0.6 THEN prob - 0.75 END AS ev FROM sig)", "e", {"mean_ev": "avg(ev)", "median_ev": "quantile_cont(ev, 0.5)"}, keys="count(ev) AS n, count(*) FILTER (ev > 0) AS n_positive, count(*) FILTER (signal <> 0) AS n_signals")
Q["probability_histogram"] = f"WITH {SIGNALS}, k AS (SELECT CASE " + " ".join(f"WHEN prob >= {a} AND prob < {c} THEN {i}" for i, (a, c) in enumerate(zip((0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95), (0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.01), strict=True))) + " END AS bin FROM sig) SELECT bin, count(*) AS count FROM k WHERE bin IS NOT NULL GROUP BY bin"
_bounded = "least(greatest(prob, 1e-6), 1 - 1e-6)"
Q["sharpened"] = pick(SIGNALS + f", q AS (SELECT *, pow({_bounded}, 2) AS a, pow(least(greatest(1 - prob, 1e-6), 1 - 1e-6), 2) AS c FROM sig)", "q", {"p_0": "a / (a + c)", "p_1": "c / (a + c)"})
Q["signal_confusion"] = f"WITH {SIGNALS} SELECT CAST(signal AS VARCHAR) AS label, " + ", ".join(f'count(*) FILTER (coalesce(sign(close - open), 0) = {k}) AS "{k}"' for k in (-1, 0, 1)) + " FROM sig GROUP BY 1"
Q["regime_counts"] = f"WITH {SIGNALS} SELECT regime, count(*) AS count FROM sig GROUP BY regime"
Q["stratified_split"] = f"WITH {SIGNALS}, k AS (SELECT symbol, bar_idx, row_number() OVER (PARTITION BY regime ORDER BY md5(symbol || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '|42')) AS k, count(*) OVER (PARTITION BY regime) AS n FROM sig) SELECT symbol, bar_idx, k <= floor(n * 0.2) AS held_out FROM k"
_choices = ", ".join(f"({k}, {a}, {c})" for k, (a, c) in enumerate((a, c) for a in range(6) for c in range(a + 1, 6)))
Q["combinatorial_folds"] = f"""WITH {BARS}, z AS (SELECT *, count(*) OVER (PARTITION BY symbol) // 6 AS size FROM b),
c AS (SELECT * FROM (VALUES {_choices}) AS v(choice, f0, f1)),
p AS (SELECT symbol, choice, bar_idx, least(bar_idx // size, 5) AS fold, f0, f1, CASE WHEN f0 * size > 12 THEN f0 * size - 12 ELSE f0 * size END AS stop FROM z, c),
q AS (SELECT *, CASE WHEN fold = f0 OR fold = f1 THEN 'test' WHEN bar_idx < stop THEN 'train' END AS part FROM p WHERE stop > 0)
SELECT symbol, choice, part, count(*) AS n, min(bar_idx) AS first_idx, max(bar_idx) AS last_idx FROM q WHERE part IS NOT NULL GROUP BY ALL"""
_periods = BARS + """, y AS (SELECT *, CAST(ts >= TIMESTAMP '2024-01-16' AS INTEGER) AS period FROM b),
lr AS (SELECT *, ln(nullif(close / nullif(lag(close) OVER (PARTITION BY symbol, period ORDER BY ts), 0), 0)) AS log_ret FROM y),
u AS (SELECT symbol, period, log_ret, count(*) FILTER (period = 0) OVER (PARTITION BY symbol) AS n0, count(*) FILTER (period = 1) OVER (PARTITION BY symbol) AS n1, count(*) FILTER (period = 0) OVER (PARTITION BY symbol ORDER BY log_ret) AS c0, count(*) FILTER (period = 1) OVER (PARTITION BY symbol ORDER BY log_ret) AS c1 FROM lr WHERE log_ret IS NOT NULL)"""
Q["period_comparison"] = pick(_periods, "u", {"d": "max(abs(c0 / nullif(n0, 0) - c1 / nullif(n1, 0)))"} | {f"{s}_{k}": f"{f}(log_ret) FILTER (period = {k})" for s, f in (("mean", "avg"), ("vol", "stddev_samp")) for k in (0, 1)}, 5, "symbol, n0, n1", "GROUP BY symbol, n0, n1")
_rs = {}
for _c in ("open", "volume"):
    for _n in (5, 20):
        _rs |= {f"{_c}_mean_{_n}": roll("avg", _c, _n, 1), f"{_c}_std_{_n}": roll("stddev_samp", _c, _n, 1), f"{_c}_max_{_n}": roll("max", _c, _n, 1), f"{_c}_min_{_n}": roll("min", _c, _n, 1), f"{_c}_slope_{_n}": slope(_c, _n), f"{_c}_zscore_{_n}": z(_c, _n, 1)}
Q["rolling_stats"] = pick(BARS, "b", _rs, 5)
Q["array_drawdown"] = pick(BASE, "x", {"worst": "min(drawdown)"}, keys="symbol", where="GROUP BY symbol")
_start, _step = smooth({f"atr_{n}": ("tr", 1 / n) for n in (7, 14, 21)})
Q["atr_share"] = pick(f"{BASE}, {recursion('e', 'x', _start, _step)}", "e JOIN b USING (symbol, bar_idx)", {f"atr_pct_{n}": f"CASE WHEN bar_idx >= {n - 1} THEN atr_{n} / nullif(close, 0) END" for n in (7, 14, 21)})
_prices = ("open", "high", "low", "close")
_some = lambda x: f"CAST(count(*) FILTER ({x}) > 0 AS INTEGER)"
_errors = " + ".join([_some("NOT (high >= low AND high >= open AND high >= close AND low <= open AND low <= close AND volume >= 0)"), _some("step = 0"), *(_some(f"{c} IS NULL OR isnan({c}) OR isinf({c})") if w else _some(f"{c} < 0") for c in _prices for w in (1, 0))])
_warnings = " + ".join([_some("step > 3 * median_step"), _some("step > 10 * median_step"), _some("volume = 0"), *(_some(f"{c} = 0") for c in _prices)])
_qual = f"""{BARS}{_lr}, st AS (SELECT *, date_diff('second', lag(ts) {over()}, ts) AS step, (log_ret - avg(log_ret) OVER (PARTITION BY symbol)) / nullif(stddev_samp(log_ret) OVER (PARTITION BY symbol), 0) AS zs FROM lr),
md AS (SELECT symbol, quantile_cont(step, 0.5) AS median_step FROM st GROUP BY 1),
ct AS (SELECT symbol, {_errors} AS errors, {_warnings} AS warnings, count(*) FILTER (abs(zs) > 5) / count(*) AS outlier_rate FROM st JOIN md USING (symbol) GROUP BY symbol)"""
Q["quality_score"] = pick(_qual, "ct", {"errors": "errors", "warnings": "warnings", "outlier_rate": "outlier_rate", "score": "greatest(0, 100 - 10 * errors - 2 * warnings - least(1000 * outlier_rate, 20))"}, keys="symbol")
