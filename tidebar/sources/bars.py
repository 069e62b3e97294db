"""Bar tables: reading, cleaning, validating, resampling, deriving."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import KEY, TIME, finite, series

PRICES = ("open", "high", "low", "close")
COLUMNS = (*PRICES, "volume")
#: Header spellings read as the bar columns.
HEADERS = {"time": "ts", "date": "ts", "datetime": "ts", "timestamp": "ts", "ts": "ts", "o": "open", "h": "high", "l": "low", "c": "close", "vol": "volume", **{c: c for c in COLUMNS}}


def normalise_headers(df: DataFrame) -> DataFrame:
    """Columns named by HEADERS, whatever their case; of two that read alike the first stays."""
    chosen: dict[str, str] = {}
    for c in df.columns:
        chosen.setdefault(HEADERS.get(c.strip().lower(), c.strip().lower()), c)
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in chosen.items()))


def typed(df: DataFrame) -> DataFrame:
    """Unreadable times and prices are dropped, as rows; not-a-number counts as unreadable."""
    missing = [c for c in (TIME, *COLUMNS) if c not in df.columns]
    if missing:
        raise ValueError(f"bars lack columns: {', '.join(missing)}")
    time = F.col(TIME) if dict(df.dtypes)[TIME].startswith("timestamp") else F.expr("try_cast(ts as timestamp_ntz)")
    cast = df.withColumns({TIME: time.cast("timestamp_ntz"), **{c: finite(F.expr(f"try_cast({c} as double)")) for c in COLUMNS}})
    return cast.dropna(subset=[TIME, *COLUMNS])


def sane() -> Column:
    """The bar's own order of prices; a null doesn't count as sane."""
    h, l, o, c = (F.col(x) for x in ("high", "low", "open", "close"))
    return F.coalesce((h >= l) & (h >= o) & (h >= c) & (l <= o) & (l <= c) & (F.col("volume") >= 0), F.lit(False))


def read_csv(spark: SparkSession, path: str | Sequence[str], symbol: str = "default", start: datetime | None = None, end: datetime | None = None, check: bool = True, float32: bool = False) -> DataFrame:
    """Bars of CSV files with a header. Both ends of the range are included."""
    raw = normalise_headers(spark.read.option("header", True).csv(path))  # type: ignore[arg-type]
    bars = typed(raw if KEY in raw.columns else raw.withColumn(KEY, F.lit(symbol)))
    if check:
        bars = bars.where(sane())
    if start is not None:
        bars = bars.where(F.col(TIME) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        bars = bars.where(F.col(TIME) <= F.lit(end).cast("timestamp_ntz"))
    bars = bars.select(KEY, TIME, *(F.col(c).cast("float") if float32 else F.col(c) for c in COLUMNS))
    return bars


def first_readable(spark: SparkSession, paths: Sequence[str], **options: object) -> DataFrame:
    """Bars of the first path that exists."""
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = p.getFileSystem(conf).globStatus(p)
        if found is not None and len(found):
            return read_csv(spark, path, **options)  # type: ignore[arg-type]
    raise FileNotFoundError(f"none of: {', '.join(paths)}")


def validate(bars: DataFrame) -> None:
    """Raises if a bar is out of order within itself, has a null, or repeats a time."""
    counts = bars.agg(F.count("*").alias("rows"), F.count_if(~sane()).alias("insane"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in (TIME, *COLUMNS))).first().asDict()
    repeats = bars.groupBy(KEY, TIME).count().where("count > 1").count()
    wrong = {k: v for k, v in counts.items() if k != "rows" and v} | ({"repeated_times": repeats} if repeats else {})
    if not counts["rows"]:
        raise ValueError("no bars")
    if wrong:
        raise ValueError(f"bars fail validation: {wrong}")


def first_of_each_time(bars: DataFrame, order: str | Column) -> DataFrame:
    """One bar for each symbol and time: the first by ``order``."""
    rank = F.row_number().over(Window.partitionBy(KEY, TIME).orderBy(order))
    return bars.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def resample(bars: DataFrame, every: str = "5 minutes") -> DataFrame:
    """Bars of a longer step, closed and labelled on the left; steps without bars give none."""
    whole = F.col("open").isNotNull() & F.col("close").isNotNull()
    grouped = bars.groupBy(KEY, F.window(TIME, every).start.alias(TIME)).agg(
        F.min_by("open", F.when(F.col("open").isNotNull(), F.col(TIME))).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col(TIME))).alias("close"), F.sum("volume").alias("volume"),
    )
    return grouped.where(whole)


def numbered(bars: DataFrame) -> DataFrame:
    """With bar_idx long: the bar's position in its series, from 0."""
    return bars.withColumn("bar_idx", (F.row_number().over(series()) - 1).cast("long"))


def ticks_to_bars(ticks: DataFrame, symbol: str, time: str, value: str, order: str, every: str = "1 hour") -> DataFrame:
    """Bars of single values; ``order`` breaks ties of time and decides first and last."""
    rows = ticks.where(F.col(symbol).isNotNull() & F.col(time).isNotNull() & F.col(value).isNotNull())
    step = F.window(time, every).start
    bars = rows.groupBy(F.col(symbol).alias(KEY), step.alias(TIME)).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.sum(value).alias("volume")
    )
    return numbered(bars)


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a series for each event type, a bar for each hour."""
    return ticks_to_bars(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "value", "ts")


def daily_order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: a series for each priority, a bar for each day; keys order the day."""
    return ticks_to_bars(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey", "1 day")


def union_of(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def between(bars: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """start <= time < end."""
    return bars.where((F.col(TIME) >= F.lit(start).cast("timestamp_ntz")) & (F.col(TIME) < F.lit(end).cast("timestamp_ntz")))


def recent_months(bars: DataFrame, months: int) -> DataFrame:
    """Each series' bars of its last ``months`` months."""
    last = F.max(TIME).over(Window.partitionBy(KEY))
    return bars.withColumn("__last", last).where(F.col(TIME) >= F.col("__last") - F.make_interval(months=F.lit(months))).drop("__last")


def tail(bars: DataFrame, n: int) -> DataFrame:
    """Each series' last ``n`` bars."""
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(TIME)))
    return bars.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def unmatched(a: DataFrame, b: DataFrame) -> int:
    """Keys that only one of two tables holds."""
    keys = [KEY, TIME]
    both = a.select(*keys, F.lit(1).alias("in_a")).join(b.select(*keys, F.lit(1).alias("in_b")), keys, "full")
    return both.where("in_a is null or in_b is null").count()


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """(prob_min, prob_max, ev, side, regime) for ``gating.expected_value``: rows
    without edges or value, or with empty bins, are dropped; a missing side or
    regime matches any."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.select(*(F.col(f"`{c}`").alias(c.strip().lower()) for c in raw.columns))
    ev = next((c for c in ("ev", "avg_gross_return", "median_gross_return") if c in raw.columns), None)
    if ev is None or not {"prob_min", "prob_max"} <= set(raw.columns):
        raise ValueError("calibration needs prob_min, prob_max and a value")
    side = next((c for c in ("side", "side_str") if c in raw.columns), None)
    text = lambda c: F.lower(F.trim(F.col(c))) if c else F.lit(None).cast("string")
    rows = raw.select(*(F.expr(f"try_cast({c} as double)").alias(n) for c, n in (("prob_min", "prob_min"), ("prob_max", "prob_max"), (ev, "ev"))), text(side).alias("side"), text("regime" if "regime" in raw.columns else None).alias("regime"))
    return rows.where("prob_min is not null and prob_max > prob_min and ev is not null")
