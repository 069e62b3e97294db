"""Column expressions over one series per symbol, in time order.

Rolling functions take an expression without window functions in it (Spark
doesn't nest them): lags are columns of an earlier projection. ``n``-row
functions are null until the window holds ``need`` non-null values (default n),
and every division by zero is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY, TIME = "symbol", "ts"


def series() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(TIME)


def rows(n: int) -> WindowSpec:
    return series().rowsBetween(-(n - 1), 0)


def so_far() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, 0)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column | str, b: Column | str) -> Column:
    return col(a) / F.nullif(col(b), F.lit(0.0))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds a value; a null stays null."""
    y = x if low is None else F.greatest(x, F.lit(low))
    y = y if high is None else F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def lag(x: Column | str, k: int = 1) -> Column:
    return F.lag(col(x), k).over(series())


def lead(x: Column | str, k: int = 1) -> Column:
    return F.lead(col(x), k).over(series())


def _rolling(f, x: Column | str, n: int, need: int | None) -> Column:
    need = n if need is None else need
    value = f(col(x)).over(rows(n))
    return value if need <= 1 else F.when(F.count(col(x)).over(rows(n)) >= need, value)


class Shared:
    """Window aggregates that several columns use: each is named and computed once,
    in a projection of its own; the columns are arithmetic over them."""

    def __init__(self) -> None:
        self.made: dict[str, Column] = {}

    def over(self, name: str, aggregate: Column, n: int) -> Column:
        self.made.setdefault(f"__{name}_{n}", aggregate.over(rows(n)))
        return F.col(f"__{name}_{n}")

    def full(self, f, name: str, x: Column | str, n: int) -> Column:
        """``f`` of x, null until the window holds n values. ``name`` stands for x."""
        return F.when(self.over(f"n_{name}", F.count(col(x)), n) >= n, self.over(f"{f.__name__}_{name}", f(col(x)), n))

    def add(self, df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        return df.withColumns(self.made).withColumns(columns).drop(*self.made)


def mean(x, n: int, need: int | None = None) -> Column:
    return _rolling(F.avg, x, n, need)


def total(x, n: int, need: int | None = None) -> Column:
    return _rolling(F.sum, x, n, need)


def highest(x, n: int, need: int | None = None) -> Column:
    return _rolling(F.max, x, n, need)


def lowest(x, n: int, need: int | None = None) -> Column:
    return _rolling(F.min, x, n, need)


def deviation(x, n: int, need: int | None = None) -> Column:
    return _rolling(F.stddev_samp, x, n, need)


def variance(x, n: int, need: int | None = None) -> Column:
    return _rolling(F.var_samp, x, n, need)


def weighted_mean(x, weight, n: int) -> Column:
    """Volume-weighted mean; null where the weights sum to 0."""
    return ratio(total(col(x) * col(weight), n), total(weight, n))


def zscore(x, n: int, need: int | None = None) -> Column:
    return ratio(col(x) - mean(x, n, need), deviation(x, n, need))


def slope(x, n: int, position: str = "bar_idx") -> Column:
    """Least-squares slope against the row's position, from one row on."""
    return ratio(F.covar_samp(F.col(position).cast("double"), col(x)).over(rows(n)), F.var_samp(F.when(col(x).isNotNull(), F.col(position).cast("double"))).over(rows(n)))


def rolling_skewness(x, n: int) -> Column:
    """Bias-corrected, as a sample statistic."""
    k = F.count(col(x)).over(rows(n))
    return F.when(k >= F.lit(n), F.skewness(col(x)).over(rows(n)) * F.sqrt(k * (k - 1.0)) / (k - 2.0))


def rolling_kurtosis(x, n: int) -> Column:
    """Bias-corrected excess."""
    k = F.count(col(x)).over(rows(n))
    return F.when(k >= F.lit(n), (k - 1.0) / ((k - 2.0) * (k - 3.0)) * ((k + 1.0) * F.kurtosis(col(x)).over(rows(n)) + 6.0))


def correlation(a: str, b: str, window: WindowSpec | None = None) -> Column:
    """Pearson's, null where either side is constant (Spark's own divides by zero there)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    c, s, t = parts if window is None else [p.over(window) for p in parts]
    return ratio(c, s * t)


def crosses_over(a: str, b: str) -> Column:
    return flag((lag(a) <= lag(b)) & (F.col(a) > F.col(b)))


def crosses_under(a: str, b: str) -> Column:
    return flag((lag(a) >= lag(b)) & (F.col(a) < F.col(b)))


def carried(x: Column | str) -> Column:
    """The last value that isn't null."""
    return F.last(col(x), ignorenulls=True).over(so_far())


def backfilled(x: Column | str) -> Column:
    return F.first(col(x), ignorenulls=True).over(series().rowsBetween(0, Window.unboundedFollowing))


def true_range(high: str = "high", low: str = "low", previous: str = "close_1") -> Column:
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - F.col(previous)), F.abs(F.col(low) - F.col(previous)))


def finite(x: Column | str) -> Column:
    """Infinite and not-a-number values become null."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
