"""Window primitives over a panel: rows of one entity in time order.

Frames count rows; `min_periods` counts values that aren't null. Division by zero gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Ent = Sequence[str]


def order(ent: Ent, t: str) -> WindowSpec:
    return Window.partitionBy(*ent).orderBy(t)


def last_rows(n: int, ent: Ent, t: str) -> WindowSpec:
    return order(ent, t).rowsBetween(-(n - 1), 0)


def so_far(ent: Ent, t: str) -> WindowSpec:
    return order(ent, t).rowsBetween(Window.unboundedPreceding, 0)


def from_here(ent: Ent, t: str) -> WindowSpec:
    """This row and all later ones, the last first: a frame that grows row by row and is never summed anew.

    The nearest row is the frame's last.
    """
    return Window.partitionBy(*ent).orderBy(F.desc(t)).rowsBetween(Window.unboundedPreceding, 0)


def whole(ent: Ent) -> WindowSpec:
    return Window.partitionBy(*ent)


def next_rows(h: int, ent: Ent, t: str) -> WindowSpec:
    return order(ent, t).rowsBetween(0, h)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct_change(c: str | Column, k: int, ent: Ent, t: str) -> Column:
    return F.try_divide(col(c), F.lag(c, k).over(order(ent, t))) - 1


def diff(c: str | Column, k: int, ent: Ent, t: str) -> Column:
    return col(c) - F.lag(c, k).over(order(ent, t))


def rolling(agg: Callable[[Column], Column], c: str | Column, n: int, ent: Ent, t: str, min_periods: int | None = None) -> Column:
    """`agg` over the last n rows, null below `min_periods` (default n) values.

    Spark sums each row's frame anew: for short windows. functions/rolling.py has those of any length.
    """
    w = last_rows(n, ent, t)
    return F.when(F.count(col(c)).over(w) >= (n if min_periods is None else min_periods), agg(col(c)).over(w))


def expanding_z(c: str | Column, ent: Ent, t: str, min_periods: int = 252) -> Column:
    """Distance from the mean so far in sample standard deviations so far, this row included."""
    w = so_far(ent, t)
    z = F.try_divide(col(c) - F.avg(col(c)).over(w), F.nullif(F.stddev_samp(col(c)).over(w), F.lit(0.0)))
    return F.when(F.count(col(c)).over(w) >= min_periods, z)


def row_position(ent: Ent, t: str) -> Column:
    return F.row_number().over(order(ent, t)) - 1


def log_returns(df: DataFrame, px: str, ent: Ent, t: str, out: str = "log_return") -> DataFrame:
    """ln(p / previous p); an entity's first row is dropped."""
    ratio = F.try_divide(F.col(px), F.lag(px).over(order(ent, t)))
    return df.withColumn("_n", F.row_number().over(order(ent, t))).withColumn(out, F.ln(ratio)).filter("_n > 1").drop("_n")


def annualised_vol_pct(c: str, ent: Ent, t: str, window: int = 20) -> Column:
    return rolling(F.stddev_samp, c, window, ent, t) * (252**0.5 * 100)


def drawdown_from_ath(px: str, ent: Ent, t: str) -> Column:
    peak = F.max(px).over(so_far(ent, t))
    return F.try_divide(F.col(px) - peak, peak) * 100


def roc_columns(df: DataFrame, c: str, ent: Ent, t: str, periods: Sequence[int] = (1, 5, 20)) -> DataFrame:
    return df.withColumns({f"{c}_roc_{k}": pct_change(c, k, ent, t) * 100 for k in periods})
