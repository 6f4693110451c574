"""Row-frame helpers over one keyed series.

The series handed to these helpers are *gridded*: at most one row per key and
time slot, so a window partition is bounded by (time span / slot) whatever the
volume of the raw feed.  Raw feeds are first reduced with a partially
aggregated ``groupBy``; scans over raw rows use ``operators.ranked`` instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def series(keys: str | list[str], order: str | list[str] = "t") -> WindowSpec:
    keys = [keys] if isinstance(keys, str) else keys
    order = [order] if isinstance(order, str) else order
    return W.partitionBy(*keys).orderBy(*order)


def lagged(col: Column | str, rows: int, w: WindowSpec) -> Column:
    return F.lag(col, rows).over(w)


def led(col: Column | str, rows: int, w: WindowSpec) -> Column:
    return F.lead(col, rows).over(w)


def rolling(
    fn: Callable[[Column], Column],
    col: Column | str,
    w: WindowSpec,
    rows: int,
    shift: int = 0,
    min_periods: int | None = None,
) -> Column:
    """``fn`` over the ``rows`` rows ending ``shift`` rows back; NULL below ``min_periods`` values."""
    c = F.col(col) if isinstance(col, str) else col
    frame = w.rowsBetween(-(rows - 1) - shift, -shift)
    need = rows if min_periods is None else min_periods
    value = fn(c).over(frame)
    if need <= 1:
        return value
    return F.when(F.count(c).over(frame) >= need, value)


def _frame_total(c: Column, w: WindowSpec, rows: int) -> Column:
    """Sum over the last ``rows`` rows as a difference of two running sums: linear, not rows x frame."""
    upto = F.sum(c).over(w.rowsBetween(W.unboundedPreceding, 0))
    before = F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -rows))
    return F.coalesce(upto, F.lit(0)) - F.coalesce(before, F.lit(0))


def _levelled(col: str, w: WindowSpec) -> tuple[Column, Column]:
    """(values less the mean of their series, that mean). Running sums of the differences keep their digits whatever the level of the series.
    NaN counts as missing, so it does not stay in the sums of later rows."""
    c = F.when(~F.isnan(col), F.col(col).cast("double"))
    level = F.avg(c).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return c - level, level


def long_mean(col: str, w: WindowSpec, rows: int, min_periods: int) -> Column:
    """Mean of a long frame (thousands of rows) by running sums."""
    c, level = _levelled(col, w)
    n = _frame_total(c.isNotNull().cast("long"), w, rows)
    return F.when(n >= min_periods, level + F.try_divide(_frame_total(c, w, rows), n))


def long_std(col: str, w: WindowSpec, rows: int, min_periods: int) -> Column:
    """Sample deviation of a long frame."""
    c, _ = _levelled(col, w)
    n = _frame_total(c.isNotNull().cast("long"), w, rows)
    s, q = _frame_total(c, w, rows), _frame_total(c * c, w, rows)
    var = F.try_divide(q - F.try_divide(s * s, n), n - 1)
    return F.when((n >= min_periods) & (n > 1), F.sqrt(F.greatest(var, F.lit(0.0))))


def quantile(p: float) -> Callable[[Column], Column]:
    return lambda c: F.percentile(c, p)


def sample_skew(c: Column, frame: WindowSpec) -> Column:
    """Bias-corrected skewness; NULL under three values or at zero spread."""
    n = F.count(c).over(frame).cast("double")
    pop = F.skewness(c).over(frame)
    fixed = pop * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when((n >= 3) & (F.stddev_pop(c).over(frame) > 0), fixed)


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def clamp(c: Column, low: float | Column, high: float | Column) -> Column:
    low = F.lit(low) if not isinstance(low, Column) else low
    high = F.lit(high) if not isinstance(high, Column) else high
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def exact_sum(c: Column) -> Column:
    """Decimal sum of values with up to six decimals: the same bits whatever the partitioning or merge order."""
    return F.sum(c.cast("decimal(18,6)")).cast("double")


def exact_mean(c: Column) -> Column:
    return exact_sum(c) / F.count(c)
