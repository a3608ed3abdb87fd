"""Column helpers.  NULL is the only missing value; ratios never raise."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def no_nan(col: Column) -> Column:
    """NaN as NULL."""
    return F.when(F.isnan(col), F.lit(None)).otherwise(col)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ordered(keys: list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def trapezoid(y: Column, t: Column, w: WindowSpec) -> Column:
    """Area of the strip between the row before and this one; NULL on the first row."""
    return (y + F.lag(y).over(w)) / 2 * (t - F.lag(t).over(w))


def running(col: Column, w: WindowSpec) -> Column:
    return F.sum(col).over(w.rowsBetween(Window.unboundedPreceding, 0))


def median_of(col: Column, w: WindowSpec, before: int, after: int) -> Column:
    """Exact median of a row frame, NULLs skipped."""
    return F.percentile(col, F.lit(0.5)).over(w.rowsBetween(before, after))


def r6(col: Column) -> Column:
    """To 6 digits; shifted, so that a value right between two digits goes the same way whatever the order of summation."""
    return F.round(col + 1e-9, 6)
