"""Column helpers over dated series. keys: the columns that tell series apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def dated(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("date")


def trailing(keys: Sequence[str], n: int) -> WindowSpec:
    return dated(keys).rowsBetween(1 - n, 0)


def so_far(keys: Sequence[str]) -> WindowSpec:
    return dated(keys).rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, x: Column, keys: Sequence[str], n: int) -> Column:
    """value where n rows of x are in the frame, else null: frames shrink at the start of a series."""
    return F.when(F.count(x).over(trailing(keys, n)) == n, value)


def rolling_std(x: Column, keys: Sequence[str], n: int) -> Column:
    return full(F.stddev_samp(x).over(trailing(keys, n)), x, keys, n)


def rolling_mean(x: Column, keys: Sequence[str], n: int) -> Column:
    return full(F.avg(x).over(trailing(keys, n)), x, keys, n)


def wealth(r: Column, keys: Sequence[str]) -> Column:
    return F.product(1 + r).over(so_far(keys))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.when(b != 0, a / b)


def period(freq: str, date: Column | str = "date") -> Column:
    """The first day of the period that a date is in: weeks are ISO weeks, from Monday.

    Days are truncated as days: timestamps would go through the time zone row by row.
    """
    day = (F.col(date) if isinstance(date, str) else date).cast("date")
    return day if freq == "daily" else F.trunc(day, {"weekly": "WEEK", "monthly": "MONTH", "quarterly": "QUARTER", "yearly": "YEAR"}[freq])
