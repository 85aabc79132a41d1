"""Leave-one-out values of a series' metrics in one scan: what a metric is without each of its dates.

Drawdown: a stretch of dates is summed up by four numbers that merge (see Stretch), so a series without one date is what lies before
merged with what lies after. Rows are cut into blocks by the calendar. A block is summed up on its own, the blocks' sums are merged from
both ends, and each block then gives the values of its dates: the work is linear in the dates, whatever their number.
Sharpe ratio: the mean and the sum of squares without a date follow from those of all in closed form.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days of a block: a task's group holds no more dates than that.
BLOCK_DAYS = 4096


class Stretch(NamedTuple):
    """Consecutive dates: the growth over all of them, the highest and the lowest wealth among them (1 before the first), and
    the least ratio of a wealth to an earlier or equal one."""

    growth: float
    high: float
    low: float
    fall: float

    def then(self, other: Stretch) -> Stretch:
        if self.high == -np.inf:
            return other
        if other.high == -np.inf:
            return self
        across = self.growth * other.low / self.high if self.high > 0 else 1.0
        return Stretch(self.growth * other.growth, max(self.high, self.growth * other.high), min(self.low, self.growth * other.low), min(self.fall, other.fall, across))


NO_DATES = Stretch(1.0, -np.inf, np.inf, 1.0)
_STATE = "growth double, high double, low double, fall double"


def _stretches(r: np.ndarray) -> list[Stretch]:
    return [Stretch(1 + x, 1 + x, 1 + x, 1.0) for x in r.tolist()]


def _before(parts: Sequence[Stretch], start: Stretch = NO_DATES) -> list[Stretch]:
    """Of each part, all before it merged."""
    out = [start]
    for part in parts[:-1]:
        out.append(out[-1].then(part))
    return out


def _after(parts: Sequence[Stretch], end: Stretch = NO_DATES) -> list[Stretch]:
    """Of each part, all after it merged."""
    out = [end]
    for part in parts[:0:-1]:
        out.append(part.then(out[-1]))
    return out[::-1]


def _types(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def falls_without_each(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, date, value: the worst drawdown of each series (keys, date, r) without that date; null where it is the only one."""
    if not keys:
        return falls_without_each(series.withColumn("__all", F.lit(0)), ["__all"]).drop("__all")
    of = list(keys)
    types = _types(series, of)
    rows = series.select(*of, "date", "r", F.floor(F.unix_date(F.col("date").cast("date")) / BLOCK_DAYS).alias("block"))

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = NO_DATES
        for one in _stretches(pdf.sort_values("date")["r"].to_numpy(float)):
            whole = whole.then(one)
        return pdf.iloc[:1][[*of, "block"]].assign(**whole._asdict())

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        parts = [Stretch(*x) for x in pdf[list(Stretch._fields)].itertuples(index=False)]
        out = pdf[[*of, "block"]].copy()
        for side, found in (("a", _before(parts)), ("z", _after(parts))):
            for name in Stretch._fields:
                out[f"{side}_{name}"] = [getattr(x, name) for x in found]
        return out

    def without(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        parts = _stretches(pdf["r"].to_numpy(float))
        start, end = (Stretch(*(pdf[f"{side}_{n}"].iloc[0] for n in Stretch._fields)) for side in "az")
        rest = [a.then(z) for a, z in zip(_before(parts, start), _after(parts, end), strict=True)]
        return pdf[[*of, "date"]].assign(value=[x.fall - 1 if x.high > -np.inf else None for x in rest])

    sides = ", ".join(f"{side}_{n} double" for side in "az" for n in Stretch._fields)
    blocks = rows.groupBy(*of, "block").applyInPandas(summed, f"{types}block long, {_STATE}")
    # a row a block: over ten years of dates each
    merged = blocks.groupBy(*of).applyInPandas(carried, f"{types}block long, {sides}")
    kind = series.schema["date"].dataType.simpleString()
    return rows.join(merged, [*of, "block"]).groupBy(*of, "block").applyInPandas(without, f"{types}date {kind}, value double")


def sharpe_without_each(rf: float, days: int) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    """Of series (keys, date, r): keys, date, value, the annual Sharpe ratio over a constant rate without that date."""

    def ratios(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        whole = series.groupBy(*keys).agg(F.count("r").cast("double").alias("__n"), F.avg("r").alias("__mean"), F.var_samp("r").alias("__var"))
        rows = series.join(F.broadcast(whole), list(keys)) if keys else series.crossJoin(F.broadcast(whole))
        n, off = F.col("__n"), F.col("r") - F.col("__mean")
        mean = F.col("__mean") - off / (n - 1)
        rest = F.col("__var") * (n - 1) - off * off * n / (n - 1)
        sd = F.sqrt(F.greatest(rest, F.lit(0.0)) / (n - 2))
        value = F.when((n > 2) & (sd > 0), (mean - F.lit(rf)) / sd * F.sqrt(F.lit(float(days))))
        return rows.select(*keys, "date", value.alias("value"))

    return ratios
