"""Risk-free rates on a calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import dated


def as_of(rows: DataFrame, rates: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """rows with the last value dated on or before theirs; before the first, the first.

    Rates are a short table (a value a day at most), so each series takes its own copy of them and
    the search is one ordered window over the union, instead of a range join.
    """
    columns = rows.columns
    lanes = rates.select("date", value)
    if keys:
        lanes = rows.select(*keys).distinct().crossJoin(F.broadcast(lanes))
    marked = rows.withColumn("__is", F.lit(1)).unionByName(lanes.withColumn("__is", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("date", "__is")
    back = F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return marked.withColumn(value, F.coalesce(back, ahead)).where("__is = 1").select(*columns, value)


def daily_rate(dates: DataFrame, rates: DataFrame | None, trading_days: int, convention: str = "act360", rf_annual: float = 0.03, keys: Sequence[str] = (), aligned: bool = False) -> DataFrame:
    """dates (keys, date) with rf: what one period of the calendar given earns.

    constant: rf_annual / trading_days. simple: the as-of rate / trading_days. act360: the rate of the
    row before, times the days since it, over 360; the first row takes its own rate and the median gap.
    aligned: rates hold a row for every date already, so a broadcast join by date replaces the as-of search.
    """
    if convention == "constant" or rates is None:
        return dates.withColumn("rf", F.lit(rf_annual / trading_days))
    found = dates.join(F.broadcast(rates), "date") if aligned else as_of(dates, rates, "rf_annual", keys)
    if convention == "simple":
        return found.withColumn("rf", F.col("rf_annual") / trading_days).drop("rf_annual")
    over = dated(keys)
    gap = F.datediff("date", F.lag("date").over(over))
    found = found.withColumn("__gap", gap).withColumn("__rate", F.coalesce(F.lag("rf_annual").over(over), F.col("rf_annual")))
    middle = F.percentile("__gap", F.lit(0.5)).over(Window.partitionBy(*keys))
    return found.withColumn("rf", F.col("__rate") * F.coalesce("__gap", middle) / 360.0).drop("__gap", "__rate", "rf_annual")
