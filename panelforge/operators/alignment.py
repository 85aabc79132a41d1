"""Alignment of calendars and simple returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import dated


def complete_case(prices: DataFrame, n_assets: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of the dates on which every asset has a price: one count by date, then a semi join."""
    if n_assets is None:
        n_assets = prices.select("asset").distinct().count()
    whole = prices.groupBy(*keys, "date").agg(F.count("price").alias("n")).where(F.col("n") == n_assets).select(*keys, "date")
    return prices.join(whole, [*keys, "date"], "left_semi")


def simple_returns(prices: DataFrame, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """date, asset, r: price over the asset's price before, less one, on the calendar of the rows given."""
    before = F.lag("price").over(dated(keys))
    return prices.withColumn("r", F.col("price") / before - 1).where(F.col("r").isNotNull()).drop("price")


def calendar(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The union of the dates of all series."""
    return series.select(*keys, "date").distinct()


def on_calendar(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every series on the union of all dates; values it lacks are null."""
    grid = calendar(series).crossJoin(series.select(*keys).distinct())
    return grid.join(series, [*keys, "date"], "left")


def strided(series: DataFrame, keys: Sequence[str], points: int = 400) -> DataFrame:
    """Every k-th row of a series from its first, k = max(1, rows // points)."""
    from pyspark.sql import Window

    rows = series.withColumn("__rn", F.row_number().over(dated(keys)) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    stride = F.greatest(F.floor(F.col("__n") / points), F.lit(1))
    return rows.where(F.col("__rn") % stride == 0).drop("__rn", "__n")
