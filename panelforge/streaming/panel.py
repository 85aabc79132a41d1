"""An extension beyond batch studies: the price panel kept up by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_panel(trades: DataFrame, late: str = "14 days", width: str = "7 days") -> DataFrame:
    """date, asset, price, n of trades (ts, asset, price): a mean by tumbling window from Monday on; the watermark bounds
    the state, and trades later than `late` are dropped."""
    window = F.window("ts", width, width, "4 days")
    cents = F.sum(F.floor(F.col("price") * 100 + 0.5)).cast("double")
    out = trades.withWatermark("ts", late).groupBy(window.alias("w"), "asset").agg((cents / F.count("price") / 100).alias("price"), F.count("price").alias("n"))
    return out.select(F.col("w.start").cast("date").alias("date"), "asset", "price", "n")
