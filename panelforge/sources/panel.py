"""Sources of price panels and rate fixings, in long form: a missing price is a missing row."""

from __future__ import annotations

import math
from datetime import date as Date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ASSETS
from ..functions.tables import constants
from ..functions.windows import period

PRICES = T.StructType([T.StructField("date", T.DateType()), T.StructField("asset", T.StringType()), T.StructField("price", T.DoubleType())])
RATES = T.StructType([T.StructField("date", T.DateType()), T.StructField("rf_annual", T.DoubleType())])


def price_panel(spark: SparkSession, sf_dir: str, grain: str = "weekly") -> DataFrame:
    """The canonical panel: mean price of line items by ship week (or day) and flag pair.

    Means are of whole cents, so they don't depend on the order in which partial sums meet.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.groupBy(period(grain, F.col("l_shipdate")).alias("date"), F.concat("l_returnflag", "l_linestatus").alias("asset")).agg(_mean_of_cents("l_extendedprice").alias("price"))


def _mean_of_cents(column: str) -> Column:
    """floor(x + 1/2) stays a primitive in generated code, where round goes through decimals."""
    return F.sum(F.floor(F.col(column) * 100 + 0.5)).cast("double") / F.count(column) / 100


def rf_fixings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated annual rates of both signs with gaps, a late start (the bound reaches the scan) and an early end."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.to_date("o_orderdate")
    return orders.where((F.col("o_orderdate") >= F.lit("1995-02-01").cast("timestamp")) & (F.dayofmonth(day) <= 7)).groupBy(day.alias("date")).agg(((_mean_of_cents("o_totalprice") - 250000) / 2e6).alias("rf_annual"))


def universe(spark: SparkSession, assets: tuple = ASSETS) -> DataFrame:
    """asset, asset_class and whether a study takes it unasked."""
    return constants(spark, [(a, kind, True) for a, kind, *_ in assets], "asset string, asset_class string, is_default boolean")


def asset_dim(spark: SparkSession, assets: tuple = ASSETS) -> DataFrame:
    return constants(spark, list(assets), "asset string, asset_class string, base_weight double, cost_bps double")


def wide_csv(spark: SparkSession, path: str, assets: list[str]) -> DataFrame:
    """A wide CSV (date, one column an asset) as a long panel; empty cells are missing rows."""
    schema = T.StructType([T.StructField("date", T.DateType()), *[T.StructField(a, T.DoubleType()) for a in assets]])
    return spark.read.schema(schema).csv(path, header=True).unpivot("date", assets, "asset", "price").where("price is not null").select("date", "asset", "price")


def rates_csv(spark: SparkSession, path: str, percent: bool = False) -> DataFrame:
    """date, rf_annual; rows that are no numbers go."""
    raw = spark.read.schema("date date, value string").csv(path, header=True)
    return raw.select("date", (F.expr("try_cast(value as double)") / (100 if percent else 1)).alias("rf_annual")).where("rf_annual is not null and date is not null")


def sdmx_rates(spark: SparkSession, path: str, key: str | None = None, start: str | None = None) -> DataFrame:
    """date, rf_annual of saved SDMX responses in CSV form (KEY, TIME_PERIOD, OBS_VALUE in percent, among other columns in any order).

    path: a file, a folder or a pattern, each file a task or more. Months count from their first day. key and start are filters of the scan.
    Of several values of a day the one of the file whose name is last wins.
    """
    raw = spark.read.option("header", True).csv(path).select("KEY", "TIME_PERIOD", "OBS_VALUE", F.input_file_name().alias("file"))
    day = F.to_date(F.when(F.length("TIME_PERIOD") == 7, F.concat("TIME_PERIOD", F.lit("-01"))).otherwise(F.substring("TIME_PERIOD", 1, 10)))
    found = raw if key is None else raw.where(F.col("KEY") == key)
    if start is not None:
        found = found.where(F.col("TIME_PERIOD") >= start)
    found = found.select(day.alias("date"), (F.expr("try_cast(OBS_VALUE as double)") / 100).alias("rf_annual"), "file").where("rf_annual is not null and date is not null")
    return found.groupBy("date").agg(F.max_by("rf_annual", "file").alias("rf_annual"))


def chained_rates(old: DataFrame, new: DataFrame, switch: str, spread: float = 0.00085) -> DataFrame:
    """The old rate less a spread before the switch day, the new one from then on; the later source wins a day."""
    parts = old.where(F.col("date") < F.lit(switch).cast("date")).select("date", (F.col("rf_annual") - spread).alias("rf_annual"), F.lit(0).alias("source"))
    parts = parts.unionByName(new.where(F.col("date") >= F.lit(switch).cast("date")).select("date", "rf_annual", F.lit(1).alias("source")))
    return parts.groupBy("date").agg(F.max_by("rf_annual", "source").alias("rf_annual"))


def rate_summary(rates: DataFrame) -> DataFrame:
    """n, first, last, mean, lowest, highest, share_negative of a rate series."""
    r = F.col("rf_annual")
    return rates.agg(F.count(r).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.avg(r).alias("mean"), F.min(r).alias("lowest"), F.max(r).alias("highest"), F.avg(F.when(r < 0, 1.0).otherwise(0.0)).alias("share_negative"))


#: Fixed values of the synthetic panel: asset, drift and volatility a year, first listed business day.
SYNTHETIC = (
    ("MSCI_World", 0.08, 0.16, 0),
    ("Global_Bonds", 0.02, 0.05, 0),
    ("Gold", 0.05, 0.13, 0),
    ("Bitcoin", 0.40, 0.75, 0),
    ("Ethereum", 0.45, 0.90, 400),
    ("XRP", 0.20, 1.00, 0),
    ("BNB", 0.50, 0.95, 900),
    ("Solana", 0.60, 1.10, 1600),
)


def _normal(*of: Column) -> Column:
    """A standard normal number by hashes of the columns (Box and Muller)."""
    u = lambda kind: (F.shiftrightunsigned(F.xxhash64(F.lit(kind), *of), 11).cast("double") + 0.5) / float(1 << 53)
    return F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * math.pi * u("b"))


def synthetic_prices(spark: SparkSession, n_days: int = 3000, seed: int = 7, start: str = "2014-01-01", assets: tuple = SYNTHETIC) -> DataFrame:
    """Geometric random walks with a common factor on business days, from 100; later assets have no price before they list.

    Every number is a hash of seed, asset and day, so the panel doesn't depend on how it is partitioned.
    """
    whole = spark.range(n_days + 2 * (n_days // 5 + 2)).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("date"))
    days = whole.where(F.weekday("date") < 5).withColumn("day", F.row_number().over(Window.orderBy("date")) - 1).where(F.col("day") < n_days)
    dim = constants(spark, [(a, float(mu), float(vol), late, 0.9 if a == "MSCI_World" else 0.5 if vol < 0.2 else 0.3) for a, mu, vol, late in assets], "asset string, mu double, vol double, late int, beta double")
    market, own = _normal(F.lit(seed), F.lit("market"), F.col("day")), _normal(F.lit(seed), F.col("asset"), F.col("day"))
    step = F.col("mu") / 252 + F.col("vol") / math.sqrt(252) * (F.col("beta") * market + F.sqrt(1 - F.col("beta") ** 2) * own)
    path = Window.partitionBy("asset").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = days.crossJoin(F.broadcast(dim)).withColumn("step", step).withColumn("price", 100 * F.exp(F.sum("step").over(path)))
    return grown.where("day >= late").select("date", "asset", "price")


def panel_slice(prices: DataFrame, assets: list[str] | None = None, start: str | Date | None = None, end: str | Date | None = None) -> DataFrame:
    """The requested assets that are there, between two days inclusive; both filters reach the scan."""
    if assets is not None:
        prices = prices.where(F.col("asset").isin(list(assets)))
    if start is not None:
        prices = prices.where(F.col("date") >= F.lit(str(start)).cast("date"))
    if end is not None:
        prices = prices.where(F.col("date") <= F.lit(str(end)).cast("date"))
    return prices


def converted(prices: DataFrame, fx: DataFrame) -> DataFrame:
    """Prices in another currency: divided by the last rate (date, fx) known on the day."""
    from ..operators.riskfree import as_of

    return as_of(prices, fx, "fx", ["asset"]).select("date", "asset", (F.col("price") / F.col("fx")).alias("price"))
