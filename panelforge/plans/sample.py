"""Point-in-time samples: assets join when they have been listed for a while, and weights follow a date later."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import dated
from ..operators.alignment import complete_case


@dataclass(frozen=True)
class SampleSpec:
    """A named sample: window, members of the crypto sleeve, and whether they join as they list."""

    name: str
    label: str
    start: str
    end: str
    members: tuple[str, ...]
    point_in_time: bool = False
    buffer: int = 30
    rationale: str = ""


CATALOGUE = (
    SampleSpec("S1", "fixed basket", "1995-01-01", "2001-12-31", ("AO", "NO", "RO"), False, 30, "all assets on all dates"),
    SampleSpec("S2", "point in time", "1995-01-01", "2001-12-31", ("AO", "NO", "RO"), True, 8, "assets join as they list"),
    SampleSpec("S3", "late window", "1998-01-01", "2001-12-31", ("AO", "NO", "RO"), False, 30, "the years after the first phase"),
    *[SampleSpec(f"S4_{y}", f"start {y}", f"{y}-01-01", "2001-12-31", ("AO", "NO", "RO"), False, 30, "how much the first year matters") for y in (1996, 1997, 1998, 1999, 2000)],
)


def scenario(name: str) -> SampleSpec:
    """The spec of that name; an unknown one is an error, not the default."""
    for spec in CATALOGUE:
        if spec.name == name:
            return spec
    raise ValueError(f"unknown sample {name!r}; known: {[s.name for s in CATALOGUE]}")


def late_listing(prices: DataFrame, listings: dict[str, str]) -> DataFrame:
    """prices without those of an asset before its listing date."""
    first = F.lit(None).cast("date")
    for asset, day in listings.items():
        first = F.when(F.col("asset") == asset, F.lit(day).cast("date")).otherwise(first)
    return prices.where(first.isNull() | (F.col("date") >= first))


def entry_dates(prices: DataFrame, members: tuple[str, ...], buffer: int) -> DataFrame:
    """asset, first, entry of the members: the buffer-th row of the panel's calendar after the first price.

    Assets whose buffer ends beyond the calendar don't enter.
    """
    calendar = prices.select("date").distinct().withColumn("rn", F.row_number().over(Window.orderBy("date")))
    first = prices.where(F.col("asset").isin(list(members)) & F.col("price").isNotNull()).groupBy("asset").agg(F.min("date").alias("first"))
    started = first.join(calendar, first["first"] == calendar["date"]).select("asset", "first", (F.col("rn") + buffer).alias("rn"))
    return started.join(calendar.withColumnRenamed("date", "entry"), "rn").select("asset", "first", "entry")


def active(dates: DataFrame, dim: DataFrame, entries: DataFrame, members: tuple[str, ...]) -> DataFrame:
    """date, asset, is_member, active for every date and asset: members from their entry on, others always."""
    grid = dates.crossJoin(F.broadcast(dim.select("asset"))).join(F.broadcast(entries.select("asset", "entry")), "asset", "left")
    member = F.col("asset").isin(list(members))
    return grid.select("date", "asset", member.alias("is_member"), F.when(member, F.coalesce(F.col("date") >= F.col("entry"), F.lit(False))).otherwise(True).alias("active"))


def resolve(prices: DataFrame, spec: SampleSpec, dim: DataFrame) -> DataFrame:
    """The prices of the sample. Fixed: dates on which all assets have a price. Point in time: dates on
    which no active asset lacks one and some member is active."""
    inside = prices.where(F.col("date").between(F.lit(spec.start).cast("date"), F.lit(spec.end).cast("date")))
    if not spec.point_in_time:
        return complete_case(inside, dim.count())
    grid = active(inside.select("date").distinct(), dim, entry_dates(prices, spec.members, spec.buffer), spec.members).join(inside, ["date", "asset"], "left")
    kept = grid.groupBy("date").agg(F.bool_or(F.col("active") & F.col("price").isNull()).alias("lacks"), F.bool_or(F.col("active") & F.col("is_member")).alias("some"))
    return inside.join(kept.where("not lacks and some").select("date"), "date", "left_semi")


def report(prices: DataFrame, kept: DataFrame, spec: SampleSpec) -> DataFrame:
    """One row: the sample's effective window and what it dropped."""
    window = prices.where(F.col("date").between(F.lit(spec.start).cast("date"), F.lit(spec.end).cast("date"))).agg(F.countDistinct("date").alias("n_window"))
    out = kept.agg(F.min("date").alias("effective_start"), F.max("date").alias("effective_end"), F.countDistinct("date").alias("n_price_rows"))
    out = out.crossJoin(window).select(F.lit(spec.name).alias("scenario"), "effective_start", "effective_end", "n_price_rows", F.greatest(F.col("n_price_rows") - 1, F.lit(0)).alias("n_return_rows"), "n_window")
    return out.withColumn("n_dropped", F.col("n_window") - F.col("n_price_rows"))


def pit_weights(dates: DataFrame, spec: SampleSpec, entries: DataFrame, dim: DataFrame, shares: DataFrame) -> DataFrame:
    """share, date, asset, w: the share dealt equally over active members, known the date before; without any,
    the traditional assets get all. The first date takes the second's weights."""
    grid = active(dates, dim, entries, spec.members).join(F.broadcast(dim.select("asset", "base_weight")), "asset").crossJoin(F.broadcast(shares))
    whole = Window.partitionBy("share", "date")
    n = F.sum((F.col("active") & F.col("is_member")).cast("int")).over(whole)
    base = F.sum(F.when(~F.col("is_member"), F.col("base_weight"))).over(whole)
    given = F.when(n > 0, F.col("share")).otherwise(0.0)
    w = F.when(F.col("is_member"), F.when(F.col("active"), F.col("share") / n).otherwise(0.0)).otherwise(F.col("base_weight") / base * (1 - given))
    order = dated(["share", "asset"])
    today = grid.withColumn("__w", w)
    return today.withColumn("w", F.coalesce(F.lag("__w").over(order), F.col("__w"))).select("share", "date", "asset", "is_member", "w")


def weighted_portfolio(returns: DataFrame, weights: DataFrame, keys=("share",)) -> DataFrame:
    """keys, date, r of a weight path; a missing return is 0."""
    return weights.join(returns, ["date", "asset"], "left").groupBy(*keys, "date").agg(F.sum(F.col("w") * F.coalesce("r", F.lit(0.0))).alias("r"))


def sleeve_cost(weights: DataFrame, bps: float = 25.0, keys=("share",)) -> DataFrame:
    """keys, date, turnover, cost of the members alone: re-spreading the sleeve when one enters is a trade."""
    change = F.coalesce(F.abs(F.col("w") - F.lag("w").over(dated([*keys, "asset"]))), F.lit(0.0))
    moved = weights.where("is_member").withColumn("__d", change)
    return moved.groupBy(*keys, "date").agg(F.sum("__d").alias("turnover")).withColumn("cost", F.col("turnover") * bps / 1e4)


def sleeve_events(cost: DataFrame, most: int = 20) -> DataFrame:
    """The first dates on which the sleeve was re-spread."""
    return cost.where("turnover > 1e-9").orderBy("date").limit(most)
