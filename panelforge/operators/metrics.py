"""Risk and return metrics of series (keys, date, r, rf)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import dated, ratio, so_far, wealth


def cagr(r: Column, trading_days: float | Column) -> Column:
    """Growth a year; -1 once everything is lost."""
    growth = F.product(1 + r)
    days = trading_days if isinstance(trading_days, Column) else F.lit(float(trading_days))
    return F.when(growth <= 0, F.lit(-1.0)).otherwise(F.pow(growth, days / F.count(r)) - 1)


def with_paths(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds wealth (after the date's return) and drawdown (against the highest wealth so far)."""
    return series.withColumn("wealth", wealth(F.col("r"), keys)).withColumn("drawdown", F.col("wealth") / F.max("wealth").over(so_far(keys)) - 1)


def with_quantile(series: DataFrame, keys: Sequence[str], alpha: float) -> DataFrame:
    """Adds var: the exact interpolated alpha quantile of r of the row's series."""
    return series.withColumn("var", F.percentile("r", F.lit(alpha)).over(Window.partitionBy(*keys)))


def summary(series: DataFrame, keys: Sequence[str], trading_days: float | Column = 52, alpha: float = 0.05, more: Sequence[Column] = ()) -> DataFrame:
    """keys, n, first, last, ann_return, cagr, ann_vol, sharpe, max_drawdown, cvar of every series, and more aggregates in the same pass."""
    rows = with_quantile(with_paths(series, keys), keys, alpha)
    excess = F.col("r") - F.col("rf")
    days = trading_days if isinstance(trading_days, Column) else F.lit(float(trading_days))
    return rows.groupBy(*keys).agg(
        F.count("r").alias("n"),
        F.min("date").alias("first"),
        F.max("date").alias("last"),
        (F.avg("r") * days).alias("ann_return"),
        cagr(F.col("r"), days).alias("cagr"),
        (F.stddev_samp("r") * F.sqrt(days)).alias("ann_vol"),
        (ratio(F.avg(excess), F.stddev_samp(excess)) * F.sqrt(days)).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg(F.when(F.col("r") <= F.col("var"), F.col("r"))).alias("cvar"),
        *more,
    )


def limit_flags(table: DataFrame, mdd_limit: float | None, cvar_limit: float | None) -> DataFrame:
    """Adds mdd_breach and cvar_breach: strictly below the limit, and false where none is set."""
    below = lambda c, limit: F.lit(False) if limit is None else F.coalesce(F.col(c) < limit, F.lit(False))
    return table.withColumn("mdd_breach", below("max_drawdown", mdd_limit)).withColumn("cvar_breach", below("cvar", cvar_limit))


def describe_assets(prices: DataFrame, rf_annual: float = 0.0, alpha: float = 0.05, least: int = 3, clamp: tuple[int, int] = (200, 366)) -> DataFrame:
    """asset and the distribution of its returns on its own calendar, for prices (date, asset, price).

    Annualised by trading_days: its returns a year from its first price to its last, rounded half to even and held to
    `clamp`. The Sharpe ratio is over rf_annual / trading_days a period. Assets of fewer than `least` returns are left out.
    """
    own = prices.where("price is not null")
    span = own.groupBy("asset").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    r = own.withColumn("r", F.col("price") / F.lag("price").over(dated(["asset"])) - 1).where("r is not null").select("asset", "date", "r")
    rows = with_quantile(with_paths(r, ["asset"]), ["asset"], alpha)
    out = rows.groupBy("asset").agg(
        F.count("r").alias("n"),
        F.avg("r").alias("mean"),
        F.stddev_samp("r").alias("sd"),
        F.skewness("r").alias("skew"),
        F.kurtosis("r").alias("excess_kurtosis"),
        F.min("drawdown").alias("max_drawdown"),
        F.first("var").alias("var"),
        F.avg(F.when(F.col("r") <= F.col("var"), F.col("r"))).alias("cvar"),
        F.max("r").alias("best"),
        F.min("r").alias("worst"),
        F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("pct_positive"),
    )
    years = F.greatest(F.datediff("last", "first") / 365.25, F.lit(1e-9))
    days = F.least(F.greatest(F.bround(F.col("n") / years), F.lit(float(clamp[0]))), F.lit(float(clamp[1])))
    out = out.where(F.col("n") >= least).join(F.broadcast(span), "asset").withColumn("trading_days", days)
    sharpe = ratio(F.col("mean") - rf_annual / F.col("trading_days"), F.col("sd")) * F.sqrt("trading_days")
    return out.withColumn("ann_return", F.col("mean") * F.col("trading_days")).withColumn("ann_vol", F.col("sd") * F.sqrt("trading_days")).withColumn("sharpe", sharpe).drop("mean", "sd")


def correlation_matrix(returns: DataFrame) -> DataFrame:
    """a, b, corr of every ordered pair of assets: a join on the date, so rows stay linear in the dates."""
    left, right = returns.select("date", F.col("asset").alias("a"), F.col("r").alias("x")), returns.select("date", F.col("asset").alias("b"), F.col("r").alias("y"))
    return left.join(right, "date").groupBy("a", "b").agg(F.corr("x", "y").alias("corr"))


def calendar_returns(returns: DataFrame, keys: Sequence[str] = ("asset",), least: int = 10) -> DataFrame:
    """keys, year, n, total (of the year), since (from the year's start to the end); null under `least` rows."""
    years = returns.groupBy(*keys, F.year("date").alias("year")).agg(F.count("r").alias("n"), F.product(1 + F.col("r")).alias("g"))
    onward = Window.partitionBy(*keys).orderBy(F.col("year").desc()).rowsBetween(Window.unboundedPreceding, 0)
    years = years.withColumn("since", F.product("g").over(onward) - 1)
    return years.withColumn("total", F.when(F.col("n") >= least, F.col("g") - 1)).drop("g")


def monthly_returns(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, year, month, total; month null is the year's total: one rollup."""
    rows = series.select(*keys, F.year("date").alias("year"), F.month("date").alias("month"), "r")
    parts = rows.groupBy(*keys, "year", "month").agg(F.product(1 + F.col("r")).alias("g"))
    whole = parts.groupBy(*keys, "year").agg(F.product("g").alias("g")).withColumn("month", F.lit(None).cast("int"))
    return parts.unionByName(whole).withColumn("total", F.col("g") - 1).drop("g")


def month_matrix(monthly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a year, a column a month, and the annual total."""
    wide = monthly.where("month is not null").groupBy(*keys, "year").pivot("month", list(range(1, 13))).agg(F.first("total"))
    return wide.join(monthly.where("month is null").select(*keys, "year", F.col("total").alias("annual")), [*keys, "year"])


def sample_window(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return series.groupBy(*keys).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.countDistinct("date").alias("n"))


def partial_years(window: DataFrame) -> DataFrame:
    """Adds first_partial and last_partial: does the first or last year miss its beginning or its end."""
    early = F.make_date(F.year("first"), F.lit(1), F.lit(5))
    late = F.make_date(F.year("last"), F.lit(12), F.lit(25))
    return window.withColumn("first_partial", F.col("first") > early).withColumn("last_partial", F.col("last") < late)


def drawdown_episodes(series: DataFrame, keys: Sequence[str], top: int = 5) -> DataFrame:
    """keys, rank, start, trough, recovery (null while open), depth, of the deepest episodes under water."""
    rows = with_paths(series, keys)
    island = F.sum(F.when(F.col("drawdown") >= 0, 1).otherwise(0)).over(so_far(keys))
    rows = rows.withColumn("island", island).withColumn("next", F.lead("date").over(dated(keys)))
    under = rows.where("drawdown < 0").groupBy(*keys, "island").agg(
        F.min("date").alias("start"), F.min(F.struct("drawdown", "date"))["date"].alias("trough"), F.max(F.struct("date", "next"))["next"].alias("recovery"), F.min("drawdown").alias("depth"), F.count("*").alias("periods")
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("depth", "start"))
    return under.withColumn("rank", rank).where(F.col("rank") <= top).drop("island")


def return_distribution(series: DataFrame, keys: Sequence[str], bins: int = 41, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """keys, bin, lower, upper, density over common edges: from the least low quantile of the series to the largest high one;
    what lies outside is left out."""
    each = series.groupBy(*keys).agg(F.percentile("r", F.lit(low)).alias("lo"), F.percentile("r", F.lit(high)).alias("hi"))
    edges = each.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    inside = series.crossJoin(F.broadcast(edges)).where("r between lo and hi").withColumn("width", width)
    at = F.least(F.floor((F.col("r") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    counts = inside.withColumn("bin", at).groupBy(*keys, "bin", "lo", "width").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("density", F.col("n") / total / F.col("width")).select(*keys, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("lower"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("upper"), "n", "density")


def tail_marks(series: DataFrame, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """keys, var (the interpolated alpha quantile of r) and cvar (the mean of what is not above it)."""
    return with_quantile(series, keys, alpha).groupBy(*keys).agg(F.first("var").alias("var"), F.avg(F.when(F.col("r") <= F.col("var"), F.col("r"))).alias("cvar"))


def block_means(series: DataFrame, blocks: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, block, n, mean of a value over named blocks of dates (block, a, b): from a on, before b; nulls count for nothing."""
    inside = series.join(F.broadcast(blocks), (F.col("date") >= F.col("a")) & (F.col("date") < F.col("b")))
    return inside.groupBy(*keys, "block").agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def exposure_stats(series: DataFrame, keys: Sequence[str], cap: float = 1.0) -> DataFrame:
    """Share at the cap, mean, sd, mean change, share of dates with a change, turnover, of a daily exposure series."""
    change = F.abs(F.col("exposure") - F.lag("exposure").over(dated(keys)))
    rows = series.withColumn("__d", change)
    return rows.groupBy(*keys).agg(
        F.avg(F.when(F.col("exposure") >= cap - 1e-12, 1.0).otherwise(0.0)).alias("share_at_cap"),
        F.avg("exposure").alias("mean"),
        F.stddev_samp("exposure").alias("sd"),
        F.avg("__d").alias("mean_change"),
        F.avg(F.when(F.col("__d") > 1e-12, 1.0).otherwise(0.0)).alias("share_changed"),
        F.sum("__d").alias("turnover"),
    )
