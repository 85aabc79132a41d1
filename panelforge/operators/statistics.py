"""Tests and corrections as aggregates: every series of the table at once, told apart by keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import normal_cdf, normal_quantile, two_sided_p

EULER = 0.5772156649015329


def holm(tests: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds p_holm to (keys, name, p): step-down; a null p counts as 1 and comes last."""
    order = Window.partitionBy(*keys).orderBy(F.col("p").asc_nulls_last(), "name")
    m = F.count("*").over(Window.partitionBy(*keys))
    step = F.least((m - F.row_number().over(order) + 1) * F.coalesce("p", F.lit(1.0)), F.lit(1.0))
    return tests.withColumn("__s", step).withColumn("p_holm", F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def sharpe_moments(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, sr (a period's Sharpe ratio), skew, kurt (3 for a normal); sr null under three rows or without spread."""
    sd = F.stddev_samp("r")
    return series.groupBy(*keys).agg(F.count("r").alias("n"), F.when((F.count("r") >= 3) & (sd != 0), F.avg("r") / sd).alias("sr"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurt"))


def probabilistic_sharpe(series: DataFrame, keys: Sequence[str], benchmark=0.0) -> DataFrame:
    """keys, n, sr, z, psr: the chance that the true ratio exceeds the benchmark (a number or a column of series' moments)."""
    against = benchmark if not isinstance(benchmark, (int, float)) else F.lit(float(benchmark))
    spread = F.sqrt(F.greatest(1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") ** 2, F.lit(1e-12)))
    return sharpe_moments(series, keys).withColumn("z", (F.col("sr") - against) * F.sqrt(F.col("n") - 1) / spread).withColumn("psr", normal_cdf("z"))


def expected_best_sharpe(trials: DataFrame, config: str = "config_id") -> DataFrame:
    """One row: n_trials, var_sr, sr0 (the best ratio that as many trials reach by luck)."""
    one = sharpe_moments(trials, [config]).where("sr is not null").agg(F.count("*").alias("n_trials"), F.var_samp("sr").alias("var_sr"))
    n = F.col("n_trials").cast("double")
    best = (1 - EULER) * normal_quantile(1 - 1 / n) + EULER * normal_quantile(1 - 1 / (n * F.exp(F.lit(1.0))))
    return one.withColumn("sr0", F.when(F.col("n_trials") >= 2, F.sqrt("var_sr") * best))


def deflated_sharpe(selected: DataFrame, trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, sr, sr0, n_trials, z, dsr."""
    m = sharpe_moments(selected, keys).crossJoin(F.broadcast(expected_best_sharpe(trials)))
    spread = F.sqrt(F.greatest(1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") ** 2, F.lit(1e-12)))
    return m.withColumn("z", (F.col("sr") - F.col("sr0")) * F.sqrt(F.col("n") - 1) / spread).withColumn("dsr", normal_cdf("z")).select(*keys, "sr", "sr0", "n_trials", "z", "dsr")


def mann_kendall(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, s, tau, z, p of (keys, x, y): a trend of y along x, variance without ties.

    Pairs are counted by ranks: two points differ first at one bit of their ranks, so a running count of zeros and ones by bit
    and leading bits, in the order of x, gives all pairs in n log n rows. Points without a y are no points.
    """
    of = list(keys)
    ranked = points.where("y is not null").withColumn("__d", F.dense_rank().over(Window.partitionBy(*of).orderBy("y")) - 1)
    highest = F.ceil(F.log2(F.max("__d").over(Window.partitionBy(*of)) + 1)).cast("int")
    each = ranked.withColumn("__h", F.greatest(highest, F.lit(1))).withColumn("__b", F.explode(F.expr("sequence(0, __h - 1)")))
    each = each.withColumn("__lead", F.expr("shiftright(__d, __b + 1)")).withColumn("__one", F.expr("shiftright(__d, __b) & 1"))
    before = Window.partitionBy(*of, "__b", "__lead").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    ones, zeros = F.coalesce(F.sum("__one").over(before), F.lit(0)), F.coalesce(F.sum(1 - F.col("__one")).over(before), F.lit(0))
    pairs = each.withColumn("__s", F.when(F.col("__one") == 1, zeros).otherwise(-ones))
    out = pairs.groupBy(*of).agg(F.sum(F.when(F.col("__b") == 0, 1).otherwise(0)).alias("n"), F.sum("__s").cast("double").alias("s"))
    var = F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) / 18.0
    z = F.when(F.col("s") > 0, (F.col("s") - 1) / F.sqrt(var)).when(F.col("s") < 0, (F.col("s") + 1) / F.sqrt(var)).otherwise(0.0)
    return out.withColumn("tau", F.when(F.col("n") > 1, F.col("s") / (F.col("n") * (F.col("n") - 1) / 2.0))).withColumn("z", z).withColumn("p", two_sided_p("z"))


def hac_ols(points: DataFrame, keys: Sequence[str] = (), lags: int | None = None) -> DataFrame:
    """keys, n, slope, intercept, r2, se, z, p of y on x, with Newey-West errors of the slope in closed form.

    The slope's part of the sandwich is the long-run variance of (x - mean) * residual, over Sxx squared. lags: n ** 0.25 of each
    series rounded, at least 1; the longest series, which is counted first, says how many lags are summed.
    """
    if lags is None:
        longest = points.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
        most_lags = max(1, round(longest**0.25))
    else:
        most_lags = lags
    over = Window.partitionBy(*keys)
    order = over.orderBy("x")
    fit = points.withColumn("slope", F.regr_slope("y", "x").over(over)).withColumn("intercept", F.regr_intercept("y", "x").over(over)).withColumn("r2", F.regr_r2("y", "x").over(over))
    fit = fit.withColumn("__c", F.col("x") - F.avg("x").over(over)).withColumn("__u", F.col("__c") * (F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")))
    back = {i: F.coalesce(F.lag("__u", i).over(order), F.lit(0.0)) for i in range(1, most_lags + 1)}
    fit = fit.withColumns({f"__l{i}": F.col("__u") * c for i, c in back.items()})
    sums = fit.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.first(c).alias(c) for c in ("slope", "intercept", "r2")],
        F.sum(F.col("__c") ** 2).alias("__sxx"),
        F.sum(F.col("__u") ** 2).alias("__s0"),
        *[F.sum(f"__l{i}").alias(f"__s{i}") for i in back],
    )
    most = F.lit(lags) if lags is not None else F.greatest(F.lit(1), F.bround(F.pow(F.col("n").cast("double"), F.lit(0.25))))
    total = F.col("__s0")
    for i in back:
        total = total + F.when(most >= i, 2 * (1 - i / (most + 1)) * F.col(f"__s{i}")).otherwise(0.0)
    out = sums.withColumn("se", F.sqrt(F.greatest(total, F.lit(0.0))) / F.col("__sxx")).withColumn("z", F.when(F.col("se") > 0, F.col("slope") / F.col("se")))
    return out.withColumn("p", two_sided_p("z")).select(*keys, "n", "slope", "intercept", "r2", "se", "z", "p")


def wilcoxon(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, w_plus, w_minus, z, p of the differences d: signed ranks, zeros dropped, ties averaged, normal approximation."""
    rows = pairs.where("d <> 0").withColumn("__a", F.abs("d"))
    by_size = rows.groupBy(*keys, "__a").agg(F.count("*").alias("__t"), F.sum((F.col("d") > 0).cast("long")).alias("__plus"))
    before = Window.partitionBy(*keys).orderBy("__a").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by_size.withColumn("__rank", F.coalesce(F.sum("__t").over(before), F.lit(0)) + (F.col("__t") + 1) / 2.0)
    sums = ranked.groupBy(*keys).agg(
        F.sum("__t").alias("n"),
        F.sum(F.col("__rank") * F.col("__plus")).alias("w_plus"),
        F.sum(F.col("__rank") * (F.col("__t") - F.col("__plus"))).alias("w_minus"),
        F.sum(F.pow(F.col("__t").cast("double"), F.lit(3.0)) - F.col("__t")).alias("__ties"),
    )
    n = F.col("n").cast("double")
    sd = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("__ties") / 2) / 24)
    return sums.withColumn("z", (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / sd).withColumn("p", two_sided_p("z")).drop("__ties")
