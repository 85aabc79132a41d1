"""The study's hypotheses: drawdown (H1), Sharpe ratio (H2), dependence on the crypto share (H3), one Holm family."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.tables import settled, side_by_side
from ..operators import bootstrap, statistics, strategies
from . import study


def weight_matrix(dim: DataFrame, shares: list[float], assets: list[str]) -> np.ndarray:
    """assets by shares: the table of class weights as an array (a number for each asset and share, both given by name)."""
    spark = dim.sparkSession
    found = {(r.asset, r.share): r.w for r in strategies.class_weights(dim, study.shares_of(spark, shares)).collect()}
    return np.array([[found.get((a, s), 0.0) for s in shares] for a in assets])


def sweep_bootstrap(s: study.Inputs, cfg: Config, target: float) -> DataFrame:
    """sweep_bootstrap_n draws of the whole sweep (see bootstrap.sweep_draws); the rate is the sample's mean, as resampled paths have no calendar."""
    rf = study.with_rf(s.returns.select("date").distinct(), s, cfg).agg(F.avg("rf")).first()[0]
    shares = cfg.sweep_shares()
    assets = sorted(r.asset for r in s.dim.select("asset").collect())
    return bootstrap.sweep_draws(s.returns, assets, weight_matrix(s.dim, shares, assets), shares, target, float(rf), replace(cfg, bootstrap_n=cfg.sweep_bootstrap_n))


def pairs(rows: DataFrame, strategy: str, against: str = "BuyHold") -> DataFrame:
    """date, a, b, rf of two strategies on their common dates."""
    a = rows.where(F.col("strategy") == strategy).select("date", F.col("r").alias("a"), "rf")
    return a.join(rows.where(F.col("strategy") == against).select("date", F.col("r").alias("b")), "date")


def _row(name: str, df: DataFrame, estimate: str, low: str, high: str) -> DataFrame:
    return df.select(F.lit(name).alias("name"), F.col(estimate).alias("estimate"), F.col("p"), F.col(low).alias("low"), F.col(high).alias("high"))


def _paired(both: DataFrame, cfg: Config) -> list[Callable[[], DataFrame]]:
    """H1 and H2 of settled pairs."""

    def sharpe() -> DataFrame:
        rf = both.agg(F.avg("rf")).first()[0]
        return _row("H2 Sharpe ratio", bootstrap.paired_difference(both, bootstrap.sharpe_metric(rf, cfg.trading_days), cfg), "observed", "ci_low_bca", "ci_high_bca")

    return [lambda: _row("H1 drawdown", bootstrap.paired_difference(both, bootstrap.DRAWDOWN, cfg), "observed", "ci_low_bca", "ci_high_bca"), sharpe]


def _slopes(draws: DataFrame) -> DataFrame:
    return _union([_row(f"H3 {m}", bootstrap.slope(draws, m), "slope", "ci_low", "ci_high") for m in ("d_mdd", "d_cvar")])


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _points(sweep: DataFrame) -> DataFrame:
    """metric, x, y of a sweep: both outcomes as one keyed table."""
    return sweep.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col("share").alias("x"), F.col(m).alias("y")) for m in ("d_mdd", "d_cvar")])))


def _hac(sweep: DataFrame, prefix: str) -> DataFrame:
    """The slope of both outcomes over the sweep's shares with HAC errors."""
    fit = statistics.hac_ols(_points(sweep), ["metric"])
    width = 1.959964 * F.col("se")
    return fit.select(F.concat(F.lit(prefix), "metric").alias("name"), F.col("slope").alias("estimate"), "p", (F.col("slope") - width).alias("low"), (F.col("slope") + width).alias("high"))


def tests(s: study.Inputs, cfg: Config, target: float, basis: str = "bootstrap", pit: study.Builder | None = None) -> DataFrame:
    """name, estimate, p, p_holm, low, high. basis: H3 by data-level bootstrap, or by HAC regression on the sweep's points."""
    if basis not in ("bootstrap", "hac"):
        raise ValueError(f"basis is bootstrap or hac, not {basis!r}")
    spark = s.returns.sparkSession
    level = (lambda: sweep_bootstrap(s, cfg, target)) if basis == "bootstrap" else (lambda: study.crypto_sweep(s, cfg, target, pit))
    both, points = side_by_side(spark, lambda: pairs(study.run_strategies(s, cfg, pit), f"VolControl_{cfg.target(target):g}"), level)
    third = (lambda: _slopes(points)) if basis == "bootstrap" else (lambda: _hac(points, "H3 "))
    return statistics.holm(_union(side_by_side(spark, *_paired(both, cfg), third)))


def report(s: study.Inputs, cfg: Config, target: float, pit: study.Builder | None = None) -> DataFrame:
    """name, estimate, p, low, high of every test of the study, and p_holm in the three families: the confirmatory one (H1, H2
    and the data-level slopes), that with the Wilcoxon test, which is descriptive, and that with the sweep-level slopes instead.

    A probabilistic or deflated ratio's estimate is the chance it states; neither has a p value. The study's tables are settled first, side by side; the
    tests then are small plans over them, and run side by side, too.
    """
    spark, none = s.returns.sparkSession, F.lit(None).cast("double")
    chosen = f"VolControl_{cfg.target(target):g}"
    rows, sweep, draws, tried = side_by_side(
        spark,
        lambda: study.run_strategies(s, cfg, pit).where(F.col("strategy").isin(chosen, "BuyHold")).select("strategy", "date", "r", "rf"),
        lambda: study.crypto_sweep(s, cfg, target, pit),
        lambda: sweep_bootstrap(s, cfg, target),
        lambda: study.trials(s, cfg, target, pit).select("config_id", "r"),
    )
    both, own = settled(pairs(rows, chosen)), rows.where(F.col("strategy") == chosen)

    def signed() -> DataFrame:
        found = statistics.wilcoxon(both.select((F.col("a") - F.col("b")).alias("d")))
        return found.select(F.lit("Wilcoxon of periods").alias("name"), F.least("w_plus", "w_minus").alias("estimate"), "p", none.alias("low"), none.alias("high"))

    def trend() -> DataFrame:
        found = statistics.mann_kendall(_points(sweep), ["metric"])
        return found.select(F.concat(F.lit("Mann-Kendall "), "metric").alias("name"), F.col("tau").alias("estimate"), "p", none.alias("low"), none.alias("high"))

    def resampled(metric: str) -> DataFrame:
        found = bootstrap.slope_resampled(sweep.select(F.col("share").alias("x"), F.col(metric).alias("y")), seed=cfg.seed)
        return found.select(F.lit(f"Resampled slope {metric}").alias("name"), F.col("slope").alias("estimate"), none.alias("p"), F.col("ci_low").alias("low"), F.col("ci_high").alias("high"))

    def chances() -> DataFrame:
        chance = statistics.probabilistic_sharpe(own, ["strategy"]).select(F.lit("Probabilistic Sharpe ratio").alias("name"), F.col("psr").alias("estimate"))
        luck = statistics.deflated_sharpe(own, tried, ["strategy"]).select(F.lit("Deflated Sharpe ratio").alias("name"), F.col("dsr").alias("estimate"))
        return chance.unionByName(luck).select("name", "estimate", none.alias("p"), none.alias("low"), none.alias("high"))

    out = _union(side_by_side(spark, *_paired(both, cfg), lambda: _slopes(draws), signed, lambda: _hac(sweep, "HAC "), trend, lambda: resampled("d_mdd"), lambda: resampled("d_cvar"), chances))
    name = F.col("name")
    core, data, level = name.startswith("H1") | name.startswith("H2"), name.startswith("H3"), name.startswith("HAC")
    families = {"p_holm": core | data, "p_holm_with_wilcoxon": core | data | name.startswith("Wilcoxon"), "p_holm_sweep_level": core | level}
    member = F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in families.items()]))
    adjusted = statistics.holm(out.select("name", "p", F.explode(member).alias("family")), ["family"])
    wide = adjusted.groupBy("name").pivot("family", list(families)).agg(F.first("p_holm"))
    return out.join(wide, "name", "left")


def over_samples(prices: DataFrame, specs: list, rates: DataFrame, dim: DataFrame, cfg: Config, target: float) -> DataFrame:
    """scenario, n, H1, H2 and the data-level slope with their bounds, and the best share, of every sample."""
    out = None
    for spec in specs:  # a handful of named samples
        s, pit = study.of_sample(prices, spec, rates, dim)
        found = tests(s, cfg, target, "bootstrap", pit)
        of = lambda start, c: F.max(F.when(F.col("name").startswith(start), F.col(c)))
        wide = found.agg(*[of(start, c).alias(f"{short}_{c}") for short, start in (("h1", "H1"), ("h2", "H2"), ("slope", "H3 d_mdd")) for c in ("estimate", "low", "high")])
        best = bootstrap.argmax(sweep_bootstrap(s, cfg, target).persist()).where("is_best").select(F.col("share").alias("best_share"))
        n = s.returns.agg(F.countDistinct("date").alias("n"))
        row = wide.crossJoin(best).crossJoin(n).withColumn("scenario", F.lit(spec.name))
        out = row if out is None else out.unionByName(row)
    return out.select("scenario", "n", *[c for c in out.columns if c not in ("scenario", "n")])
