"""The study: strategies of one panel in one long table, and grids of settings as single plans."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ASSETS, Config
from ..functions.tables import constants
from ..functions.windows import dated, period, so_far
from ..operators import metrics, strategies
from ..operators.alignment import complete_case, on_calendar, simple_returns, strided
from ..operators.riskfree import as_of, daily_rate
from ..sources.panel import asset_dim, price_panel, rf_fixings
from .sample import SampleSpec, entry_dates, pit_weights, resolve, sleeve_cost

#: The mix of the two-asset benchmark.
BENCHMARK = (("AF", 0.6), ("NF", 0.4))
#: Dates that risk parity needs in the panel, and with weights.
PARITY_DATES, PARITY_LIVE = 80, 20
CONVENTIONS = {"fixings": "act360", "simple": "simple", "constant": "constant", "manual": "constant"}


@dataclass(frozen=True)
class Inputs:
    """A panel's returns (date, asset, r), its rate fixings, the dimension of its assets, and the rates known on each date."""

    returns: DataFrame
    rates: DataFrame
    dim: DataFrame
    known: DataFrame


def inputs(spark: SparkSession, sf_dir: str, grain: str = "weekly") -> Inputs:
    """The canonical panel. Facts are aggregated once: a panel has a row a date and asset, and is kept in memory."""
    prices = complete_case(price_panel(spark, sf_dir, grain), len(ASSETS))
    returns, rates = simple_returns(prices).persist(), rf_fixings(spark, sf_dir).persist()
    return Inputs(returns, rates, asset_dim(spark), as_of(returns.select("date").distinct(), rates, "rf_annual").persist())


def of_sample(prices: DataFrame, spec: SampleSpec, rates: DataFrame, dim: DataFrame) -> tuple[Inputs, Builder | None]:
    """The panel of a sample, and the weights of its sleeve by share if members join as they list."""
    kept = resolve(prices, spec, dim).persist()
    returns = simple_returns(kept).persist()
    found = Inputs(returns, rates, dim, as_of(returns.select("date").distinct(), rates, "rf_annual").persist())
    if not spec.point_in_time:
        return found, None
    first = kept.agg(F.min("date").alias("first_date"))
    days = kept.select("date").distinct().crossJoin(F.broadcast(first)).where("date > first_date").select("date")
    entries = entry_dates(prices, spec.members, spec.buffer)
    return found, lambda shares: pit_weights(days, spec, entries, dim, shares)


def with_rf(series: DataFrame, study: Inputs, cfg: Config, keys=()) -> DataFrame:
    """series with rf on each series' own calendar, a part of the panel's."""
    return daily_rate(series, study.known, cfg.trading_days, CONVENTIONS[cfg.rf_mode], cfg.rf_annual, keys, aligned=True)


def shares_of(spark: SparkSession, shares: list[float]) -> DataFrame:
    return constants(spark, [(float(s),) for s in shares], "share double")


#: Weights (share, date, asset, is_member, w) of a point-in-time sleeve at the shares (share) given.
Builder = Callable[[DataFrame], DataFrame]


def base(study: Inputs, cfg: Config, shares: list[float] | None = None, pit: Builder | None = None) -> DataFrame:
    """share, date, gross, turnover, cost, r (net), rf of the base portfolio at each crypto share; with a point-in-time sleeve
    also sleeve_cost, the part of the cost that its re-spreading makes."""
    wanted = shares_of(study.returns.sparkSession, shares or [cfg.crypto_share])
    if pit is None:
        mix = strategies.periodic_mix(study.returns, strategies.class_weights(study.dim, wanted), study.dim, cfg.weight_rebalance, ["share"])
    else:
        weights = pit(wanted).persist()
        path = strategies.together(weights.join(study.returns, ["date", "asset"], "left"), ["share"])
        mix = strategies.with_turnover(path, study.dim, ["share"]).withColumnRenamed("r", "gross").withColumn("r", F.col("gross") - F.col("cost"))
        mix = mix.join(sleeve_cost(weights).select("share", "date", F.col("cost").alias("sleeve_cost")), ["share", "date"])
    return with_rf(mix, study, cfg, ["share"])


def targets_of(spark: SparkSession, cfg: Config) -> DataFrame:
    bps = (1 - cfg.crypto_share) * 10.0 + cfg.crypto_share * 25.0
    return constants(spark, [(f"VolControl_{v:g}", float(v), bps) for v in cfg.target_vols], "strategy string, target double, bps double")


def controlled(study: Inputs, cfg: Config, mix: DataFrame | None = None) -> DataFrame:
    """strategy, target, date, r, gross, cost, exposure, turnover, base_turnover, rf of each target volatility, on the net base.

    mix: the base, where it is at hand.
    """
    rows = (mix or base(study, cfg)).select("date", "r", "rf", F.col("turnover").alias("base_turnover"))
    rows = rows.crossJoin(F.broadcast(targets_of(study.returns.sparkSession, cfg)))
    return strategies.vol_control(rows, ["strategy"], cfg.lookback, cfg.trading_days, cfg.max_leverage, cfg.rebalance, cfg.dead_band, cfg.vol_method, cfg.halflife)


def base_legs(study: Inputs, cfg: Config, pit: Builder | None) -> DataFrame:
    """strategy, date, asset, r, w: the held weights of every strategy, in one long table dealt by strategy.

    Controlled strategies hold the base portfolio, so its path stands there once for each. pit: the weights of a
    point-in-time base; then no strategy buys once and holds, since members join later.
    """
    spark, dim = study.returns.sparkSession, study.dim
    names = ["BuyHold", *(f"VolControl_{v:g}" for v in cfg.target_vols)]
    two = constants(spark, [("Benchmark_Classic", a, w, True) for a, w in BENCHMARK], "strategy string, asset string, w double, resets boolean")
    if pit is None:
        base = strategies.class_weights(dim, shares_of(spark, [cfg.crypto_share])).drop("share")
        every = constants(spark, [(n, True) for n in names] + [("Benchmark_TrueBH", False)], "strategy string, resets boolean")
        fixed = every.crossJoin(F.broadcast(base)).select("strategy", "asset", "w", "resets").unionByName(two)
    else:
        fixed = two
    when = F.when(F.col("resets"), period(cfg.weight_rebalance))
    path = strategies.held_weights(study.returns, fixed, when, ["strategy"]).select("strategy", "date", "asset", "r", "w")
    if pit is not None:
        given = pit(shares_of(spark, [cfg.crypto_share])).join(study.returns, ["date", "asset"], "left").crossJoin(F.broadcast(constants(spark, [(n,) for n in names], "strategy string")))
        path = path.unionByName(given.select(*path.columns))
    parity = strategies.risk_parity(study.returns.withColumn("strategy", F.lit("Benchmark_RiskParity")), cfg.parity_lookback, keys=["strategy"])
    # only of two assets or more, over enough dates, and with enough dates left
    whole = Window.partitionBy("strategy")
    size = study.returns.agg(F.countDistinct("date").alias("dates"), F.countDistinct("asset").alias("assets"))
    live = parity.withColumn("days", F.size(F.collect_set("date").over(whole))).crossJoin(F.broadcast(size)).where(f"assets >= 2 and dates > {PARITY_DATES} and days > {PARITY_LIVE}")
    return strategies.together(path.unionByName(live.select(*path.columns)), ["strategy"])


def run_strategies(study: Inputs, cfg: Config, pit: Builder | None = None) -> DataFrame:
    """strategy, date, r, gross, exposure, turnover_exposure, turnover_sleeve, turnover, rf of every strategy, each on its own calendar.

    All strategies are one plan: weights, turnover, rates and control are windows within a strategy, and rows are dealt by
    strategy once. pit: see base_legs; costs of a point-in-time sleeve are part of its turnover's, charged once. A few
    rows a date, kept in memory, since most reports read them more than once (`release` lets go).
    """
    spark, none = study.returns.sparkSession, F.lit(None).cast("double")
    rows = strategies.with_turnover(base_legs(study, cfg, pit), study.dim, ["strategy"]).withColumnRenamed("r", "gross")
    # bought once: no trade, and no return on the first date
    bought = F.col("strategy") == "Benchmark_TrueBH"
    first = F.row_number().over(dated(["strategy"])) == 1
    rows = rows.withColumn("gross", F.when(bought & first, 0.0).otherwise(F.col("gross")))
    rows = rows.withColumns({c: F.when(bought, 0.0).otherwise(F.col(c)) for c in ("turnover", "cost")})
    rows = with_rf(rows.select("strategy", "date", "gross", (F.col("gross") - F.col("cost")).alias("r"), "turnover"), study, cfg, ["strategy"])
    rows = rows.join(F.broadcast(targets_of(spark, cfg)), "strategy", "left").withColumnRenamed("turnover", "sleeve")
    if cfg.dead_band:  # folds series by series, so only the controlled ones
        plain, rows = rows.where("target is null").drop("target", "bps"), rows.where("target is not null")
    vc = strategies.vol_control(rows.withColumnRenamed("gross", "base_gross").withColumn("base", F.col("r")), ["strategy"], cfg.lookback, cfg.trading_days, cfg.max_leverage, cfg.rebalance, cfg.dead_band, cfg.vol_method, cfg.halflife)
    own = lambda controlled, other: F.when(F.col("target").isNotNull(), controlled).otherwise(other)
    out = vc.select(
        "strategy",
        "date",
        own(F.col("r"), F.col("base")).alias("r"),
        own(F.col("gross"), F.col("base_gross")).alias("gross"),
        own(F.col("exposure"), none).alias("exposure"),
        own(F.col("turnover"), F.lit(0.0)).alias("turnover_exposure"),
        own(F.col("sleeve") * F.col("exposure"), F.col("sleeve")).alias("turnover_sleeve"),
        "rf",
    )
    if cfg.dead_band:
        out = out.unionByName(plain.select("strategy", "date", "r", "gross", none.alias("exposure"), F.lit(0.0).alias("turnover_exposure"), F.col("sleeve").alias("turnover_sleeve"), "rf"))
    out = out.withColumn("turnover", F.col("turnover_exposure") + F.col("turnover_sleeve"))
    return out.select("strategy", "date", "r", "gross", "exposure", "turnover_exposure", "turnover_sleeve", "turnover", "rf").persist()


def release(*tables: DataFrame | Inputs) -> None:
    """Lets go of what inputs and run_strategies keep in memory."""
    for t in tables:
        for df in (t.returns, t.rates, t.known) if isinstance(t, Inputs) else (t,):
            df.unpersist()


def metrics_table(rows: DataFrame, cfg: Config) -> DataFrame:
    """strategy and its metrics, turnover in its parts, and the gross twins of return, growth and Sharpe."""
    excess, days = F.col("gross") - F.col("rf"), F.lit(float(cfg.trading_days))
    more = (
        F.sum("turnover").alias("turnover"),
        F.sum("turnover_exposure").alias("turnover_exposure"),
        F.sum("turnover_sleeve").alias("turnover_sleeve"),
        (F.avg("gross") * days).alias("ann_return_gross"),
        metrics.cagr(F.col("gross"), days).alias("cagr_gross"),
        (F.when(F.stddev_samp(excess) != 0, F.avg(excess) / F.stddev_samp(excess)) * F.sqrt(days)).alias("sharpe_gross"),
    )
    return metrics.summary(rows, ["strategy"], cfg.trading_days, cfg.cvar_alpha, more)


def subperiods(rows: DataFrame, study: Inputs, cfg: Config, least: int = 15) -> DataFrame:
    """strategy, regime and metrics of each named phase; rates are taken anew on the phase's calendar."""
    spark = rows.sparkSession
    phases = constants(spark, list(cfg.regimes), "regime string, a string, b string").select("regime", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    inside = rows.drop("rf").join(F.broadcast(phases), F.col("date").between(F.col("a"), F.col("b"))).drop("a", "b")
    keys = ["strategy", "regime"]
    return metrics.summary(with_rf(inside, study, cfg, keys), keys, cfg.trading_days, cfg.cvar_alpha).where(F.col("n") >= least)


def param_stability(study: Inputs, cfg: Config) -> DataFrame:
    """lookback, target, sharpe over the grid of lookbacks and targets, on one net base."""
    spark = study.returns.sparkSession
    bps = (1 - cfg.crypto_share) * 10.0 + cfg.crypto_share * 25.0
    grid = constants(spark, [(f"{n}/{v:g}", float(cfg.crypto_share), n, float(v), bps) for n in cfg.stability_lookbacks for v in cfg.stability_vols], "config_id string, share double, lookback int, target double, bps double")
    paths = strategies.control_grid(base(study, cfg), grid, ["share"], cfg.stability_lookbacks, cfg.trading_days, cfg.max_leverage, cfg.rebalance)
    return metrics.summary(paths, ["lookback", "target"], cfg.trading_days, cfg.cvar_alpha).select("lookback", "target", "sharpe")


def cost_sensitivity(study: Inputs, cfg: Config, target: float) -> DataFrame:
    """multiplier and metrics of the controlled strategy: exposure doesn't depend on cost, so one path is priced six times."""
    spark = study.returns.sparkSession
    path = controlled(study, cfg).where(F.col("target") == cfg.target(target))
    many = path.crossJoin(F.broadcast(constants(spark, [(float(m),) for m in cfg.cost_multipliers], "multiplier double")))
    priced = many.withColumn("r", F.col("gross") - F.col("cost") * F.col("multiplier"))
    return metrics.summary(priced, ["multiplier"], cfg.trading_days, cfg.cvar_alpha)


def gross_of(mix: DataFrame, pit: Builder | None):
    """The return before the base's own costs, but after those of a point-in-time sleeve, which are charged once everywhere."""
    return F.col("gross") if pit is None else F.col("gross") - F.col("sleeve_cost")


def crypto_sweep(study: Inputs, cfg: Config, target: float, pit: Builder | None = None) -> DataFrame:
    """share, d_mdd, d_cvar, sharpe_bh, sharpe_vc at every share, on the gross base."""
    spark = study.returns.sparkSession
    mix = base(study, cfg, cfg.sweep_shares(), pit)
    gross = mix.select("share", "date", gross_of(mix, pit).alias("r"), "rf")
    grid = [(f"{s:g}", float(s), cfg.lookback, float(target), (1 - s) * 10.0 + s * 25.0) for s in cfg.sweep_shares()]
    paths = strategies.control_grid(gross, constants(spark, grid, "config_id string, share double, lookback int, target double, bps double"), ["share"], [cfg.lookback], cfg.trading_days, cfg.max_leverage, cfg.rebalance)
    both = gross.withColumn("kind", F.lit("bh")).unionByName(paths.select("share", "date", "r", "rf", F.lit("vc").alias("kind")))
    m = metrics.summary(both, ["share", "kind"], cfg.trading_days, cfg.cvar_alpha)
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return m.groupBy("share").agg(
        (of("vc", "max_drawdown") - of("bh", "max_drawdown")).alias("d_mdd"),
        (of("vc", "cvar") - of("bh", "cvar")).alias("d_cvar"),
        of("bh", "sharpe").alias("sharpe_bh"),
        of("vc", "sharpe").alias("sharpe_vc"),
    )


def trials(study: Inputs, cfg: Config, target: float, pit: Builder | None = None) -> DataFrame:
    """config_id, share, lookback, target, date, r of every setting the study looks at, each once: the stability grid at
    the chosen share, and the sweep at the chosen target; the base is the daily mix, gross."""
    spark = study.returns.sparkSession
    keys = {(n, round(v, 6), round(cfg.crypto_share, 6)) for n in cfg.stability_lookbacks for v in cfg.stability_vols}
    keys |= {(cfg.lookback, round(target, 6), s) for s in cfg.sweep_shares()}
    grid = [(f"{n}/{v:g}/{s:g}", s, n, v, (1 - s) * 10.0 + s * 25.0) for n, v, s in sorted(keys)]
    shares = sorted({k[2] for k in keys})
    if pit is None:
        weights = strategies.class_weights(study.dim, shares_of(spark, shares))
        mix = with_rf(strategies.constant_mix(study.returns, weights, ["share"]), study, cfg, ["share"])
    else:
        mix = base(study, cfg, shares, pit)
        mix = mix.select("share", "date", gross_of(mix, pit).alias("r"), "rf")
    return strategies.control_grid(mix, constants(spark, grid, "config_id string, share double, lookback int, target double, bps double"), ["share"], sorted({k[0] for k in keys}), cfg.trading_days, cfg.max_leverage, cfg.rebalance)


def wealth_paths(rows: DataFrame, points: int = 400) -> DataFrame:
    """strategy, date, wealth (1 at the first date that all have), drawdown, exposure on the union calendar, every k-th date."""
    paths = metrics.with_paths(rows, ["strategy"]).select("strategy", "date", "wealth", "drawdown", "exposure")
    grid = on_calendar(paths, ["strategy"])
    filled = grid.select("strategy", "date", *[F.last(c, ignorenulls=True).over(so_far(["strategy"])).alias(c) for c in ("wealth", "drawdown", "exposure")])
    common = paths.groupBy("strategy").agg(F.min("date").alias("d")).agg(F.max("d").alias("common"))
    start = F.max(F.when(F.col("date") == F.col("common"), F.col("wealth"))).over(Window.partitionBy("strategy"))
    return strided(filled.crossJoin(F.broadcast(common)).withColumn("wealth", F.col("wealth") / start).drop("common"), ["strategy"], points)


def rolling_sharpe(rows: DataFrame, cfg: Config) -> DataFrame:
    """strategy, date, sharpe: mean excess over the deviation of raw returns, over full windows."""
    from ..functions.windows import ratio, rolling_mean, rolling_std

    excess = rolling_mean(F.col("r") - F.col("rf"), ["strategy"], cfg.rolling_window)
    value = ratio(excess, rolling_std(F.col("r"), ["strategy"], cfg.rolling_window)) * F.sqrt(F.lit(float(cfg.trading_days)))
    return rows.select("strategy", "date", value.alias("sharpe"))


def rolling_correlation(returns: DataFrame, dim: DataFrame, reference: str, window: int) -> DataFrame:
    """asset, date, corr of each crypto asset with the reference, over full windows."""
    from ..functions.windows import full, trailing

    crypto = returns.join(F.broadcast(dim.where("asset_class = 'crypto'").select("asset")), "asset", "left_semi")
    both = crypto.join(returns.where(F.col("asset") == reference).select("date", F.col("r").alias("ref")), "date")
    return both.select("asset", "date", full(F.corr("r", "ref").over(trailing(["asset"], window)), F.col("r"), ["asset"], window).alias("corr"))


def walk_forward(rows: DataFrame, cfg: Config, least: int = 200) -> tuple[DataFrame, DataFrame]:
    """Series of fewer than `least` dates have no folds. Folds (fold, first and last test date, chosen target, is_sharpe, oos_sharpe) and the joined out-of-sample rows.

    rows: the controlled strategies (strategy, target, date, r, rf). Fold k trains on all dates before its test
    dates; of equal Sharpe ratios the smaller target wins.
    """
    numbered = rows.withColumn("rn", F.row_number().over(dated(["strategy"])) - 1).withColumn("n", F.count("*").over(Window.partitionBy("strategy"))).where(F.col("n") >= least)
    folds = rows.sparkSession.range(cfg.folds).select(F.col("id").cast("int").alias("fold"))
    first = F.floor(F.col("n") * F.lit(cfg.train_share))
    bound = lambda k: F.floor(first + (F.col("n") - first) * k / cfg.folds)
    placed = numbered.crossJoin(F.broadcast(folds)).withColumn("t0", bound(F.col("fold"))).withColumn("t1", bound(F.col("fold") + 1))
    excess = F.col("r") - F.col("rf")
    inside = placed.where("rn < t0").groupBy("fold", "target").agg(F.avg(excess).alias("m"), F.stddev_samp(excess).alias("s"))
    inside = inside.withColumn("is_sharpe", F.when(F.col("s") != 0, F.col("m") / F.col("s") * F.sqrt(F.lit(float(cfg.trading_days)))))
    best = inside.where("is_sharpe is not null").groupBy("fold").agg(F.max(F.struct("is_sharpe", (-F.col("target")).alias("minus"))).alias("b"))
    chosen = best.select("fold", F.col("b.is_sharpe").alias("is_sharpe"), (-F.col("b.minus")).alias("target"))
    oos = placed.where("rn >= t0 and rn < t1 and t1 - t0 >= 10").join(F.broadcast(chosen), ["fold", "target"])
    sharpe = F.when(F.stddev_samp(excess) != 0, F.avg(excess) / F.stddev_samp(excess) * F.sqrt(F.lit(float(cfg.trading_days))))
    table = oos.groupBy("fold", "target", "is_sharpe").agg(F.min("date").alias("test_start"), F.max("date").alias("test_end"), F.count("*").alias("n"), sharpe.alias("oos_sharpe"))
    return table, oos.select("fold", "target", "date", "r", "rf")


def held_by_period(series: DataFrame, freq: str, keys=()) -> DataFrame:
    """date, held: the first value of x in each day, ISO week or month, held through it."""
    within = Window.partitionBy(*keys, period(freq)).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return series.withColumn("held", F.first("x", ignorenulls=True).over(within))


def rate_series(study: Inputs, cfg: Config) -> DataFrame:
    """date, rf (what the date's period earns), annualised (times trading_days), on the panel's calendar."""
    return with_rf(study.returns.select("date").distinct(), study, cfg).select("date", "rf", (F.col("rf") * cfg.trading_days).alias("annualised"))


def rate_window(study: Inputs) -> DataFrame:
    """One row: mean, least, largest and share below zero of the annual rates known on the panel's dates."""
    r = F.col("rf_annual")
    return study.known.agg(F.avg(r).alias("window_mean"), F.min(r).alias("window_min"), F.max(r).alias("window_max"), F.avg(F.when(r < 0, 1.0).otherwise(0.0)).alias("window_share_negative"))


def compare_samples(prices: DataFrame, specs: Sequence[SampleSpec], rates: DataFrame, dim: DataFrame, cfg: Config, target: float) -> DataFrame:
    """scenario, strategy and metrics of the base and of one controlled strategy in every sample, as one plan keyed by scenario."""
    spark = prices.sparkSession
    fixed = [s for s in specs if not s.point_in_time]
    parts = []
    if fixed:
        windows = constants(spark, [(s.name, s.start, s.end) for s in fixed], "scenario string, a string, b string").select("scenario", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
        inside = complete_case(prices, dim.count()).join(F.broadcast(windows), F.col("date").between(F.col("a"), F.col("b"))).select("scenario", "date", "asset", "price")
        weights = strategies.class_weights(dim, shares_of(spark, [cfg.crypto_share])).select("asset", "w")
        parts.append(strategies.held_weights(simple_returns(inside, ["scenario", "asset"]), weights, cfg.weight_rebalance, ["scenario"]).select("scenario", "date", "asset", "r", "w"))
    for spec in specs:
        if spec.point_in_time:
            found, pit = of_sample(prices, spec, rates, dim)
            path = pit(shares_of(spark, [cfg.crypto_share])).join(found.returns, ["date", "asset"], "left")
            parts.append(path.select(F.lit(spec.name).alias("scenario"), "date", "asset", "r", "w"))
    path = parts[0]
    for more in parts[1:]:
        path = path.unionByName(more)
    mix = strategies.with_turnover(strategies.together(path, ["scenario"]), dim, ["scenario"])
    known = as_of(prices.select("date").distinct(), rates, "rf_annual")
    mix = daily_rate(mix.withColumn("r", F.col("r") - F.col("cost")), known, cfg.trading_days, CONVENTIONS[cfg.rf_mode], cfg.rf_annual, ["scenario"], aligned=True)
    mix = mix.select("scenario", "date", "r", "rf", F.col("turnover").alias("sleeve")).persist()
    bps = (1 - cfg.crypto_share) * 10.0 + cfg.crypto_share * 25.0
    vc = strategies.vol_control(mix.withColumns({"target": F.lit(float(target)), "bps": F.lit(bps)}), ["scenario"], cfg.lookback, cfg.trading_days, cfg.max_leverage, cfg.rebalance, cfg.dead_band, cfg.vol_method, cfg.halflife)
    rows = mix.select("scenario", F.lit("BuyHold").alias("strategy"), "date", "r", "rf", F.col("sleeve").alias("turnover"))
    rows = rows.unionByName(vc.select("scenario", F.lit(f"VolControl_{target:g}").alias("strategy"), "date", "r", "rf", (F.col("turnover") + F.col("sleeve") * F.col("exposure")).alias("turnover")))
    return metrics.summary(rows, ["scenario", "strategy"], cfg.trading_days, cfg.cvar_alpha, (F.sum("turnover").alias("turnover"),))


def start_sensitivity(table: DataFrame) -> DataFrame:
    """scenario, and Sharpe ratio, growth and drawdown of both strategies of compare_samples side by side, with their differences."""
    of = lambda kind, c: F.max(F.when(F.col("strategy").startswith(kind), F.col(c)))
    names = ("sharpe", "cagr", "max_drawdown")
    wide = table.groupBy("scenario").agg(F.max("n").alias("n"), *[of(kind, c).alias(f"{short}_{c}") for short, kind in (("vc", "VolControl"), ("bh", "BuyHold")) for c in names])
    return wide.withColumn("d_sharpe", F.col("vc_sharpe") - F.col("bh_sharpe")).withColumn("d_mdd", F.col("vc_max_drawdown") - F.col("bh_max_drawdown"))
