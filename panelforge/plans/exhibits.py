"""The study's table exhibits: projections of its results, each with a title, labels and formats, and the job that writes them all.

A table is a DataFrame of plain columns until it is shown; labels and number formats are data (see sources.exhibits). The study's long tables are
settled once, as most exhibits read them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.tables import settled
from ..operators import metrics
from ..sources.exhibits import NOTHING, Shown, interval, write_exhibit, write_register
from ..sources.panel import rate_summary
from . import hypotheses, sample, study

#: Columns that several exhibits show.
RETURN, GROWTH, VOL = Shown("ann_return", "Return p.a.", 2, True), Shown("cagr", "CAGR", 2, True), Shown("ann_vol", "Vol p.a.", 2, True)
SHARPE, FALL, TAIL = Shown("sharpe", "Sharpe", 3), Shown("max_drawdown", "Max. drawdown", 2, True), Shown("cvar", "CVaR 95 %", 2, True)
COUNT = Shown("n", "N", 0)


@dataclass(frozen=True)
class Exhibit:
    ident: str
    chapter: str
    title: str
    source: str
    table: DataFrame
    shown: Sequence[Shown]
    order: Sequence[str | Column]
    note: str = ""


def attributes(table: DataFrame, shown: Sequence[Shown]) -> DataFrame:
    """place, attribute, value of a table of one row, each value shown in its own way."""
    from ..sources.exhibits import _text

    rows = [F.struct(F.lit(i).alias("place"), F.lit(s.label).alias("attribute"), _text(s).alias("value")) for i, s in enumerate(shown)]
    return table.select(F.inline(F.array(*rows)))


_PAIR = (Shown("attribute", "Attribute"), Shown("value", "Value"))


def tables(s: study.Inputs, prices: DataFrame, cfg: Config, target: float, specs: Sequence[sample.SampleSpec] = (), pit: study.Builder | None = None) -> list[Exhibit]:
    """Every table exhibit of a study over daily or weekly prices; specs: the samples that are compared, if any."""
    chosen = f"VolControl_{cfg.target(target):g}"
    rows = settled(study.run_strategies(s, cfg, pit))
    table, assets = settled(study.metrics_table(rows, cfg)), settled(metrics.describe_assets(prices, cfg.rf_annual, cfg.cvar_alpha))
    tests = settled(hypotheses.report(s, cfg, target, pit))
    out = [
        Exhibit("tab_3_1", "3", "Assets and their data", "describe_assets", assets, [Shown("asset", "Asset"), Shown("first", "First price"), Shown("last", "Last price"), COUNT, Shown("trading_days", "Periods a year", 0)], ["asset"], "Each asset on its own calendar."),
        Exhibit("tab_3_3", "3", "Distribution of the assets' returns", "describe_assets", assets, [Shown("asset", "Asset"), RETURN, VOL, SHARPE, Shown("skew", "Skewness", 2), Shown("excess_kurtosis", "Excess kurtosis", 2), FALL, Shown("var", "VaR 95 %", 2, True), TAIL, COUNT], ["asset"], "A normal distribution has an excess kurtosis of 0."),
        Exhibit("tab_3_4", "3", "Rate on cash", "rate_summary, rate_window", attributes(rate_summary(s.rates).crossJoin(study.rate_window(s)), [Shown("n", "Fixings", 0), Shown("first", "First fixing"), Shown("last", "Last fixing"), Shown("mean", "Mean", 4, True), Shown("window_mean", "Mean in the window", 4, True), Shown("window_min", "Lowest in the window", 4, True), Shown("window_max", "Highest in the window", 4, True), Shown("window_share_negative", "Share below zero", 1, True)]), _PAIR, ["place"]),
        Exhibit("tab_4_1", "4", "Metrics of the strategies", "metrics_table", table, [Shown("strategy", "Strategy"), RETURN, GROWTH, VOL, SHARPE, FALL, TAIL, Shown("turnover", "Turnover", 2), COUNT], ["strategy"], "Net of costs. The turnover of a controlled strategy is that of its exposure and its part of the base's."),
        Exhibit("tab_4_2", "4", "Base and control by crypto share", "crypto_sweep", study.crypto_sweep(s, cfg, target, pit), [Shown("share", "Crypto share", 1, True), Shown("d_mdd", "Change of drawdown", 2, True), Shown("d_cvar", "Change of CVaR", 2, True), Shown("sharpe_bh", "Sharpe, base", 3), Shown("sharpe_vc", "Sharpe, control", 3)], ["share"]),
        _turnover(table),
        _confirmed(tests),
        Exhibit("tab_4_5", "4", "Effect of the crypto share (data level)", "sweep_bootstrap", _of(tests, "H3"), [Shown("name", "Outcome"), Shown("estimate", "Slope", 6), Shown("interval", "95 % interval"), Shown("p", "p", 6)], ["name"]),
        Exhibit("tab_4_6", "4", "Probabilistic and deflated Sharpe ratio", "probabilistic_sharpe, deflated_sharpe", tests.where(F.col("name").endswith("Sharpe ratio") & ~F.col("name").startswith("H2")), [Shown("name", "Measure"), Shown("estimate", "Value", 6)], ["name"], "Trials are all settings that the study looks at."),
        _rates(s, cfg, table, pit, chosen),
        _folds(s, cfg),
        _regimes(s, cfg, rows, chosen),
        Exhibit("tab_4_12", "4", f"Monthly returns of {chosen}", "month_matrix", metrics.month_matrix(metrics.monthly_returns(rows.where(F.col("strategy") == chosen), ["strategy"]), ["strategy"]), [Shown("year", "Year"), *[Shown(str(m), str(m), 2, True) for m in range(1, 13)], Shown("annual", "Year's", 2, True)], ["year"]),
        Exhibit("tab_4_13", "4", "Exposure of the controlled strategies", "exposure_stats", metrics.exposure_stats(rows.where("exposure is not null").drop("turnover"), ["strategy"], cfg.max_leverage), [Shown("strategy", "Strategy"), Shown("share_at_cap", "At the cap", 1, True), Shown("mean", "Mean", 1, True), Shown("sd", "Deviation", 1, True), Shown("share_changed", "Dates with a trade", 1, True), Shown("turnover", "Turnover", 2)], ["strategy"]),
    ]
    return out + (_samples(prices, s, cfg, target, specs) if specs else [])


def _of(tests: DataFrame, start: str, digits: int = 6) -> DataFrame:
    return tests.where(F.col("name").startswith(start)).withColumn("interval", interval("low", "high", digits))


def _turnover(table: DataFrame) -> Exhibit:
    base = table.where("strategy = 'BuyHold'").select(F.col("turnover").alias("base"))
    parts = table.where("strategy = 'BuyHold' or turnover_exposure > 0").crossJoin(F.broadcast(base)).withColumn("ratio", F.col("turnover") / F.col("base"))
    return Exhibit("tab_4_3", "4", "Turnover in its parts", "metrics_table", parts, [Shown("strategy", "Strategy"), Shown("turnover", "All", 4), Shown("turnover_exposure", "Exposure", 4), Shown("turnover_sleeve", "Base", 4), Shown("ratio", "To buy and hold", 2)], ["strategy"])


def _confirmed(tests: DataFrame) -> Exhibit:
    found = _of(tests, "H1", 4).unionByName(_of(tests, "H2", 4)).withColumn("verdict", F.when(F.col("p_holm") < 0.05, "significant").otherwise("not significant"))
    shown = [Shown("name", "Hypothesis"), Shown("estimate", "Difference", 4), Shown("interval", "BCa interval 95 %"), Shown("p", "p", 4), Shown("p_holm", "p (Holm)", 4), Shown("verdict", "Verdict")]
    return Exhibit("tab_4_4", "4", "Confirmatory tests", "hypothesis_tests", found, shown, ["name"], "Paired stationary block bootstrap; Holm over four tests.")


def _rates(s: study.Inputs, cfg: Config, table: DataFrame, pit: study.Builder | None, chosen: str) -> Exhibit:
    flat = study.metrics_table(study.run_strategies(s, replace(cfg, rf_mode="constant"), pit), cfg)
    names = ("ann_return", "cagr", "ann_vol", "sharpe", "max_drawdown", "cvar")
    long = lambda df, name: df.where(F.col("strategy").isin("BuyHold", chosen)).unpivot(["strategy"], list(names), "metric", name)
    both = long(table, "series").join(long(flat, "constant"), ["strategy", "metric"]).withColumn("difference", F.col("constant") - F.col("series"))
    return Exhibit("tab_4_9", "4", "Sensitivity to the rate", "metrics_table under two rates", both, [Shown("strategy", "Strategy"), Shown("metric", "Metric"), Shown("series", "Fixings", 4), Shown("constant", f"Constant {cfg.rf_annual:.0%}", 4), Shown("difference", "Difference", 4)], ["strategy", "metric"])


def _folds(s: study.Inputs, cfg: Config) -> Exhibit:
    folds = study.walk_forward(study.controlled(s, cfg), cfg, 100)[0].withColumn("window", F.concat_ws(" – ", "test_start", "test_end"))
    return Exhibit("tab_4_10", "4", "Walk-forward", "walk_forward", folds, [Shown("window", "Out of sample"), Shown("target", "Target", 1, True), Shown("is_sharpe", "In-sample Sharpe", 3), Shown("oos_sharpe", "Out-of-sample Sharpe", 3)], ["fold"], "The in-sample ratio is the best of several targets, and so not comparable.")


def _regimes(s: study.Inputs, cfg: Config, rows: DataFrame, chosen: str) -> Exhibit:
    found = study.subperiods(rows.where(F.col("strategy").isin("BuyHold", chosen)), s, cfg)
    of = lambda name, c: F.max(F.when(F.col("strategy") == name, F.col(c)))
    wide = found.groupBy("regime").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("n").alias("n"), *[of(name, c).alias(f"{short}_{c}") for short, name in (("bh", "BuyHold"), ("vc", chosen)) for c in ("cagr", "max_drawdown", "sharpe")])
    shown = [Shown("regime", "Phase"), Shown("first", "From"), Shown("last", "To"), COUNT, *[Shown(f"{k}_{c}", f"{label} {k.upper()}", digits, percent) for c, label, digits, percent in (("cagr", "CAGR", 2, True), ("max_drawdown", "Max. drawdown", 2, True), ("sharpe", "Sharpe", 3, False)) for k in ("bh", "vc")]]
    return Exhibit("tab_4_11", "4", "Results by market phase", "subperiods", wide, shown, ["first"])


def _samples(prices: DataFrame, s: study.Inputs, cfg: Config, target: float, specs: Sequence[sample.SampleSpec]) -> list[Exhibit]:
    reports = [sample.report(prices, sample.resolve(prices, spec, s.dim), spec).withColumn("basket", F.lit("point in time" if spec.point_in_time else "fixed")) for spec in specs]
    designs = hypotheses._union(reports)
    found = settled(hypotheses.over_samples(prices, list(specs), s.rates, s.dim, cfg, target))
    found = found.withColumns({f"{k}_interval": interval(f"{k}_low", f"{k}_high", 4) for k in ("h1", "h2", "slope")})
    shown = [Shown("scenario", "Sample"), COUNT, *[x for k, label in (("h1", "H1 drawdown"), ("h2", "H2 Sharpe"), ("slope", "H3 slope")) for x in (Shown(f"{k}_estimate", label, 4), Shown(f"{k}_interval", f"{label}, 95 %"))], Shown("best_share", "Best share", 2, True)]
    late = F.col("scenario").startswith("S4_")
    out = [Exhibit("tab_3_2", "3", "Samples", "sample_report", designs, [Shown("scenario", "Sample"), Shown("effective_start", "From"), Shown("effective_end", "To"), Shown("n_price_rows", "Dates with prices", 0), Shown("n_return_rows", "Dates with returns", 0), Shown("basket", "Basket")], ["scenario"])]
    out.append(Exhibit("tab_4_7", "4", "Findings by sample", "over_samples", found.where(~late), shown, ["scenario"]))
    return [*out, Exhibit("tab_4_8", "4", "Sensitivity to the first year", "over_samples", found.where(late), shown, ["scenario"])]


def write_all(exhibits: Sequence[Exhibit], folder: str, run_hash: str, scenario: str = "S1", environment: dict[str, str] | None = None) -> DataFrame:
    """Writes every exhibit and the register of them; environment (see sinks.provenance) is an exhibit of its own. Returns the register."""
    entries = [write_exhibit(e.table, folder, e.ident, e.title, e.order, run_hash, scenario, e.source, e.note, e.chapter, e.shown) for e in exhibits]
    spark = exhibits[0].table.sparkSession
    if environment:
        facts = spark.createDataFrame([(k, str(v) or NOTHING) for k, v in environment.items()], "attribute string, value string")
        entries.append(write_exhibit(facts, folder, "tab_a_1", "What made these results", ["attribute"], run_hash, scenario, "provenance", "", "A", list(_PAIR)))
    return write_register(spark, entries, folder)
