"""The registered queries over the canonical panel, each beside its SQL where SQL can express it."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import replace
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ASSETS, Config
from ..functions import archives, hashing
from ..functions.tables import constants
from ..operators import alignment, bootstrap, metrics, riskfree, statistics, strategies
from ..sources.panel import asset_dim, price_panel, rate_summary, rf_fixings
from . import hypotheses, oracle, request, sample, study
from .oracle import number, numbers

CFG = Config()
TARGET = 0.30
BAND = 0.1
Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, digits: int = 6):
    """Registers a query; its doubles are rounded, as those of its SQL are."""

    def keep(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        _found[f.__name__] = (run, sql)
        return f

    return keep


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}


def _base_weights(spark: SparkSession, s: study.Inputs) -> DataFrame:
    return strategies.class_weights(s.dim, study.shares_of(spark, [CFG.crypto_share])).drop("share")


@query(f"WITH {oracle.STRATEGIES},\n{oracle.summary('m', 'rows', 'strategy')}\nSELECT strategy, n, first, last, {numbers(oracle.SUMMARY)}, {numbers('turnover turnover_exposure turnover_sleeve ann_return_gross cagr_gross sharpe_gross')}\n"
       f"FROM m JOIN (SELECT strategy, sum(turnover_exposure + turnover_sleeve) AS turnover, sum(turnover_exposure) AS turnover_exposure, sum(turnover_sleeve) AS turnover_sleeve, avg(gross) * {CFG.trading_days} AS ann_return_gross, "
       f"CASE WHEN product(1 + gross) <= 0 THEN -1.0 ELSE power(product(1 + gross), {CFG.trading_days}.0::DOUBLE / count(*)) - 1 END AS cagr_gross, CASE WHEN stddev_samp(gross - rf) <> 0 THEN avg(gross - rf) / stddev_samp(gross - rf) * sqrt({CFG.trading_days}.0::DOUBLE) END AS sharpe_gross FROM rows GROUP BY strategy) USING (strategy)")
def metrics_table(spark, sf_dir):
    """Every strategy's metrics: the study's headline."""
    return study.metrics_table(study.run_strategies(study.inputs(spark, sf_dir), CFG), CFG)


#: A request that differs from the study in sample, split, target and rate mode.
ASKED = request.Request(scenario="S3", target_vol=0.45, traditional_weights=(("AF", 0.5), ("NF", 0.5)), rf_mode="constant")
LIMITED = replace(CFG, mdd_limit=-0.5, cvar_limit=-0.2)


def _asked_sql() -> str:
    """The metrics table's SQL under ASKED and LIMITED."""
    spec, own = ASKED.spec(), dict(ASKED.traditional_weights)
    dim = "dim(asset, asset_class, base_weight, cost_bps) AS (VALUES " + ", ".join(f"('{a}', '{c}', {own.get(a, 0.0)}::DOUBLE, {b}::DOUBLE)" for a, c, _, b in ASSETS) + ")"
    vols = sorted({*CFG.target_vols, ASKED.target_vol})
    targets = "targets AS (SELECT * FROM (VALUES " + ", ".join(f"('VolControl_{v:g}', {v}::DOUBLE)" for v in vols) + ") t(strategy, target))"
    sql = _found["metrics_table"][1].replace(oracle.DIM, dim).replace(oracle.TARGETS, targets)
    sql = sql.replace(oracle.COMPLETE, oracle.COMPLETE[:-1] + f" AND date BETWEEN DATE '{spec.start}' AND DATE '{spec.end}')")
    sql = re.sub(r"rate \* coalesce\(gap, quantile_cont\(gap, 0\.5\) OVER \(PARTITION BY [^)]*\)\) / 360 AS rf", f"{CFG.rf_annual}::DOUBLE / {CFG.trading_days} AS rf", sql)
    return f"SELECT *, coalesce(max_drawdown < {LIMITED.mdd_limit}, false) AS mdd_breach, coalesce(cvar < {LIMITED.cvar_limit}, false) AS cvar_breach FROM ({sql})"


@query(_asked_sql())
def requested_backtest(spark, sf_dir):
    """A request from its checks to its metrics."""
    return request.backtest(ASKED, {"frozen": lambda: price_panel(spark, sf_dir)}, rf_fixings(spark, sf_dir).persist(), LIMITED)


@query(f"WITH {oracle.panel()} SELECT date, asset, {number('price')} FROM panel")
def weekly_panel(spark, sf_dir):
    return price_panel(spark, sf_dir)


@query(f"WITH {oracle.panel('day')}, {oracle.COMPLETE} SELECT date, asset, {number('price')} FROM cc")
def complete_case(spark, sf_dir):
    return alignment.complete_case(price_panel(spark, sf_dir, "daily"), 6)


@query(f"WITH {oracle.study()} SELECT date, asset, {number('r')} FROM ret")
def simple_returns(spark, sf_dir):
    return study.inputs(spark, sf_dir).returns


@query(f"WITH {oracle.study()}, {oracle.weights()} SELECT date, {number('sum(w * r)', 'r')} FROM ret JOIN w USING (asset) GROUP BY date")
def constant_mix(spark, sf_dir):
    s = study.inputs(spark, sf_dir)
    return strategies.constant_mix(s.returns, _base_weights(spark, s))


@query(f"WITH {oracle.study()}, {oracle.weights()}, {oracle.TRUE_BH} SELECT date, {number('r')} FROM tbh")
def true_buy_and_hold(spark, sf_dir):
    s = study.inputs(spark, sf_dir)
    return strategies.true_buy_and_hold(s.returns, _base_weights(spark, s))


def _mix(freq: str, unit: str):
    sql = f"WITH {oracle.study()}, {oracle.weights()}, {oracle.held(unit=unit)}, {oracle.turnover('mix', 'held', 'share')} SELECT date, {numbers('gross turnover cost r')} FROM mix"

    def f(spark, sf_dir):
        s = study.inputs(spark, sf_dir)
        return strategies.periodic_mix(s.returns, _base_weights(spark, s), s.dim, freq)

    f.__name__ = f"periodic_mix_{freq}"
    return query(sql)(f)


periodic_mix_monthly, periodic_mix_quarterly = _mix("monthly", "month"), _mix("quarterly", "quarter")


@query(f"WITH {oracle.study()}, {oracle.weights()} SELECT date, asset, {number('g / sum(g) OVER (PARTITION BY date)', 'w')} FROM (SELECT date, asset, w * (1 + r) AS g FROM ret JOIN w USING (asset))")
def drifted_weights(spark, sf_dir):
    s = study.inputs(spark, sf_dir)
    return strategies.drifted_weights(s.returns, _base_weights(spark, s)).select("date", "asset", "w")


@query(f"""WITH {oracle.study()}, {oracle.weights()}, {oracle.held()},
ends AS (SELECT *, w * (1 + r) / sum(w * (1 + r)) OVER (PARTITION BY date) AS e FROM held),
lagged AS (SELECT *, lag(e) OVER (PARTITION BY asset ORDER BY date) AS last, date_trunc('month', date) <> date_trunc('month', lag(date) OVER (PARTITION BY asset ORDER BY date)) AS resets FROM ends)
SELECT date, {number("sum(CASE WHEN resets THEN abs(w.w - last) ELSE 0 END)", "traded")} FROM lagged JOIN w USING (asset) GROUP BY date""")
def traded_turnover(spark, sf_dir):
    s = study.inputs(spark, sf_dir)
    return strategies.traded_turnover(s.returns, _base_weights(spark, s), "monthly")


@query(f"WITH {oracle.study()} SELECT asset, date, {number(f'CASE WHEN count(r) OVER o = {CFG.lookback} THEN stddev_samp(r) OVER o * sqrt({CFG.trading_days}.0::DOUBLE) END', 'vol')} FROM ret WINDOW o AS (PARTITION BY asset ORDER BY date ROWS BETWEEN {CFG.lookback - 1} PRECEDING AND CURRENT ROW)")
def rolling_vol(spark, sf_dir):
    r = study.inputs(spark, sf_dir).returns
    return strategies.realised_vol(r, ["asset"], "rolling", CFG.lookback, CFG.trading_days, name="vol").select("asset", "date", "vol")


_DECAY = f"power(0.5::DOUBLE, (n - m) / {CFG.halflife}.0::DOUBLE)"


@query(f"""WITH {oracle.study()}, numbered AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) AS n FROM ret),
sums AS (SELECT a.asset, a.date, a.n, sum(d) AS s0, sum(d * d) AS s00, sum(d * x) AS s1, sum(d * x * x) AS s2
  FROM (SELECT a.asset, a.date, a.n, {_DECAY.replace('n - m', 'a.n - b.n')} AS d, b.r AS x FROM numbered a JOIN numbered b ON a.asset = b.asset AND b.n <= a.n AND a.n - b.n <= {60 * CFG.halflife}) a GROUP BY 1, 2, 3)
SELECT asset, date, {number(f"CASE WHEN n >= {max(5, CFG.halflife)} THEN sqrt(greatest((s2 / s0 - (s1 / s0) * (s1 / s0)) * s0 * s0 / (s0 * s0 - s00), 0)) * sqrt({CFG.trading_days}.0::DOUBLE) END", "vol")} FROM sums""")
def ewma_vol(spark, sf_dir):
    r = study.inputs(spark, sf_dir).returns
    return strategies.realised_vol(r, ["asset"], "ewma", CFG.lookback, CFG.trading_days, CFG.halflife, "vol").select("asset", "date", "vol")


@query(f"WITH {oracle.study()}, cal AS (SELECT DISTINCT 1 AS k, date FROM ret), {oracle.rf('x', 'cal', 'k')} SELECT date, {number('rf', None, 8)} FROM x", digits=8)
def rf_act360(spark, sf_dir):
    s = study.inputs(spark, sf_dir)
    return riskfree.daily_rate(alignment.calendar(s.returns), s.rates, CFG.trading_days)


@query(f"WITH {oracle.study()}, cal AS (SELECT DISTINCT date FROM ret) SELECT cal.date, {number(f'coalesce(fix.rf_annual, (SELECT arg_min(rf_annual, date) FROM fix)) / {CFG.trading_days}', 'rf', 8)} FROM cal ASOF LEFT JOIN fix ON cal.date >= fix.date", digits=8)
def rf_simple(spark, sf_dir):
    s = study.inputs(spark, sf_dir)
    return riskfree.daily_rate(alignment.calendar(s.returns), s.rates, CFG.trading_days, "simple")


@query(f"WITH {oracle.FIXINGS} SELECT count(*)::BIGINT AS n, min(date) AS first, max(date) AS last, {number('avg(rf_annual)', 'mean', 8)}, {number('min(rf_annual)', 'lowest', 8)}, {number('max(rf_annual)', 'highest', 8)}, {number('avg(CASE WHEN rf_annual < 0 THEN 1.0::DOUBLE ELSE 0 END)', 'share_negative', 8)} FROM fix", digits=8)
def rf_meta(spark, sf_dir):
    return rate_summary(rf_fixings(spark, sf_dir))


def _held(freq: str, unit: str):
    sql = f"""WITH {oracle.study('day')}, one AS (SELECT date, avg(r) AS r FROM ret GROUP BY date),
x AS (SELECT date, abs(r) AS x FROM one)
SELECT date, {number('x')}, {number(f"first_value(x) OVER (PARTITION BY date_trunc('{unit}', date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", 'held')} FROM x"""

    def f(spark, sf_dir):
        r = study.inputs(spark, sf_dir, "daily").returns
        return study.held_by_period(r.groupBy("date").agg(F.abs(F.avg("r")).alias("x")), freq)

    f.__name__ = f"exposure_{freq}"
    return query(sql)(f)


exposure_weekly, exposure_monthly = _held("weekly", "week"), _held("monthly", "month")


@query(f"WITH {oracle.VC} SELECT strategy, target, date, {number('r')}, {number('vc_gross', 'gross')}, {number('vc_cost', 'cost')}, {number('exposure')} FROM vc")
def vol_control(spark, sf_dir):
    return study.controlled(study.inputs(spark, sf_dir), CFG).select("strategy", "target", "date", "r", "gross", "cost", "exposure")


@query(f"""WITH RECURSIVE {oracle.VC},
n AS MATERIALIZED (SELECT v.strategy, v.date, v.exposure AS e, i.r, i.rf, i.bps, row_number() OVER (PARTITION BY v.strategy ORDER BY v.date) AS k FROM vc v JOIN vin i USING (strategy, date)),
h AS (SELECT strategy, k, e AS held FROM n WHERE k = 1
  UNION ALL SELECT n.strategy, n.k, CASE WHEN abs(n.e - h.held) < {BAND}::DOUBLE THEN h.held ELSE n.e END FROM h JOIN n ON n.strategy = h.strategy AND n.k = h.k + 1),
x AS (SELECT n.*, held, abs(held - coalesce(lag(held) OVER (PARTITION BY n.strategy ORDER BY n.date), 0)) AS move FROM n JOIN h USING (strategy, k))
SELECT strategy, date, {number('held', 'exposure')}, {number('held * r + (1 - held) * rf - move * bps / 1e4', 'r')} FROM x""")
def dead_band(spark, sf_dir):
    """Volatility control with a dead band: a change below BAND is not traded."""
    cfg = replace(CFG, dead_band=BAND)
    return study.controlled(study.inputs(spark, sf_dir), cfg).select("strategy", "date", "exposure", "r")


@query(f"WITH {oracle.study()}, {oracle.PARITY} SELECT date, asset, {number('w')} FROM rp")
def risk_parity(spark, sf_dir):
    return strategies.risk_parity(study.inputs(spark, sf_dir).returns, CFG.parity_lookback).select("date", "asset", "w")


@query(f"WITH {oracle.study()}, v AS (SELECT asset, 1 / stddev_samp(r) AS i FROM ret GROUP BY asset HAVING stddev_samp(r) > 0) SELECT asset, {number('i / sum(i) OVER ()', 'w')} FROM v")
def inverse_vol(spark, sf_dir):
    return strategies.inverse_vol_weights(study.inputs(spark, sf_dir).returns)


@query(f"WITH {oracle.STRATEGIES} SELECT strategy, date, {numbers('r gross exposure turnover_exposure turnover_sleeve rf')} FROM rows")
def strategy_returns(spark, sf_dir):
    return study.run_strategies(study.inputs(spark, sf_dir), CFG).drop("turnover")


@query(f"WITH {oracle.STRATEGIES},\n{oracle.summary('m', 'rows', 'strategy')}\nSELECT strategy, {numbers('max_drawdown cvar')}, coalesce(max_drawdown < -0.5, false) AS mdd_breach, coalesce(cvar < -0.2, false) AS cvar_breach FROM m")
def limit_flags(spark, sf_dir):
    rows = study.run_strategies(study.inputs(spark, sf_dir), CFG)
    m = metrics.summary(rows, ["strategy"], CFG.trading_days, CFG.cvar_alpha)
    return metrics.limit_flags(m, -0.5, -0.2).select("strategy", "max_drawdown", "cvar", "mdd_breach", "cvar_breach")


_M = f"""WITH {oracle.panel('day')}, own AS (SELECT asset, date, price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM panel WHERE price IS NOT NULL),
span AS (SELECT asset, min(date) AS first, max(date) AS last FROM panel WHERE price IS NOT NULL GROUP BY asset), rr AS (SELECT * FROM own WHERE r IS NOT NULL), {oracle.paths('p', 'rr', 'asset')},
q AS (SELECT *, quantile_cont(r, 0.05) OVER (PARTITION BY asset) AS var, avg(r) OVER (PARTITION BY asset) AS mu FROM p),
d AS (SELECT asset, count(r)::BIGINT AS n, avg(r) AS mean, stddev_samp(r) AS sd, avg((r - mu) ** 3) / power(avg((r - mu) ** 2), 1.5::DOUBLE) AS skew, avg((r - mu) ** 4) / power(avg((r - mu) ** 2), 2) - 3 AS excess_kurtosis,
  min(drawdown) AS max_drawdown, any_value(var) AS var, avg(r) FILTER (r <= var) AS cvar, max(r) AS best, min(r) AS worst, avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) AS pct_positive FROM q GROUP BY asset),
t AS (SELECT *, least(greatest(round_even(n / greatest(date_diff('day', first, last) / 365.25::DOUBLE, 1e-9), 0), 200), 366)::DOUBLE AS trading_days FROM d JOIN span USING (asset) WHERE n >= 3)
SELECT asset, n, first, last, {numbers('trading_days skew excess_kurtosis max_drawdown var cvar best worst pct_positive')}, {number('mean * trading_days', 'ann_return')}, {number('sd * sqrt(trading_days)', 'ann_vol')},
  {number(f'(mean - {CFG.rf_annual}::DOUBLE / trading_days) / sd * sqrt(trading_days)', 'sharpe')} FROM t"""


@query(_M)
def describe_assets(spark, sf_dir):
    """Every asset on its own daily calendar."""
    return metrics.describe_assets(price_panel(spark, sf_dir, "daily"), CFG.rf_annual, CFG.cvar_alpha)


@query(f"WITH {oracle.study()} SELECT x.asset AS a, y.asset AS b, {number('corr(x.r, y.r)', 'corr')} FROM ret x JOIN ret y USING (date) GROUP BY 1, 2")
def correlation_matrix(spark, sf_dir):
    return metrics.correlation_matrix(study.inputs(spark, sf_dir).returns)


@query(f"WITH {oracle.study()}, y AS (SELECT asset, year(date)::INTEGER AS year, count(r)::BIGINT AS n, product(1 + r) AS g FROM ret GROUP BY 1, 2) SELECT asset, year, n, {number('CASE WHEN n >= 10 THEN g - 1 END', 'total')}, {number('product(g) OVER (PARTITION BY asset ORDER BY year DESC ROWS UNBOUNDED PRECEDING) - 1', 'since')} FROM y")
def calendar_returns(spark, sf_dir):
    return metrics.calendar_returns(study.inputs(spark, sf_dir).returns)


@query(f"WITH {oracle.study()} SELECT asset, year(date)::INTEGER AS year, month(date)::INTEGER AS month, {number('product(1 + r) - 1', 'total')} FROM ret GROUP BY GROUPING SETS ((asset, year(date), month(date)), (asset, year(date)))")
def monthly_rollup(spark, sf_dir):
    return metrics.monthly_returns(study.inputs(spark, sf_dir).returns, ["asset"])


@query(f"WITH {oracle.study()}, m AS (SELECT asset, year(date)::INTEGER AS year, month(date) AS month, product(1 + r) - 1 AS t FROM ret GROUP BY 1, 2, 3) SELECT asset, year, "
       + ", ".join(number(f"max(t) FILTER (month = {i})", f'"{i}"') for i in range(1, 13)) + f", {number('product(1 + t) - 1', 'annual')} FROM m GROUP BY asset, year")
def month_matrix(spark, sf_dir):
    return metrics.month_matrix(metrics.monthly_returns(study.inputs(spark, sf_dir).returns, ["asset"]), ["asset"])


@query(f"WITH {oracle.study()}, s AS (SELECT asset, min(date) AS first, max(date) AS last, count(DISTINCT date)::BIGINT AS n FROM ret GROUP BY asset) SELECT *, first > make_date(year(first), 1, 5) AS first_partial, last < make_date(year(last), 12, 25) AS last_partial FROM s")
def sample_window(spark, sf_dir):
    return metrics.partial_years(metrics.sample_window(study.inputs(spark, sf_dir).returns, ["asset"]))


_PHASES = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in CFG.regimes)


@query(f"""WITH {oracle.STRATEGIES}, phases(regime, a, b) AS (VALUES {_PHASES}),
cut AS (SELECT strategy || '/' || regime AS k, strategy, regime, date, r FROM rows JOIN phases ON date BETWEEN a AND b),
{oracle.rf('own', 'cut', 'k')}, {oracle.summary('m', 'own', 'strategy, regime')}
SELECT strategy, regime, n, first, last, {numbers(oracle.SUMMARY)} FROM m WHERE n >= 15""")
def subperiods(spark, sf_dir):
    s = study.inputs(spark, sf_dir)
    return study.subperiods(study.run_strategies(s, CFG), s, CFG)


@query(f"""WITH {oracle.STRATEGIES}, {oracle.paths('p', 'rows', 'strategy')},
i AS (SELECT *, sum(CASE WHEN drawdown >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS island, lead(date) OVER (PARTITION BY strategy ORDER BY date) AS next FROM p),
u AS (SELECT strategy, island, min(date) AS start, arg_min(date, drawdown) AS trough, arg_max_null(next, date) AS recovery, min(drawdown) AS depth, count(*)::BIGINT AS periods FROM i WHERE drawdown < 0 GROUP BY 1, 2)
SELECT * FROM (SELECT strategy, start, trough, recovery, {number('depth')}, periods, row_number() OVER (PARTITION BY strategy ORDER BY u.depth, start)::INTEGER AS rank FROM u) WHERE rank <= 5""")
def drawdown_episodes(spark, sf_dir):
    return metrics.drawdown_episodes(study.run_strategies(study.inputs(spark, sf_dir), CFG), ["strategy"])


@query(f"""WITH {oracle.STRATEGIES}, two_s AS (SELECT * FROM rows WHERE strategy IN ('BuyHold', 'VolControl_0.3')),
e AS (SELECT min(lo) AS lo, max(hi) AS hi FROM (SELECT quantile_cont(r, 0.005) AS lo, quantile_cont(r, 0.995) AS hi FROM two_s GROUP BY strategy)),
b AS (SELECT strategy, lo, (hi - lo) / 41 AS width, least(floor((r - lo) / ((hi - lo) / 41)), 40)::INTEGER AS bin FROM two_s, e WHERE r BETWEEN lo AND hi),
c AS (SELECT strategy, bin, lo, width, count(*)::BIGINT AS n FROM b GROUP BY ALL)
SELECT strategy, bin, {number('lo + bin * width', 'lower')}, {number('lo + (bin + 1) * width', 'upper')}, n, {number('n / sum(n) OVER (PARTITION BY strategy) / width', 'density')} FROM c""")
def return_distribution(spark, sf_dir):
    rows = study.run_strategies(study.inputs(spark, sf_dir), CFG).where("strategy in ('BuyHold', 'VolControl_0.3')")
    return metrics.return_distribution(rows, ["strategy"])


@query(f"""WITH {oracle.VC}, x AS (SELECT *, abs(exposure - lag(exposure) OVER (PARTITION BY strategy ORDER BY date)) AS d FROM vc)
SELECT strategy, {number('avg(CASE WHEN exposure >= 1 - 1e-12 THEN 1.0::DOUBLE ELSE 0 END)', 'share_at_cap')}, {number('avg(exposure)', 'mean')}, {number('stddev_samp(exposure)', 'sd')}, {number('avg(d)', 'mean_change')}, {number('avg(CASE WHEN d > 1e-12 THEN 1.0::DOUBLE ELSE 0 END)', 'share_changed')}, {number('sum(d)', 'turnover')} FROM x GROUP BY strategy""")
def exposure_stats(spark, sf_dir):
    return metrics.exposure_stats(study.controlled(study.inputs(spark, sf_dir), CFG).drop("turnover"), ["strategy"], CFG.max_leverage)


@query(f"WITH {oracle.STRATEGIES} SELECT strategy, date, {number(f'CASE WHEN count(r) OVER o = {CFG.rolling_window} THEN avg(r - rf) OVER o / stddev_samp(r) OVER o * sqrt({CFG.trading_days}.0::DOUBLE) END', 'sharpe')} FROM rows WINDOW o AS (PARTITION BY strategy ORDER BY date ROWS BETWEEN {CFG.rolling_window - 1} PRECEDING AND CURRENT ROW)")
def rolling_sharpe(spark, sf_dir):
    return study.rolling_sharpe(study.run_strategies(study.inputs(spark, sf_dir), CFG), CFG)


@query(f"WITH {oracle.study()}, b AS (SELECT asset, date, x.r, y.r AS ref FROM ret x JOIN (SELECT date, r FROM ret WHERE asset = 'AF') y USING (date) WHERE asset IN ('AO', 'NO', 'RO')) SELECT asset, date, {number(f'CASE WHEN count(r) OVER o = {CFG.rolling_window} THEN corr(r, ref) OVER o END', 'corr')} FROM b WINDOW o AS (PARTITION BY asset ORDER BY date ROWS BETWEEN {CFG.rolling_window - 1} PRECEDING AND CURRENT ROW)")
def rolling_correlation(spark, sf_dir):
    s = study.inputs(spark, sf_dir)
    return study.rolling_correlation(s.returns, s.dim, "AF", CFG.rolling_window)


@query(f"""WITH {oracle.STRATEGIES}, {oracle.paths('p', 'rows', 'strategy')},
g AS (SELECT s.strategy, c.date, wealth, drawdown, exposure FROM (SELECT DISTINCT strategy FROM p) s CROSS JOIN (SELECT DISTINCT date FROM p) c LEFT JOIN p ON p.strategy = s.strategy AND p.date = c.date),
f AS (SELECT strategy, date, last_value(wealth IGNORE NULLS) OVER o AS wealth, last_value(drawdown IGNORE NULLS) OVER o AS drawdown, last_value(exposure IGNORE NULLS) OVER o AS exposure FROM g WINDOW o AS (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING)),
common AS (SELECT max(d) AS d FROM (SELECT min(date) AS d FROM p GROUP BY strategy))
SELECT f.strategy, f.date, {number('f.wealth / s.wealth', 'wealth')}, {number('f.drawdown', 'drawdown')}, {number('f.exposure', 'exposure')} FROM f JOIN f s ON f.strategy = s.strategy AND s.date = (SELECT d FROM common)""")
def wealth_paths(spark, sf_dir):
    """On weekly panels of up to 400 dates the stride is 1."""
    return study.wealth_paths(study.run_strategies(study.inputs(spark, sf_dir), CFG))


@query(f"WITH {oracle.STRATEGIES}, q AS (SELECT *, quantile_cont(r, 0.05) OVER (PARTITION BY strategy) AS var FROM rows) SELECT strategy, {number('any_value(var)', 'var')}, {number('avg(r) FILTER (r <= var)', 'cvar')} FROM q GROUP BY strategy")
def tail_marks(spark, sf_dir):
    return metrics.tail_marks(study.run_strategies(study.inputs(spark, sf_dir), CFG), ["strategy"], CFG.cvar_alpha)


_BLOCKS = (("before", "1995-01-01", "1998-01-01"), ("stress", "1998-01-01", "1999-01-01"), ("after", "1999-01-01", "2002-01-01"))


@query(f"""WITH {oracle.study()}, b AS (SELECT asset, date, x.r, y.r AS ref FROM ret x JOIN (SELECT date, r FROM ret WHERE asset = 'AF') y USING (date) WHERE asset IN ('AO', 'NO', 'RO')),
c AS (SELECT asset, date, CASE WHEN count(r) OVER o = {CFG.rolling_window} THEN corr(r, ref) OVER o END AS corr FROM b WINDOW o AS (PARTITION BY asset ORDER BY date ROWS BETWEEN {CFG.rolling_window - 1} PRECEDING AND CURRENT ROW)),
k(block, a, b) AS (VALUES {", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in _BLOCKS)})
SELECT asset, block, count(corr)::BIGINT AS n, {number('avg(corr)', 'mean')} FROM c JOIN k ON date >= k.a AND date < k.b GROUP BY asset, block""")
def correlation_blocks(spark, sf_dir):
    """Means of the rolling correlation by phase."""
    s = study.inputs(spark, sf_dir)
    blocks = constants(spark, list(_BLOCKS), "block string, a string, b string").select("block", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    return metrics.block_means(study.rolling_correlation(s.returns, s.dim, "AF", CFG.rolling_window), blocks, ["asset"], "corr")


@query(f"WITH {oracle.study()}, cal AS (SELECT DISTINCT 1 AS k, date FROM ret), {oracle.rf('x', 'cal', 'k')} SELECT date, {number('rf', None, 8)}, {number(f'rf * {CFG.trading_days}', 'annualised', 8)} FROM x", digits=8)
def rate_series(spark, sf_dir):
    return study.rate_series(study.inputs(spark, sf_dir), CFG)


@query(f"WITH {oracle.study()}, cal AS (SELECT DISTINCT date FROM ret), k AS (SELECT coalesce(fix.rf_annual, (SELECT arg_min(rf_annual, date) FROM fix)) AS a FROM cal ASOF LEFT JOIN fix ON cal.date >= fix.date) SELECT {number('avg(a)', 'window_mean', 8)}, {number('min(a)', 'window_min', 8)}, {number('max(a)', 'window_max', 8)}, {number('avg(CASE WHEN a < 0 THEN 1.0::DOUBLE ELSE 0 END)', 'window_share_negative', 8)} FROM k", digits=8)
def rate_window(spark, sf_dir):
    return study.rate_window(study.inputs(spark, sf_dir))


_SH = f"CASE WHEN stddev_samp(r - rf) <> 0 THEN avg(r - rf) / stddev_samp(r - rf) * sqrt({CFG.trading_days}.0::DOUBLE) END"


@query(f"""WITH {oracle.VC}, nr AS (SELECT strategy, target, date, r, rf, row_number() OVER (PARTITION BY strategy ORDER BY date) - 1 AS rn, count(*) OVER (PARTITION BY strategy) AS n FROM vc),
pl AS (SELECT *, floor(floor(n * {CFG.train_share}::DOUBLE) + (n - floor(n * {CFG.train_share}::DOUBLE)) * fold / {CFG.folds}) AS t0, floor(floor(n * {CFG.train_share}::DOUBLE) + (n - floor(n * {CFG.train_share}::DOUBLE)) * (fold + 1) / {CFG.folds}) AS t1 FROM nr, (SELECT i::INTEGER AS fold FROM range({CFG.folds}) t(i))),
ins AS (SELECT fold, target, {_SH} AS is_sharpe FROM pl WHERE rn < t0 GROUP BY 1, 2),
ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY is_sharpe DESC, target) AS k FROM ins WHERE is_sharpe IS NOT NULL) WHERE k = 1)
SELECT fold, target, {number('any_value(is_sharpe)', 'is_sharpe')}, min(date) AS test_start, max(date) AS test_end, count(*)::BIGINT AS n, {number(_SH, 'oos_sharpe')} FROM pl JOIN ch USING (fold, target) WHERE rn >= t0 AND rn < t1 AND t1 - t0 >= 10 GROUP BY fold, target""")
def walk_forward(spark, sf_dir):
    return study.walk_forward(study.controlled(study.inputs(spark, sf_dir), CFG), CFG)[0]


_STABILITY = [(f"{n}/{v:g}", n, float(v), CFG.crypto_share) for n in CFG.stability_lookbacks for v in CFG.stability_vols]


@query(f"WITH {oracle.BASE},\n{oracle.grid('g', 'base', _STABILITY)},\n{oracle.summary('m', 'g', 'lookback, target')}\nSELECT lookback::INTEGER AS lookback, target, {number('sharpe')} FROM m")
def param_stability(spark, sf_dir):
    return study.param_stability(study.inputs(spark, sf_dir), CFG)


@query(f"""WITH {oracle.VC}, mult(multiplier) AS (VALUES {", ".join(f"({m}::DOUBLE)" for m in CFG.cost_multipliers)}),
pr AS (SELECT multiplier, date, rf, vc_gross - vc_cost * multiplier AS r FROM vc, mult WHERE target = {TARGET}::DOUBLE), {oracle.summary('m', 'pr', 'multiplier')}
SELECT multiplier, n, first, last, {numbers(oracle.SUMMARY)} FROM m""")
def cost_sensitivity(spark, sf_dir):
    return study.cost_sensitivity(study.inputs(spark, sf_dir), CFG, TARGET)


_SHARES = [(f"{s:g}", CFG.lookback, TARGET, s) for s in CFG.sweep_shares()]
_SWEEP = f"""{oracle.study()}, {oracle.weights(oracle.SWEEP)}, {oracle.held()}, {oracle.turnover('mix', 'held', 'share')},
gb AS (SELECT share, date, gross AS r FROM mix), {oracle.rf('gross', 'gb', 'share')},
{oracle.grid('g', 'gross', _SHARES)}, {oracle.summary('bh', 'gross', 'share')}, {oracle.summary('vcm', 'g', 'share')},
sweep AS (SELECT share, v.max_drawdown - b.max_drawdown AS d_mdd, v.cvar - b.cvar AS d_cvar, b.sharpe AS sharpe_bh, v.sharpe AS sharpe_vc FROM bh b JOIN vcm v USING (share))"""


@query(f"WITH {_SWEEP} SELECT share, {numbers('d_mdd d_cvar sharpe_bh sharpe_vc')} FROM sweep")
def crypto_sweep(spark, sf_dir):
    return study.crypto_sweep(study.inputs(spark, sf_dir), CFG, TARGET)


_TRIALS = sorted({(n, round(float(v), 6), CFG.crypto_share) for n in CFG.stability_lookbacks for v in CFG.stability_vols} | {(CFG.lookback, TARGET, s) for s in CFG.sweep_shares()})
_DAILY = f"""{oracle.study()}, {oracle.weights(oracle.SWEEP)}, dm AS (SELECT share, date, sum(w * r) AS r FROM ret JOIN w USING (asset) GROUP BY 1, 2), {oracle.rf('dmr', 'dm', 'share')},
{oracle.grid('g', 'dmr', [(f"{n}/{v:g}/{s:g}", n, v, s) for n, v, s in _TRIALS])}"""


@query(f"WITH {_DAILY}, s AS (SELECT config_id, count(r)::BIGINT AS n, avg(r) / stddev_samp(r) AS sr FROM g GROUP BY config_id) SELECT config_id, n, {number('sr')} FROM s")
def sharpe_trials(spark, sf_dir):
    """Every setting that the study looks at, once."""
    return statistics.sharpe_moments(study.trials(study.inputs(spark, sf_dir), CFG, TARGET), ["config_id"]).select("config_id", "n", "sr")


_CONTROLLED = f"""w1 AS (SELECT asset, w FROM w WHERE share = {CFG.crypto_share}), {oracle.held('h1', 'w1', '')}, {oracle.turnover('m1', 'h1', '')}, m2 AS (SELECT 1 AS share, * FROM m1), {oracle.rf('b1', 'm2', 'share')},
{oracle.TARGETS}, vin AS (SELECT strategy, target, date, r, rf, {oracle.BPS} AS bps FROM b1, targets), {oracle.control('vc', 'vin', 'strategy')}"""
_LUCK = (1 - statistics.EULER) * NormalDist().inv_cdf(1 - 1 / len(_TRIALS)) + statistics.EULER * NormalDist().inv_cdf(1 - 1 / (len(_TRIALS) * math.e))
#: The normal distribution function of z as the series of z^(2k + 1) / (2k + 1)!!, and both tails beyond z.
_PHI = "0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum([z ** (2 * k + 1) / exp(lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)) FOR k IN range(200)])"
_TAILS = "greatest(1 - 2 * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum([abs(z) ** (2 * k + 1) / exp(lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)) FOR k IN range(200)]), 0)"


@query(f"""WITH {_DAILY}, t AS (SELECT count(*)::BIGINT AS n_trials, sqrt(var_samp(sr)) * {_LUCK}::DOUBLE AS sr0 FROM (SELECT avg(r) / stddev_samp(r) AS sr FROM g GROUP BY config_id)),
{_CONTROLLED}, c AS (SELECT *, avg(r) OVER (PARTITION BY strategy) AS mu FROM vc),
m AS (SELECT strategy, count(r)::BIGINT AS n, avg(r) / stddev_samp(r) AS sr, avg((r - mu) ** 3) / power(avg((r - mu) ** 2), 1.5::DOUBLE) AS skew, avg((r - mu) ** 4) / power(avg((r - mu) ** 2), 2) AS kurt FROM c GROUP BY strategy),
d AS (SELECT strategy, sr, sr0, n_trials, (sr - sr0) * sqrt((n - 1)::DOUBLE) / sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr ** 2, 1e-12)) AS z FROM m, t)
SELECT strategy, {numbers('sr sr0 z')}, n_trials, {number(_PHI, 'dsr')} FROM d""")
def deflated_sharpe(spark, sf_dir):
    """The chance that a controlled strategy's Sharpe ratio exceeds what its trials reach by luck."""
    s = study.inputs(spark, sf_dir)
    return statistics.deflated_sharpe(study.controlled(s, CFG), study.trials(s, CFG, TARGET), ["strategy"])


@query(f"""WITH {oracle.STRATEGIES}, c AS (SELECT *, avg(r) OVER (PARTITION BY strategy) AS mu FROM rows),
m AS (SELECT strategy, count(r)::BIGINT AS n, avg(r) / stddev_samp(r) AS sr, avg((r - mu) ** 3) / power(avg((r - mu) ** 2), 1.5::DOUBLE) AS skew, avg((r - mu) ** 4) / power(avg((r - mu) ** 2), 2) AS kurt FROM c GROUP BY strategy),
e AS (SELECT *, sr * sqrt((n - 1)::DOUBLE) / sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr ** 2, 1e-12)) AS z FROM m)
SELECT strategy, n, {numbers('sr skew kurt z')}, {number(_PHI, 'psr')} FROM e""")
def probabilistic_sharpe(spark, sf_dir):
    return statistics.probabilistic_sharpe(study.run_strategies(study.inputs(spark, sf_dir), CFG), ["strategy"])


@query(f"""WITH {oracle.study()}, t AS (SELECT asset AS name, avg(CASE WHEN r <= 0 THEN 1.0::DOUBLE ELSE 0 END) / 10 AS p FROM ret GROUP BY asset),
o AS (SELECT *, least((count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p, 1.0::DOUBLE) AS s FROM t)
SELECT name, {number('p')}, {number('max(s) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING)', 'p_holm')} FROM o""")
def holm(spark, sf_dir):
    r = study.inputs(spark, sf_dir).returns
    return statistics.holm(r.groupBy(F.col("asset").alias("name")).agg((F.avg(F.when(F.col("r") <= 0, 1.0).otherwise(0.0)) / 10).alias("p")))


_MONTHS = "mo AS (SELECT asset, date_trunc('month', date)::DATE AS x, product(1 + r) - 1 AS y FROM ret GROUP BY 1, 2), num AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY x) AS i FROM mo)"


def _monthly(r: DataFrame) -> DataFrame:
    return r.groupBy("asset", F.trunc("date", "MM").alias("x")).agg((F.product(1 + F.col("r")) - 1).alias("y"))


@query(f"""WITH {oracle.study()}, {_MONTHS}, s AS (SELECT a.asset, sum(sign(b.y - a.y)) AS s FROM num a JOIN num b ON a.asset = b.asset AND a.i < b.i GROUP BY 1), c AS (SELECT asset, count(*)::BIGINT AS n FROM num GROUP BY 1),
e AS (SELECT *, CASE WHEN s > 0 THEN s - 1 WHEN s < 0 THEN s + 1 ELSE 0 END / sqrt(n * (n - 1) * (2 * n + 5) / 18.0::DOUBLE) AS z FROM s JOIN c USING (asset))
SELECT asset, n, {number('s::DOUBLE', 's')}, {number('s / (n * (n - 1) / 2.0::DOUBLE)', 'tau')}, {number('z')}, {number(_TAILS, 'p')} FROM e""")
def mann_kendall(spark, sf_dir):
    return statistics.mann_kendall(_monthly(study.inputs(spark, sf_dir).returns), ["asset"])


_LAGS = "greatest(1, round_even(power(n, 0.25::DOUBLE), 0))"


@query(f"""WITH {oracle.study()}, {_MONTHS}, f AS (SELECT asset, i::DOUBLE AS x, y FROM num),
fit AS (SELECT *, regr_slope(y, x) OVER p AS slope, regr_intercept(y, x) OVER p AS intercept, regr_r2(y, x) OVER p AS r2, x - avg(x) OVER p AS c, count(*) OVER p AS n FROM f WINDOW p AS (PARTITION BY asset)),
u AS (SELECT *, c * (y - intercept - slope * x) AS u, row_number() OVER (PARTITION BY asset ORDER BY x) AS i FROM fit),
s AS (SELECT a.asset, any_value(a.n)::BIGINT AS n, any_value(a.slope) AS slope, any_value(a.intercept) AS intercept, any_value(a.r2) AS r2, sum(a.c * a.c) FILTER (a.i = b.i) AS sxx,
  sum(a.u * b.u * CASE WHEN a.i = b.i THEN 1 ELSE 2 * (1 - (a.i - b.i) / ({_LAGS.replace('n,', 'a.n,')} + 1)) END) AS total FROM u a JOIN u b ON a.asset = b.asset AND a.i - b.i BETWEEN 0 AND {_LAGS.replace('n,', 'a.n,')} GROUP BY a.asset),
e AS (SELECT *, sqrt(greatest(total, 0)) / sxx AS se, slope / (sqrt(greatest(total, 0)) / sxx) AS z FROM s)
SELECT asset, n, {numbers('slope intercept r2 se z', 8)}, {number(_TAILS, 'p', 8)} FROM e""", digits=8)
def hac_ols(spark, sf_dir):
    points = _monthly(study.inputs(spark, sf_dir).returns)
    points = points.withColumn("x", F.row_number().over(Window.partitionBy("asset").orderBy("x")).cast("double"))
    return statistics.hac_ols(points, ["asset"])


@query(f"""WITH {oracle.STRATEGIES}, d AS (SELECT v.r - b.r AS d, v.strategy FROM rows v JOIN rows b ON v.date = b.date AND b.strategy = 'BuyHold' WHERE v.strategy LIKE 'VolControl%' AND v.r <> b.r),
g AS (SELECT strategy, abs(d) AS a, count(*) AS t, count(*) FILTER (d > 0) AS plus FROM d GROUP BY 1, 2),
k AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY strategy ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + (t + 1) / 2.0::DOUBLE AS rank FROM g),
s AS (SELECT strategy, sum(t)::BIGINT AS n, sum(rank * plus) AS w_plus, sum(rank * (t - plus)) AS w_minus, sum(t * t * t - t)::DOUBLE AS ties FROM k GROUP BY 1),
e AS (SELECT *, (least(w_plus, w_minus) - n * (n + 1) / 4.0::DOUBLE) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM s)
SELECT strategy, n, {numbers('w_plus w_minus z')}, {number(_TAILS, 'p')} FROM e""")
def wilcoxon(spark, sf_dir):
    rows = study.run_strategies(study.inputs(spark, sf_dir), CFG)
    base = rows.where("strategy = 'BuyHold'").select("date", F.col("r").alias("b"))
    return statistics.wilcoxon(rows.where("strategy like 'VolControl%'").join(base, "date").select("strategy", (F.col("r") - F.col("b")).alias("d")), ["strategy"])


_LISTED = {"NO": "1996-03-01", "RO": "1998-06-15"}
_PIT = f"""{oracle.panel()}, {oracle.DIM}, late AS (SELECT * FROM panel WHERE NOT (asset = 'NO' AND date < DATE '1996-03-01') AND NOT (asset = 'RO' AND date < DATE '1998-06-15')),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS rn FROM (SELECT DISTINCT date FROM late)),
f AS (SELECT asset, min(date) AS first FROM late WHERE asset IN ('AO', 'NO', 'RO') GROUP BY asset),
ent AS (SELECT f.asset, f.first, e.date AS entry FROM f JOIN cal c ON c.date = f.first JOIN cal e ON e.rn = c.rn + 8),
win AS (SELECT * FROM late WHERE date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'),
act AS (SELECT d.date, dim.asset, dim.base_weight, dim.asset IN ('AO', 'NO', 'RO') AS member, CASE WHEN dim.asset IN ('AO', 'NO', 'RO') THEN coalesce(d.date >= entry, false) ELSE true END AS active FROM (SELECT DISTINCT date FROM win) d CROSS JOIN dim LEFT JOIN ent USING (asset)),
ok AS (SELECT a.date FROM act a LEFT JOIN win USING (date, asset) GROUP BY a.date HAVING NOT bool_or(active AND price IS NULL) AND bool_or(active AND member)),
kept AS (SELECT win.* FROM win JOIN ok USING (date)),
days AS (SELECT DISTINCT date FROM kept WHERE date > (SELECT min(date) FROM kept)),
ww AS (SELECT a.date, asset, member, {CFG.crypto_share}::DOUBLE AS share, CASE WHEN member THEN CASE WHEN active THEN {CFG.crypto_share}::DOUBLE / n ELSE 0 END ELSE base_weight * (1 - CASE WHEN n > 0 THEN {CFG.crypto_share}::DOUBLE ELSE 0 END) END AS today
  FROM (SELECT *, sum((active AND member)::INTEGER) OVER (PARTITION BY date) AS n FROM act JOIN days USING (date)) a),
pw AS (SELECT share, date, asset, member, coalesce(lag(today) OVER (PARTITION BY asset ORDER BY date), today) AS w FROM ww)"""


def _pit(spark, sf_dir):
    spec = sample.scenario("S2")
    prices, dim = sample.late_listing(price_panel(spark, sf_dir), _LISTED).persist(), asset_dim(spark)
    kept = sample.resolve(prices, spec, dim)
    entries = sample.entry_dates(prices, spec.members, spec.buffer)
    dates = kept.select("date").distinct()
    first = dates.agg(F.min("date").alias("d0"))
    days = dates.crossJoin(F.broadcast(first)).where("date > d0").select("date")
    weights = sample.pit_weights(days, spec, entries, dim, study.shares_of(spark, [CFG.crypto_share]))
    return spec, prices, kept, entries, weights


@query(f"WITH {_PIT} SELECT asset, first, entry FROM ent")
def pit_entries(spark, sf_dir):
    return _pit(spark, sf_dir)[3]


@query(f"WITH {_PIT} SELECT date, asset, {number('price')} FROM kept")
def pit_sample(spark, sf_dir):
    return _pit(spark, sf_dir)[2]


@query(f"WITH {_PIT} SELECT 'S2' AS scenario, min(date) AS effective_start, max(date) AS effective_end, count(DISTINCT date)::BIGINT AS n_price_rows, (count(DISTINCT date) - 1)::BIGINT AS n_return_rows, (SELECT count(DISTINCT date) FROM win)::BIGINT AS n_window, ((SELECT count(DISTINCT date) FROM win) - count(DISTINCT date))::BIGINT AS n_dropped FROM kept")
def sample_report(spark, sf_dir):
    spec, prices, kept, *_ = _pit(spark, sf_dir)
    return sample.report(prices, kept, spec)


@query(f"WITH {_PIT} SELECT date, asset, {number('w')} FROM pw")
def pit_weights(spark, sf_dir):
    return _pit(spark, sf_dir)[4].select("date", "asset", "w")


@query(f"WITH {_PIT}, s AS (SELECT date, sum(d) AS turnover FROM (SELECT *, coalesce(abs(w - lag(w) OVER (PARTITION BY asset ORDER BY date)), 0) AS d FROM pw WHERE member) GROUP BY date) SELECT date, {number('turnover')}, {number('turnover * 25.0::DOUBLE / 1e4', 'cost')} FROM s")
def sleeve_cost(spark, sf_dir):
    return sample.sleeve_cost(_pit(spark, sf_dir)[4]).drop("share")


@query(f"WITH {_PIT}, pr AS (SELECT date, asset, price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM kept) SELECT date, {number('sum(w * coalesce(r, 0))', 'r')} FROM pw LEFT JOIN pr USING (date, asset) GROUP BY date")
def pit_portfolio(spark, sf_dir):
    *_, kept, _, weights = _pit(spark, sf_dir)
    return sample.weighted_portfolio(alignment.simple_returns(kept), weights).drop("share")


def _pit_study(spark, sf_dir):
    prices, dim = sample.late_listing(price_panel(spark, sf_dir), _LISTED).persist(), asset_dim(spark)
    return study.of_sample(prices, sample.scenario("S2"), rf_fixings(spark, sf_dir).persist(), dim)


_PIT_RET = f"{_PIT}, {oracle.FIXINGS}, ret AS (SELECT date, asset, r FROM (SELECT date, asset, price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM kept) WHERE r IS NOT NULL)"
_PIT_EVERY = f"""{_PIT_RET},
ph AS (SELECT share, date, asset, w, coalesce(r, 0) AS r FROM pw LEFT JOIN ret USING (date, asset)), {oracle.turnover('pm', 'ph', 'share')}, {oracle.rf('base', 'pm', 'share')}, {oracle.TARGETS},
vin AS (SELECT strategy, target, date, r, rf, turnover AS base_turnover, {oracle.BPS} AS bps FROM base, targets), {oracle.control('vc', 'vin', 'strategy')}, {oracle.PARITY},
two(asset, w) AS (VALUES ('AF', 0.6::DOUBLE), ('NF', 0.4::DOUBLE)), {oracle.held('classic_w', 'two', '')}, {oracle.turnover('classic', 'classic_w', '')}, {oracle.turnover('parity', 'rp', '')},
every AS (SELECT 'BuyHold' AS strategy, date, r, gross, 0.0::DOUBLE AS turnover_exposure, turnover AS turnover_sleeve FROM pm
  UNION ALL SELECT strategy, date, r, vc_gross, move, base_turnover * exposure FROM vc
  UNION ALL SELECT 'Benchmark_Classic', date, r, gross, 0, turnover FROM classic UNION ALL SELECT 'Benchmark_RiskParity', date, r, gross, 0, turnover FROM parity), {oracle.rf('rows', 'every', 'strategy')}"""


@query(f"""WITH {_PIT_EVERY}, {oracle.summary('m', 'rows', 'strategy')}
SELECT strategy, n, first, last, {numbers(oracle.SUMMARY)}, {numbers('turnover turnover_exposure turnover_sleeve')} FROM m JOIN (SELECT strategy, sum(turnover_exposure + turnover_sleeve) AS turnover, sum(turnover_exposure) AS turnover_exposure, sum(turnover_sleeve) AS turnover_sleeve FROM rows GROUP BY strategy) USING (strategy)""")
def metrics_table_pit(spark, sf_dir):
    """Every strategy on a base whose members join as they list."""
    s, pit = _pit_study(spark, sf_dir)
    return study.metrics_table(study.run_strategies(s, CFG, pit), CFG).drop("ann_return_gross", "cagr_gross", "sharpe_gross")


def _by_share(sql: str) -> str:
    """The point-in-time weights at every share of the sweep instead of the chosen one."""
    head, tail = sql.split("ww AS (", 1)
    tail = tail.replace(f"{CFG.crypto_share}::DOUBLE AS share", "sh.share").replace(f"{CFG.crypto_share}::DOUBLE", "sh.share")
    tail = tail.replace("FROM act JOIN days USING (date)) a)", f"FROM act JOIN days USING (date)) a, ({oracle.SWEEP}) sh)").replace("PARTITION BY asset ORDER BY date), today)", "PARTITION BY share, asset ORDER BY date), today)")
    return f"{head}ww AS ({tail}"


_PIT_SHARES = _by_share(_PIT_RET)


@query(f"""WITH {_PIT_SHARES}, sc AS (SELECT share, date, sum(d) * 25.0::DOUBLE / 1e4 AS sleeve_cost FROM (SELECT *, coalesce(abs(w - lag(w) OVER (PARTITION BY share, asset ORDER BY date)), 0) AS d FROM pw WHERE member) GROUP BY ALL),
gb AS (SELECT share, date, sum(w * coalesce(r, 0)) - any_value(sleeve_cost) AS r FROM pw LEFT JOIN ret USING (date, asset) JOIN sc USING (share, date) GROUP BY ALL), {oracle.rf('gross', 'gb', 'share')},
{oracle.grid('g', 'gross', _SHARES)}, {oracle.summary('bh', 'gross', 'share')}, {oracle.summary('vcm', 'g', 'share')}
SELECT share, {number('v.max_drawdown - b.max_drawdown', 'd_mdd')}, {number('v.cvar - b.cvar', 'd_cvar')}, {number('b.sharpe', 'sharpe_bh')}, {number('v.sharpe', 'sharpe_vc')} FROM bh b JOIN vcm v USING (share)""")
def crypto_sweep_pit(spark, sf_dir):
    s, pit = _pit_study(spark, sf_dir)
    return study.crypto_sweep(s, CFG, TARGET, pit)


def _compared(names: list[str]) -> str:
    """scenario, strategy and metrics of fixed samples."""
    specs = [sample.scenario(n) for n in names]
    windows = ", ".join(f"('{s.name}', DATE '{s.start}', DATE '{s.end}')" for s in specs)
    return f"""{oracle.panel()}, {oracle.COMPLETE}, {oracle.DIM}, {oracle.FIXINGS}, spec(scenario, a, b) AS (VALUES {windows}),
sret AS (SELECT * FROM (SELECT scenario, date, asset, price / lag(price) OVER (PARTITION BY scenario, asset ORDER BY date) - 1 AS r FROM cc JOIN spec ON date BETWEEN a AND b) WHERE r IS NOT NULL),
{oracle.weights()}, sh AS (SELECT scenario, date, asset, r, g / sum(g) OVER (PARTITION BY scenario, date) AS w
  FROM (SELECT scenario, date, asset, r, w * coalesce(product(1 + r) OVER (PARTITION BY scenario, asset, date_trunc('month', date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS g FROM sret JOIN w USING (asset))),
{oracle.turnover('sm', 'sh', 'scenario')}, {oracle.rf('sb', 'sm', 'scenario')}, si AS (SELECT scenario, date, r, rf, turnover AS base_turnover, {TARGET}::DOUBLE AS target, {oracle.BPS} AS bps FROM sb), {oracle.control('sv', 'si', 'scenario')},
both_ AS (SELECT scenario, 'BuyHold' AS strategy, date, r, rf, turnover FROM sb UNION ALL SELECT scenario, 'VolControl_{TARGET:g}', date, r, rf, move + base_turnover * exposure FROM sv), {oracle.summary('cm', 'both_', 'scenario, strategy')}"""


@query(f"WITH {_compared(['S1', 'S3'])} SELECT scenario, strategy, n, first, last, {numbers(oracle.SUMMARY)}, {number('t', 'turnover')} FROM cm JOIN (SELECT scenario, strategy, sum(turnover) AS t FROM both_ GROUP BY ALL) USING (scenario, strategy)")
def sample_comparison(spark, sf_dir):
    """Base and control in the fixed samples."""
    specs = [sample.scenario(n) for n in ("S1", "S3")]
    return study.compare_samples(price_panel(spark, sf_dir), specs, rf_fixings(spark, sf_dir), asset_dim(spark), CFG, TARGET)


_STARTS = [f"S4_{y}" for y in (1996, 1997, 1998, 1999, 2000)]


@query(f"""WITH {_compared(_STARTS)} SELECT scenario, v.n, {number('v.sharpe', 'vc_sharpe')}, {number('v.cagr', 'vc_cagr')}, {number('v.max_drawdown', 'vc_max_drawdown')}, {number('b.sharpe', 'bh_sharpe')}, {number('b.cagr', 'bh_cagr')}, {number('b.max_drawdown', 'bh_max_drawdown')},
  {number('v.sharpe - b.sharpe', 'd_sharpe')}, {number('v.max_drawdown - b.max_drawdown', 'd_mdd')} FROM cm v JOIN cm b USING (scenario) WHERE b.strategy = 'BuyHold' AND v.strategy <> 'BuyHold'""")
def start_sensitivity(spark, sf_dir):
    """How much the first year matters."""
    specs = [sample.scenario(n) for n in _STARTS]
    return study.start_sensitivity(study.compare_samples(price_panel(spark, sf_dir), specs, rf_fixings(spark, sf_dir), asset_dim(spark), CFG, TARGET))


@query(f"""WITH {oracle.STRATEGIES}, {oracle.summary('m', 'rows', 'strategy')}, con AS (SELECT * REPLACE (0.03::DOUBLE / {CFG.trading_days} AS rf) FROM rows), {oracle.summary('c', 'con', 'strategy')}
SELECT strategy, {number('m.sharpe', 'sharpe')}, {number('c.sharpe', 'sharpe_constant')}, {number('c.sharpe - m.sharpe', 'difference')} FROM m JOIN c USING (strategy) WHERE strategy NOT LIKE 'VolControl%'""")
def rf_sensitivity(spark, sf_dir):
    """What a constant rate would do to the Sharpe ratios of the strategies without a cash leg."""
    s = study.inputs(spark, sf_dir)
    rows = study.run_strategies(s, CFG).where("strategy not like 'VolControl%'")
    a = metrics.summary(rows, ["strategy"], CFG.trading_days).select("strategy", "sharpe")
    b = metrics.summary(rows.withColumn("rf", F.lit(CFG.rf_annual / CFG.trading_days)), ["strategy"], CFG.trading_days).select("strategy", F.col("sharpe").alias("sharpe_constant"))
    return a.join(b, "strategy").withColumn("difference", F.col("sharpe_constant") - F.col("sharpe"))


@query(f"""WITH {oracle.STRATEGIES}, {oracle.summary('m', 'rows', 'strategy')}, con AS (SELECT * REPLACE (0.03::DOUBLE / {CFG.trading_days} AS rf) FROM rows), {oracle.summary('c', 'con', 'strategy')}
SELECT 'run/' || strategy || '/sharpe' AS path, {number('m.sharpe', 'old')}, {number('c.sharpe', 'new')}, 'changed' AS kind FROM m JOIN c USING (strategy) WHERE strategy NOT LIKE 'VolControl%'""")
def archive_diff(spark, sf_dir):
    """Two archives of the metrics table compared, number by number: only the rate differs, so only Sharpe ratios do."""
    rows = study.run_strategies(study.inputs(spark, sf_dir), CFG).where("strategy not like 'VolControl%'")
    old = hashing.records(metrics.summary(rows, ["strategy"], CFG.trading_days), ["strategy"], "run")
    new = hashing.records(metrics.summary(rows.withColumn("rf", F.lit(CFG.rf_annual / CFG.trading_days)), ["strategy"], CFG.trading_days), ["strategy"], "run")
    return hashing.differences(old, new, ["path"], tolerance=1e-12)


_FROZEN, _SOLD, _RESTATED = "1999-12-31", "NF", "RO"
_RECORDS = """SELECT asset AS record, to_json({{'asset': asset, 'generated_at': '{side}', 'window': {{'first': min(date)::VARCHAR, 'last': max(date)::VARCHAR, 'n': sum(n)::BIGINT}},
  'years': list({{'year': year, 'n': n, 'months': months}} ORDER BY year){more}}}) AS body
  FROM (SELECT asset, year, min(date) AS date, sum(n)::BIGINT AS n, list({{'month': month, 'total': total}} ORDER BY month) AS months FROM (SELECT asset, year(date) AS year, month(date) AS month, min(date) AS date, count(*) AS n, round(product(1 + r) - 1, 9) AS total FROM {rows} GROUP BY ALL) GROUP BY ALL) GROUP BY asset"""


def _archive(returns: DataFrame, side: str, noted: bool) -> DataFrame:
    """A nested record an asset: its window, and its years with their months."""
    month = returns.groupBy("asset", F.year("date").alias("year"), F.month("date").alias("month")).agg(F.min("date").alias("date"), F.count("*").alias("n"), F.round(F.product(1 + F.col("r")) - 1, 9).alias("total"))
    listed = lambda *names: F.sort_array(F.collect_list(F.struct(*names)))
    year = month.groupBy("asset", "year").agg(F.min("date").alias("date"), F.sum("n").alias("n"), listed("month", "total").alias("months"))
    one = year.groupBy("asset").agg(F.min("date").cast("string").alias("first"), F.max("date").cast("string").alias("last"), F.sum("n").alias("n"), listed("year", "n", "months").alias("years"))
    parts = [F.col("asset"), F.lit(side).alias("generated_at"), F.struct("first", "last", "n").alias("window"), F.col("years")]
    return one.select(F.col("asset").alias("record"), F.to_json(F.struct(*parts, *([F.lit("restated").alias("note")] if noted else []))).alias("body"))


def _nodes_sql(side: str) -> str:
    kinds = "CASE WHEN type = 'OBJECT' THEN 'object' WHEN type = 'ARRAY' THEN 'list' WHEN type = 'NULL' THEN 'null' WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'BOOLEAN' THEN 'boolean' ELSE 'number' END"
    return f"""{side}_n AS MATERIALIZED (SELECT record, replace(replace(fullkey, '$', ''), '.', '/') AS path, {kinds} AS kind, CASE WHEN type = 'ARRAY' THEN json_array_length(value)::DOUBLE WHEN type NOT IN ('OBJECT', 'VARCHAR', 'BOOLEAN', 'NULL') THEN atom::DOUBLE END AS number, CASE WHEN type IN ('VARCHAR', 'BOOLEAN') THEN atom ->> '$' END AS text
  FROM {side}, json_tree({side}.body) WHERE fullkey NOT LIKE '%generated_at%')"""


@query(f"""WITH {oracle.study()}, early AS (SELECT * FROM ret WHERE date <= DATE '{_FROZEN}' OR asset IN ('AF', '{_SOLD}', '{_RESTATED}')), late AS (SELECT date, asset, CASE WHEN asset = '{_RESTATED}' AND year(date) = 1997 THEN r / 2 ELSE r END AS r FROM ret WHERE asset <> '{_SOLD}'),
old AS MATERIALIZED ({_RECORDS.format(side='before', rows='early', more='')}), new AS MATERIALIZED ({_RECORDS.format(side='now', rows='late', more=", 'note': 'restated'")}), {_nodes_sql('old')}, {_nodes_sql('new')},
d AS MATERIALIZED (SELECT record, path, CASE WHEN b.kind IS NULL THEN 'missing' WHEN a.kind IS NULL THEN 'added' WHEN a.kind <> b.kind THEN 'kind' WHEN a.kind = 'list' AND a.number <> b.number THEN 'length' WHEN a.kind <> 'list' AND (a.number IS DISTINCT FROM b.number OR a.text IS DISTINCT FROM b.text) THEN 'value' END AS difference,
  a.number AS old_number, b.number AS new_number, a.text AS old_text, b.text AS new_text FROM old_n a FULL JOIN new_n b USING (record, path))
SELECT record, path, difference, {numbers('old_number new_number')}, old_text, new_text FROM d
WHERE difference IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d o WHERE o.record = d.record AND o.difference IS NOT NULL AND (starts_with(d.path, o.path || '/') OR starts_with(d.path, o.path || '[')))""")
def archive_verify(spark, sf_dir):
    """Nested records frozen in 1999 against those of today: one asset has been sold, one restated, and all have a note."""
    r = study.inputs(spark, sf_dir).returns
    old = _archive(r.where((F.col("date") <= F.lit(_FROZEN).cast("date")) | F.col("asset").isin("AF", _SOLD, _RESTATED)), "before", False)
    restated = F.when((F.col("asset") == _RESTATED) & (F.year("date") == 1997), F.col("r") / 2).otherwise(F.col("r"))
    return archives.verified(old, _archive(r.where(F.col("asset") != _SOLD).withColumn("r", restated), "now", True))


@query()
def dataset_hash(spark, sf_dir):
    return hashing.panel_hash(study.inputs(spark, sf_dir).returns)


#: x times the draws' multiplier, modulo 2 ** 64, by halves of 32 bits.
_MASK, _LOW, _HIGH = (f"{v}::UBIGINT" for v in ((1 << 32) - 1, bootstrap.SPREAD & ((1 << 32) - 1), bootstrap.SPREAD >> 32))
_LOW_HALF, _HIGH_HALF = f"({{x}}::UBIGINT & {_MASK})", "({x}::UBIGINT >> 32)"
_MIXED = f"((((({_LOW_HALF} * {_LOW}) >> 32) + (({_HIGH_HALF} * {_LOW}) & {_MASK}) + (({_LOW_HALF} * {_HIGH}) & {_MASK})) & {_MASK}) * 4294967296::UBIGINT + (({_LOW_HALF} * {_LOW}) & {_MASK}))"
_SHIFTED = "xor({x}, {x} >> 32)"


def _paths_sql(days: str, reps: int, seed: int = CFG.seed) -> str:
    """steps (rep, step, i): replicate paths over the rows i (from 0) of a CTE, by the library's draws; rep -1 is the sample."""
    stages = [("u0", f"SELECT rep, j, kind, n, (({seed}::HUGEINT * 1000003 + rep) * 1000003 + j) * 2 + kind AS x FROM (SELECT count(*) AS n FROM {days}), (SELECT unnest(range({reps})) AS rep), (SELECT unnest(range((SELECT count(*) FROM {days}))) AS j), (SELECT unnest([0, 1]) AS kind)")]
    for k in (1, 2):
        stages.append((f"v{k}", f"SELECT * REPLACE ({_MIXED.format(x='x')} AS x) FROM {stages[-1][0]}"))
        stages.append((f"u{k}", f"SELECT * REPLACE ({_SHIFTED.format(x='x')} AS x) FROM v{k}"))
    parts = [f"{name} AS ({sql})" for name, sql in stages]
    parts.append("uni AS (SELECT rep, j, kind, n, ((x >> 11)::DOUBLE + 0.5::DOUBLE) / 9007199254740992.0::DOUBLE AS u FROM u2)")
    parts.append(f"blocks AS (SELECT rep, j, any_value(n) AS n, 1 + floor(ln(max(u) FILTER (kind = 0)) / ln(1 - 1.0::DOUBLE / {CFG.expected_block}))::BIGINT AS len, least(floor(max(u) FILTER (kind = 1) * any_value(n))::BIGINT, any_value(n) - 1) AS start FROM uni GROUP BY rep, j)")
    parts.append("laid AS (SELECT *, sum(len) OVER (PARTITION BY rep ORDER BY j ROWS UNBOUNDED PRECEDING)::BIGINT - len AS before FROM blocks)")
    parts.append(f"steps AS MATERIALIZED (SELECT rep, before + k AS step, (start + k) % n AS i FROM (SELECT *, unnest(range(least(len, n - before))) AS k FROM laid WHERE before < n) UNION ALL SELECT -1, i, i FROM {days})")
    return ",\n".join(parts)


_MARKET = """market AS MATERIALIZED (SELECT row_number() OVER (ORDER BY date) - 1 AS i, sum(r * base_weight) / (SELECT sum(base_weight) FROM dim) AS t, avg(r) FILTER (asset_class = 'crypto') AS c FROM ret JOIN dim USING (asset) GROUP BY date)"""
_OUTCOMES = "d_mdd d_cvar sharpe_bh sharpe_vc calmar_vc"
_SWEEP_DRAWS = f"""{oracle.study()}, cal AS (SELECT DISTINCT 1 AS k, date FROM ret), {oracle.rf('calrf', 'cal', 'k')}, hurdle AS (SELECT avg(rf) AS rf FROM calrf), {_MARKET}, {_paths_sql('market', CFG.sweep_bootstrap_n)},
sh AS ({oracle.SWEEP}),
bin AS (SELECT rep, share, step AS date, (1 - share) * t + share * c AS r, (SELECT rf FROM hurdle) AS rf, {TARGET}::DOUBLE AS target, (1 - share) * 10.0::DOUBLE + share * 25.0::DOUBLE AS bps FROM steps JOIN market USING (i), sh),
{oracle.control('cin', 'bin', 'rep, share')}, {oracle.summary('bm', 'bin', 'rep, share', ' + 1e-15')}, {oracle.summary('cm', 'cin', 'rep, share', ' + 1e-15')},
draws AS MATERIALIZED (SELECT rep AS replicate, share, c.max_drawdown - b.max_drawdown AS d_mdd, c.cvar - b.cvar AS d_cvar, b.sharpe AS sharpe_bh, c.sharpe AS sharpe_vc, CASE WHEN c.max_drawdown < 0 THEN c.cagr / abs(c.max_drawdown) END AS calmar_vc FROM bm b JOIN cm c USING (rep, share))"""


def _draws(spark, sf_dir):
    return hypotheses.sweep_bootstrap(study.inputs(spark, sf_dir), CFG, TARGET)


@query(f"WITH {_SWEEP_DRAWS} SELECT replicate::BIGINT AS replicate, share, {numbers(_OUTCOMES)} FROM draws")
def bootstrap_sweep(spark, sf_dir):
    return _draws(spark, sf_dir)


@query(f"""WITH {_SWEEP_DRAWS}, b AS (SELECT share, quantile_cont(sharpe_vc, 0.025) AS low, quantile_cont(sharpe_vc, 0.975) AS high, stddev_samp(sharpe_vc) AS sd FROM draws WHERE replicate >= 0 GROUP BY share),
o AS (SELECT share, sharpe_vc AS point FROM draws WHERE replicate < 0),
f AS (SELECT quantile_cont(z, 0.95) AS factor FROM (SELECT replicate, max(abs(sharpe_vc - point) / sd) AS z FROM draws JOIN b USING (share) JOIN o USING (share) WHERE replicate >= 0 AND sd > 0 GROUP BY replicate))
SELECT share, {number('point')}, {number('low', 'pointwise_low')}, {number('high', 'pointwise_high')}, {number('point - factor * sd', 'simultaneous_low')}, {number('point + factor * sd', 'simultaneous_high')}, {number('factor')} FROM b JOIN o USING (share), f""")
def bootstrap_bands(spark, sf_dir):
    return bootstrap.bands(_draws(spark, sf_dir).persist(), "sharpe_vc")


@query(f"""WITH {_SWEEP_DRAWS}, e AS (SELECT replicate, regr_slope(d_mdd, share) AS s FROM draws GROUP BY replicate), o AS (SELECT s AS slope FROM e WHERE replicate < 0), m AS (SELECT avg(s) AS mean FROM e WHERE replicate >= 0)
SELECT {number('any_value(slope)', 'slope')}, {number('any_value(mean)', 'boot_mean')}, {number('quantile_cont(s, 0.025)', 'ci_low')}, {number('quantile_cont(s, 0.975)', 'ci_high')}, {number('(count(*) FILTER (abs(s - mean) >= abs(slope)) + 1) / (count(*) + 1)::DOUBLE', 'p')}, {number('avg(CASE WHEN s > 0 THEN 1.0::DOUBLE ELSE 0 END)', 'share_positive')} FROM e, o, m WHERE replicate >= 0""")
def bootstrap_sweep_slope(spark, sf_dir):
    return bootstrap.slope(_draws(spark, sf_dir).persist(), "d_mdd")


@query(f"""WITH {_SWEEP_DRAWS}, best AS (SELECT replicate, share AS best FROM (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY sharpe_vc DESC, share) AS k FROM draws WHERE sharpe_vc IS NOT NULL) WHERE k = 1),
top AS (SELECT best AS top FROM best WHERE replicate < 0), fr AS (SELECT best AS share, count(*)::BIGINT AS freq FROM best WHERE replicate >= 0 GROUP BY 1),
nv AS (SELECT quantile_cont(best, 0.025) AS lo, quantile_cont(best, 0.975) AS hi FROM best WHERE replicate >= 0),
df AS (SELECT a.share, quantile_cont(a.sharpe_vc - b.sharpe_vc, 0.025) AS low, quantile_cont(a.sharpe_vc - b.sharpe_vc, 0.975) AS high FROM draws a JOIN draws b ON a.replicate = b.replicate AND b.share = (SELECT top FROM top) WHERE a.replicate >= 0 GROUP BY 1)
SELECT share, coalesce(freq, 0)::BIGINT AS freq, {number(f'coalesce(freq, 0) / {CFG.sweep_bootstrap_n}.0::DOUBLE', 'prob')}, {number('low', 'diff_low')}, {number('high', 'diff_high')}, share = top AS is_best, low <= 0 AND high >= 0 AS indistinguishable, {number('lo', 'naive_low')}, {number('hi', 'naive_high')} FROM df LEFT JOIN fr USING (share), top, nv""")
def bootstrap_argmax(spark, sf_dir):
    return bootstrap.argmax(_draws(spark, sf_dir).persist())


#: The same series by logarithms, for large z.
_PHI_FAR = "0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum([exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)) FOR k IN range(200)])"
_PAIRED = f"""{oracle.STRATEGIES}, pair AS MATERIALIZED (SELECT row_number() OVER (ORDER BY v.date) - 1 AS i, v.r AS a, b.r AS b FROM rows v JOIN rows b ON v.date = b.date AND b.strategy = 'BuyHold' WHERE v.strategy = 'VolControl_{TARGET:g}'),
{_paths_sql('pair', CFG.bootstrap_n)},
less AS (SELECT -2 - a.i AS rep, b.i - (b.i > a.i)::INTEGER AS step, b.i AS i FROM pair a JOIN pair b ON a.i <> b.i),
walk AS (SELECT rep, step, a, b FROM (SELECT * FROM steps UNION ALL SELECT * FROM less) JOIN pair USING (i)),
rich AS (SELECT rep, step, product(1 + a) OVER o AS a, product(1 + b) OVER o AS b FROM walk WINDOW o AS (PARTITION BY rep ORDER BY step ROWS UNBOUNDED PRECEDING)),
d AS MATERIALIZED (SELECT rep, min(x) - min(y) AS d FROM (SELECT rep, a / max(a) OVER o - 1 AS x, b / max(b) OVER o - 1 AS y FROM rich WINDOW o AS (PARTITION BY rep ORDER BY step ROWS UNBOUNDED PRECEDING)) GROUP BY rep),
obs AS (SELECT d AS observed FROM d WHERE rep = -1), jack AS (SELECT avg(d) OVER () - d AS j FROM d WHERE rep < -1), bend AS MATERIALIZED (SELECT coalesce(sum(j ** 3) / (6 * sum(j ** 2) ** 1.5::DOUBLE), 0) AS bend FROM jack),
boot AS (SELECT d, observed FROM d, obs WHERE rep >= 0), sorted AS MATERIALIZED (SELECT list(d ORDER BY d) AS x FROM boot),
s AS MATERIALIZED (SELECT any_value(observed) AS observed, least(2 * least(avg(CASE WHEN d <= 0 THEN 1.0::DOUBLE ELSE 0 END), avg(CASE WHEN d >= 0 THEN 1.0::DOUBLE ELSE 0 END)), 1.0::DOUBLE) AS p, quantile_cont(d, 0.025) AS ci_low, quantile_cont(d, 0.975) AS ci_high, avg(CASE WHEN d < observed THEN 1.0::DOUBLE ELSE 0 END) AS below FROM boot),
halved AS (SELECT 0 AS k, -8.0::DOUBLE AS lo, 8.0::DOUBLE AS hi, least(greatest(below, 1e-6), 1 - 1e-6)::DOUBLE AS below FROM s
  UNION ALL SELECT k + 1, CASE WHEN phi < below THEN z ELSE lo END, CASE WHEN phi < below THEN hi ELSE z END, below FROM (SELECT *, {_PHI_FAR} AS phi FROM (SELECT *, (lo + hi) / 2 AS z FROM halved WHERE k < 60))),
zero AS MATERIALIZED (SELECT lo AS z0 FROM halved WHERE k = 60),
place AS MATERIALIZED (SELECT side, ({_PHI_FAR}) * (len(x) - 1) AS pos, x FROM (SELECT side, z0 + (z0 + q) / (1 - bend * (z0 + q)) AS z, x FROM zero, bend, sorted, (VALUES ('low', {NormalDist().inv_cdf(0.025)}::DOUBLE), ('high', {NormalDist().inv_cdf(0.975)}::DOUBLE)) t(side, q))),
cut AS (SELECT side, x[floor(pos)::BIGINT + 1] + (x[least(floor(pos)::BIGINT + 2, len(x))] - x[floor(pos)::BIGINT + 1]) * (pos - floor(pos)) AS v FROM place),
bca AS (SELECT max(v) FILTER (side = 'low') AS ci_low_bca, max(v) FILTER (side = 'high') AS ci_high_bca FROM cut)"""


@query(f"WITH RECURSIVE {_PAIRED} SELECT {numbers('observed p ci_low ci_high ci_low_bca ci_high_bca')} FROM s, bca")
def bootstrap_paired(spark, sf_dir):
    return bootstrap.paired_difference(hypotheses.pairs(study.run_strategies(study.inputs(spark, sf_dir), CFG), f"VolControl_{TARGET:g}"), bootstrap.DRAWDOWN, CFG)


_RESAMPLES = 2000


@query(f"""WITH {_SWEEP}, pts AS MATERIALIZED (SELECT row_number() OVER (ORDER BY share) - 1 AS pos, share AS x, d_mdd AS y FROM sweep),
v0 AS (SELECT rep, (({CFG.seed}::HUGEINT * 1000003 + rep) * 1000003 + k) * 2 + 1 AS x FROM (SELECT unnest(range({_RESAMPLES})) AS rep), (SELECT pos AS k FROM pts)),
v1 AS (SELECT rep, {_MIXED.format(x='x')} AS x FROM v0), v2 AS (SELECT rep, {_SHIFTED.format(x='x')} AS x FROM v1), v3 AS (SELECT rep, {_MIXED.format(x='x')} AS x FROM v2), v4 AS (SELECT rep, {_SHIFTED.format(x='x')} AS x FROM v3),
drawn AS (SELECT rep, floor(((x >> 11)::DOUBLE + 0.5::DOUBLE) / 9007199254740992.0::DOUBLE * (SELECT count(*) FROM pts))::BIGINT AS pos FROM v4),
each AS (SELECT regr_slope(y, x) AS s FROM drawn JOIN pts USING (pos) GROUP BY rep HAVING count(DISTINCT x) > 1)
SELECT {number('(SELECT regr_slope(y, x) FROM pts)', 'slope')}, (SELECT count(*) FROM pts)::BIGINT AS n, {number('quantile_cont(s, 0.025)', 'ci_low')}, {number('quantile_cont(s, 0.975)', 'ci_high')}, count(*)::BIGINT AS n_boot FROM each""")
def bootstrap_slope(spark, sf_dir):
    points = study.crypto_sweep(study.inputs(spark, sf_dir), CFG, TARGET).select(F.col("share").alias("x"), F.col("d_mdd").alias("y"))
    return bootstrap.slope_resampled(points, _RESAMPLES, CFG.seed)


@query()
def hypothesis_tests(spark, sf_dir):
    """The whole report: the confirmatory family, its companions, and the three corrections."""
    return hypotheses.report(study.inputs(spark, sf_dir), CFG, TARGET)
