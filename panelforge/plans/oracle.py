"""Pieces of SQL from which the queries' reference statements are put together (see queries)."""

from __future__ import annotations

from ..config import ASSETS, Config

CFG = Config()
DAYS, BACK = CFG.trading_days, CFG.lookback


def number(x: str, name: str | None = None, digits: int = 6) -> str:
    """x rounded, without a negative zero."""
    return f"(round({x}, {digits}) + 0.0) AS {name or x}"


def numbers(names: str, digits: int = 6) -> str:
    return ", ".join(number(n, None, digits) for n in names.split())


def panel(grain: str = "week") -> str:
    return f"""panel AS (
  SELECT date_trunc('{grain}', l_shipdate)::DATE AS date, l_returnflag || l_linestatus AS asset, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / count(*) / 100 AS price
  FROM lineitem GROUP BY 1, 2)"""


COMPLETE = "cc AS (SELECT * FROM panel WHERE date IN (SELECT date FROM panel GROUP BY date HAVING count(price) = 6))"
RETURNS = "ret AS (SELECT date, asset, r FROM (SELECT date, asset, price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM cc) WHERE r IS NOT NULL)"
DIM = "dim(asset, asset_class, base_weight, cost_bps) AS (VALUES " + ", ".join(f"('{a}', '{c}', {w}::DOUBLE, {b}::DOUBLE)" for a, c, w, b in ASSETS) + ")"
FIXINGS = """fix AS (
  SELECT o_orderdate::DATE AS date, (sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / count(*) / 100 - 250000) / 2e6 AS rf_annual
  FROM orders WHERE o_orderdate::DATE >= DATE '1995-02-01' AND day(o_orderdate) <= 7 GROUP BY 1)"""


def study(grain: str = "week") -> str:
    return ",\n".join([panel(grain), COMPLETE, RETURNS, DIM, FIXINGS])


def weights(shares: str = f"SELECT {CFG.crypto_share}::DOUBLE AS share") -> str:
    return f"""shares AS ({shares}),
w AS (SELECT * FROM (SELECT share, asset, CASE WHEN asset_class = 'crypto' THEN share / 3 ELSE base_weight / (SELECT sum(base_weight) FROM dim) * (1 - share) END AS w FROM dim, shares) WHERE w > 0)"""


SWEEP = "SELECT round(i * 0.025, 6)::DOUBLE AS share FROM range(21) t(i)"


def turnover(name: str, source: str, keys: str) -> str:
    """Portfolio rows from a path of held weights (keys, date, asset, r, w)."""
    k = f"{keys}, " if keys else ""
    return f"""{name} AS (
  SELECT {k}date, sum(w * r) AS gross, sum(d) AS turnover, sum(d * cost_bps / 1e4) AS cost, sum(w * r) - sum(d * cost_bps / 1e4) AS r
  FROM (SELECT *, coalesce(abs(w - lag(w) OVER (PARTITION BY {k}asset ORDER BY date)), 0) AS d FROM {source}) JOIN dim USING (asset) GROUP BY {k}date)"""


def held(name: str = "held", w: str = "w", keys: str = "share", unit: str = "month") -> str:
    k = f"{keys}, " if keys else ""
    return f"""{name} AS (
  SELECT {k}date, asset, r, g / sum(g) OVER (PARTITION BY {k}date) AS w
  FROM (SELECT {k}date, asset, r, w * coalesce(product(1 + r) OVER (PARTITION BY {k}asset, date_trunc('{unit}', date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS g FROM ret JOIN {w} USING (asset)))"""


def rf(name: str, source: str, k: str) -> str:
    """source with rf by actual days over 360, on each series' own calendar."""
    return f"""{name} AS (
  SELECT * EXCLUDE (a, gap, rate), rate * coalesce(gap, quantile_cont(gap, 0.5) OVER (PARTITION BY {k})) / 360 AS rf
  FROM (SELECT s.*, date_diff('day', lag(s.date) OVER o, s.date) AS gap, coalesce(lag(a) OVER o, a) AS rate
        FROM (SELECT x.*, coalesce(fix.rf_annual, (SELECT arg_min(rf_annual, date) FROM fix)) AS a FROM {source} x ASOF LEFT JOIN fix ON x.date >= fix.date) s
        WINDOW o AS (PARTITION BY {k} ORDER BY s.date)))"""


def control(name: str, source: str, k: str, back: int = BACK) -> str:
    """source (k, date, r, rf, target, bps) under volatility control."""
    return f"""{name} AS (
  WITH v AS (SELECT *, CASE WHEN count(r) OVER o = {back} THEN stddev_samp(r) OVER o * sqrt({DAYS}.0::DOUBLE) END AS vol FROM {source} WINDOW o AS (PARTITION BY {k} ORDER BY date ROWS BETWEEN {back - 1} PRECEDING AND CURRENT ROW)),
  e AS (SELECT * EXCLUDE (vol), coalesce(lag(CASE WHEN vol = 0 THEN 1.0::DOUBLE WHEN vol IS NOT NULL THEN least(target / vol, 1.0::DOUBLE) END) OVER (PARTITION BY {k} ORDER BY date), 0) AS exposure FROM v),
  c AS (SELECT *, abs(exposure - coalesce(lag(exposure) OVER (PARTITION BY {k} ORDER BY date), 0)) AS move FROM e)
  SELECT * EXCLUDE (r, bps, move), move, move * bps / 1e4 AS vc_cost, exposure * r + (1 - exposure) * rf AS vc_gross, exposure * r + (1 - exposure) * rf - move * bps / 1e4 AS r FROM c)"""


def paths(name: str, source: str, k: str) -> str:
    return f"""{name} AS (
  SELECT *, wealth / max(wealth) OVER (PARTITION BY {k} ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown
  FROM (SELECT *, product(1 + r) OVER (PARTITION BY {k} ORDER BY date ROWS UNBOUNDED PRECEDING) AS wealth FROM {source}))"""


def summary(name: str, source: str, k: str, slack: str = "") -> str:
    """slack: added to the quantile where values repeat, since DuckDB may interpolate equal values to one an ulp below them."""
    return f"""{paths(name + "_p", source, k)},
{name} AS (
  SELECT {k}, count(r)::BIGINT AS n, min(date) AS first, max(date) AS last, avg(r) * {DAYS} AS ann_return,
         CASE WHEN product(1 + r) <= 0 THEN -1.0 ELSE power(product(1 + r), {DAYS}.0::DOUBLE / count(r)) - 1 END AS cagr,
         stddev_samp(r) * sqrt({DAYS}.0::DOUBLE) AS ann_vol, CASE WHEN stddev_samp(r - rf) <> 0 THEN avg(r - rf) / stddev_samp(r - rf) * sqrt({DAYS}.0::DOUBLE) END AS sharpe,
         min(drawdown) AS max_drawdown, avg(r) FILTER (r <= var{slack}) AS cvar
  FROM (SELECT *, quantile_cont(r, {CFG.cvar_alpha}) OVER (PARTITION BY {k}) AS var FROM {name}_p) GROUP BY {k})"""


SUMMARY = "ann_return cagr ann_vol sharpe max_drawdown cvar"
BPS = f"({1 - CFG.crypto_share} * 10.0 + {CFG.crypto_share} * 25.0)::DOUBLE"
BASE = ",\n".join([study(), weights(), held(), turnover("mix", "held", "share"), rf("base", "mix", "share")])
TARGETS = "targets AS (SELECT * FROM (VALUES " + ", ".join(f"('VolControl_{v:g}', {v}::DOUBLE)" for v in CFG.target_vols) + ") t(strategy, target))"
VC = f"""{BASE},
{TARGETS},
vin AS (SELECT strategy, target, date, r, rf, turnover AS base_turnover, {BPS} AS bps FROM base, targets),
{control("vc", "vin", "strategy")}"""
PARITY = f"""rp AS (
  WITH s AS (SELECT *, CASE WHEN count(r) OVER o = {CFG.parity_lookback} THEN stddev_samp(r) OVER o END AS sd FROM ret WINDOW o AS (PARTITION BY asset ORDER BY date ROWS BETWEEN {CFG.parity_lookback - 1} PRECEDING AND CURRENT ROW)),
  i AS (SELECT *, CASE WHEN sd > 0 THEN 1 / sd END AS inv FROM s),
  h AS (SELECT *, inv / sum(inv) OVER (PARTITION BY date) AS share FROM i),
  l AS (SELECT *, lag(share) OVER (PARTITION BY asset ORDER BY date) AS known FROM h),
  f AS (SELECT date, asset, r, first_value(known) OVER (PARTITION BY asset, date_trunc('month', date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS w FROM l)
  SELECT date, asset, r, w FROM (SELECT *, sum(w) OVER (PARTITION BY date) AS total FROM f) WHERE total > 0.5)"""
TRUE_BH = """tbh AS (
  SELECT date, coalesce(v / lag(v) OVER (ORDER BY date) - 1, 0) AS r
  FROM (SELECT date, sum(v) AS v FROM (SELECT date, w.w * product(1 + r) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM ret JOIN w USING (asset)) GROUP BY date))"""
STRATEGIES = f"""{VC},
{PARITY},
{TRUE_BH},
two(asset, w) AS (VALUES ('AF', 0.6::DOUBLE), ('NF', 0.4::DOUBLE)),
{held("classic_w", "two", "")},
{turnover("classic", "classic_w", "")},
{turnover("parity", "rp", "")},
every AS (
  SELECT 'BuyHold' AS strategy, date, r, gross, NULL::DOUBLE AS exposure, 0.0::DOUBLE AS turnover_exposure, turnover AS turnover_sleeve FROM mix
  UNION ALL SELECT strategy, date, r, vc_gross, exposure, move, base_turnover * exposure FROM vc
  UNION ALL SELECT 'Benchmark_TrueBH', date, r, r, NULL, 0, 0 FROM tbh
  UNION ALL SELECT 'Benchmark_Classic', date, r, gross, NULL, 0, turnover FROM classic
  UNION ALL SELECT 'Benchmark_RiskParity', date, r, gross, NULL, 0, turnover FROM parity),
{rf("rows", "every", "strategy")}"""


def grid(name: str, source: str, combos: list[tuple[str, int, float, float]]) -> str:
    """Volatility control of (config_id, lookback, target, share) over source (share, date, r, rf)."""
    by: dict[int, list] = {}
    for c in combos:
        by.setdefault(c[1], []).append(c)
    parts, names = [], []
    for back, some in by.items():
        values = ", ".join(f"('{i}', {n}, {t}::DOUBLE, {s}::DOUBLE, {(1 - s) * 10.0 + s * 25.0}::DOUBLE)" for i, n, t, s in some)
        parts.append(f"{name}_i{back} AS (SELECT g.*, x.date, x.r, x.rf FROM {source} x JOIN (VALUES {values}) g(config_id, lookback, target, share, bps) USING (share))")
        parts.append(control(f"{name}_{back}", f"{name}_i{back}", "config_id", back))
        names.append(f"SELECT config_id, lookback, target, share, date, r, rf FROM {name}_{back}")
    return ",\n".join(parts) + f",\n{name} AS ({' UNION ALL '.join(names)})"
