"""Cases whose answer is known by hand."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.config import Config
from panelforge.operators import alignment, bootstrap, metrics, riskfree, statistics, strategies
from panelforge.plans import sample


def series(spark, values, start="2024-01-01", **keys):
    day = datetime.date.fromisoformat(start)
    rows = [(day + datetime.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date date, r double").withColumn("rf", F.lit(0.0)).withColumn("k", F.lit("a"))


def test_summary(spark):
    got = metrics.summary(series(spark, [0.10, -0.50]), ["k"], 252).first()
    assert math.isclose(got.max_drawdown, -0.5)
    assert metrics.summary(series(spark, [0.5, -1.0, 0.2]), ["k"], 252).first().cagr == -1
    flat = metrics.summary(series(spark, [0.0] * 50), ["k"], 252).first()
    assert flat.sharpe is None and flat.max_drawdown == 0
    tail = [-0.10, -0.08, -0.05, 0, 0.02, 0.03, 0.04, 0.05, 0.06, 0.10]
    assert math.isclose(metrics.summary(series(spark, tail), ["k"], 252).first().cvar, -0.10)
    rise = metrics.summary(series(spark, [0.001] * 252), ["k"], 252).first()
    assert math.isclose(rise.cagr, 1.001**252 - 1)


def test_holm_and_trend(spark):
    got = {r.name: r.p_holm for r in statistics.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "name string, p double").where("name <> 'd'")).collect()}
    assert all(math.isclose(got[n], p) for n, p in (("a", 0.03), ("b", 0.06), ("c", 0.06)))
    up = spark.createDataFrame([(float(i), float(i)) for i in range(20)], "x double, y double")
    assert statistics.mann_kendall(up).first().tau == 1 and statistics.mann_kendall(up).first().p < 0.01
    assert statistics.mann_kendall(up.withColumn("y", F.lit(1.0))).first().p > 0.99


def test_rates_by_actual_days(spark):
    days = spark.createDataFrame([(datetime.date(2024, 1, d),) for d in (4, 5, 8)], "date date")
    rates = spark.createDataFrame([(datetime.date(2023, 12, 1), 0.036)], "date date, rf_annual double")
    got = [r.rf for r in riskfree.daily_rate(days, rates, 252).orderBy("date").collect()]
    assert np.allclose(got[1:], [0.036 / 360, 0.036 * 3 / 360])
    simple = riskfree.daily_rate(days, None, 252, rf_annual=0.03).collect()
    assert all(math.isclose(r.rf, 0.03 / 252) for r in simple)


def test_daily_mix_is_the_constant_mix(spark):
    rng = np.random.default_rng(1)
    rows = [(datetime.date(2024, 1, 1) + datetime.timedelta(days=i), a, float(r)) for a in "xyz" for i, r in enumerate(rng.normal(0, 0.02, 60))]
    returns = spark.createDataFrame(rows, "date date, asset string, r double")
    w = spark.createDataFrame([("x", 0.5), ("y", 0.3), ("z", 0.2)], "asset string, w double")
    dim = spark.createDataFrame([(a, 10.0) for a in "xyz"], "asset string, cost_bps double")
    a = [r.r for r in strategies.constant_mix(returns, w).orderBy("date").collect()]
    b = [r.gross for r in strategies.periodic_mix(returns, w, dim, "daily").orderBy("date").collect()]
    assert np.allclose(a, b, atol=1e-15)
    monthly = strategies.held_weights(returns, w, "monthly").groupBy("date").agg(F.sum("w").alias("s")).collect()
    assert all(math.isclose(r.s, 1) for r in monthly)


def test_dead_band_keeps_the_last_trade(spark):
    rows = [(datetime.date(2024, 1, i + 1), "a", e) for i, e in enumerate([0.5, 0.55, 0.62, 0.6, 0.4, 0.45])]
    got = strategies.dead_band(spark.createDataFrame(rows, "date date, k string, exposure double"), 0.1, ["k"]).orderBy("date").collect()
    assert [r.exposure for r in got] == [0.5, 0.5, 0.62, 0.62, 0.4, 0.4]


def test_wilcoxon_and_hac_against_numpy(spark):
    d = [0.3, -0.1, 0.2, 0.2, -0.4, 0.0, 0.7, -0.2, 0.5]
    got = statistics.wilcoxon(spark.createDataFrame([(x,) for x in d], "d double")).first()
    size = np.abs([x for x in d if x])
    rank = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
    sign = np.sign([x for x in d if x])
    assert got.w_plus == rank[sign > 0].sum() and got.w_minus == rank[sign < 0].sum() and got.n == 8
    rng = np.random.default_rng(2)
    x = np.linspace(0, 0.5, 21)
    y = 0.3 * x + rng.normal(0, 0.02, 21)
    fit = statistics.hac_ols(spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")).first()
    design = np.stack([np.ones(21), x], 1)
    inverse = np.linalg.inv(design.T @ design)
    beta = inverse @ design.T @ y
    u = design * (y - design @ beta)[:, None]
    middle = u.T @ u
    for lag in (1, 2):
        g = u[lag:].T @ u[:-lag]
        middle += (1 - lag / 3) * (g + g.T)
    assert np.allclose([fit.slope, fit.intercept, fit.se], [beta[1], beta[0], math.sqrt((inverse @ middle @ inverse)[1, 1])])


def test_bootstrap_repeats_and_covers(spark):
    path = bootstrap.index_paths(500, 20, 3, np.array([0]))[0]
    assert len(path) == 500 and path.min() >= 0 and path.max() < 500
    assert abs((np.diff(path) % 500 == 1).mean() - 0.95) < 0.05
    points = spark.createDataFrame([(i / 40, 0.3 * i / 40 + 0.001) for i in range(21)], "x double, y double")
    got = bootstrap.slope_resampled(points, 200).first()
    assert math.isclose(got.slope, 0.3) and got.ci_low > 0 and got == bootstrap.slope_resampled(points.repartition(7), 200).first()


def test_complete_case_and_returns(spark):
    rows = [(datetime.date(2024, 1, 1), "a", 1.0), (datetime.date(2024, 1, 2), "a", 2.0), (datetime.date(2024, 1, 2), "b", 5.0), (datetime.date(2024, 1, 3), "a", 3.0), (datetime.date(2024, 1, 3), "b", 4.0)]
    prices = spark.createDataFrame(rows, "date date, asset string, price double")
    assert alignment.complete_case(prices).count() == 4
    assert sorted((r.asset, round(r.r, 6)) for r in alignment.simple_returns(alignment.complete_case(prices)).collect()) == [("a", 0.5), ("b", -0.2)]
    assert alignment.simple_returns(alignment.complete_case(prices.limit(0), 2)).count() == 0


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Config(rebalance="quarterly")
    with pytest.raises(ValueError):
        sample.scenario("S9")
    with pytest.raises(ValueError):
        Config().target(0.2)
    assert Config().run_hash() != Config(crypto_share=0.2).run_hash()


def test_hac_sums_every_lag_of_long_series(spark):
    """17 lags at 90 000 points, against numpy."""
    rng = np.random.default_rng(1)
    n = 90_000
    noise = np.convolve(rng.normal(size=n + 20), np.ones(20) / 20, "valid")[:n]
    x = np.arange(n, dtype=float)
    y = 1e-6 * x + noise
    points = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    got = statistics.hac_ols(points).first()
    slope, intercept = np.polyfit(x, y, 1)
    u = (x - x.mean()) * (y - intercept - slope * x)
    lags = round(n**0.25)
    total = u @ u + 2 * sum((1 - k / (lags + 1)) * (u[k:] @ u[:-k]) for k in range(1, lags + 1))
    assert lags == 17 and math.isclose(got.se, math.sqrt(total) / ((x - x.mean()) ** 2).sum(), rel_tol=1e-6)


def test_trend_counts_all_pairs(spark):
    rng = np.random.default_rng(2)
    series = {"ties": rng.integers(0, 4, 60), "real": rng.normal(size=75), "equal": np.ones(12), "one": np.array([3.0]), "down": -np.arange(33.0)}
    points = spark.createDataFrame([(k, float(i), float(v)) for k, values in series.items() for i, v in enumerate(values)], "k string, x double, y double")
    for r in statistics.mann_kendall(points, ["k"]).collect():
        v = series[r.k]
        assert (r.n, r.s) == (len(v), sum(np.sign(v[j] - v[i]) for i in range(len(v)) for j in range(i + 1, len(v))))


def test_assets_are_described_on_their_own_calendars(spark):
    """Daily crypto and business days: each is annualised by its own rows a year, held to 200 to 366."""
    day = datetime.date(2020, 1, 1)
    rows = [(day + datetime.timedelta(days=i), "every", 100.0 + i % 7) for i in range(800)]
    rows += [(day + datetime.timedelta(days=i), "week", 100.0 + i % 5) for i in range(0, 800, 7)]
    got = {r.asset: r for r in metrics.describe_assets(spark.createDataFrame(rows, "date date, asset string, price double"), 0.03).collect()}
    assert got["every"].trading_days == 365 and got["week"].trading_days == 200
    r = np.array([p for _, a, p in rows if a == "every"])
    r = r[1:] / r[:-1] - 1
    assert math.isclose(got["every"].sharpe, (r.mean() - 0.03 / 365) / r.std(ddof=1) * math.sqrt(365))


def folded(exposures, band):
    held, out = None, []
    for e in exposures:
        if held is None or not abs(e - held) < band:
            held = e
        out.append(held)
    return out


def test_dead_band_by_jumps_is_the_fold(spark):
    """Series of one row, of powers of two and beside them, constant ones, and ones that trade every row."""
    rng, rows, want = np.random.default_rng(5), [], {}
    walks = {f"n{n}": np.clip(0.5 + np.cumsum(rng.normal(0, 0.03, n)), 0, 1).tolist() for n in (1, 2, 3, 7, 8, 9, 64, 65, 300)}
    for k, e in {**walks, "flat": [0.4] * 20, "jumps": [float(i % 2) for i in range(33)]}.items():
        rows += [(k, i, datetime.date(2020, 1, 1) + datetime.timedelta(days=3 * i), x) for i, x in enumerate(e)]
        want[k] = folded(e, 0.07)
    df = spark.createDataFrame(rows, "k string, i int, date date, exposure double")
    got = strategies.dead_band(df, 0.07, ["k"])
    assert got.columns == df.columns
    assert {(r.k, r.i): r.exposure for r in got.collect()} == {(k, i): x for k, values in want.items() for i, x in enumerate(values)}


def test_ewma_carries_over_blocks(spark):
    """Against all weights of the series, over more than four blocks; rows without a return keep the value before."""
    rng, halflife = np.random.default_rng(6), 3
    rows, want = [], {}
    for k, n in (("a", 400), ("b", 4), ("c", 61)):
        seen = []
        for i in range(n):
            x = None if i % 11 == 5 or (k == "c" and i < 3) else float(rng.normal(0.001, 0.02))
            rows.append((k, datetime.date(2020, 1, 1) + datetime.timedelta(days=i), x))
            seen += [] if x is None else [x]
            w = 0.5 ** (np.arange(len(seen))[::-1] / halflife)
            if len(seen) >= 5:
                mean = (w * seen).sum() / w.sum()
                want[k, i] = math.sqrt(max((w * (np.array(seen) - mean) ** 2).sum() / w.sum() * w.sum() ** 2 / (w.sum() ** 2 - (w**2).sum()), 0))
    got = strategies.ewma_std(spark.createDataFrame(rows, "k string, date date, r double"), ["k"], halflife).collect()
    found = {(r.k, (r.date - datetime.date(2020, 1, 1)).days): r.ewma for r in got if r.ewma is not None}
    assert len(got) == len(rows) and found.keys() == want.keys()
    assert all(math.isclose(found[k], want[k], rel_tol=1e-9) for k in want)
