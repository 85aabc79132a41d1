"""Metrics by name in SQL against the operators they resample."""

import datetime
from dataclasses import replace

import numpy as np
import pytest

from panelforge.config import Config
from panelforge.functions import registry
from panelforge.operators import bootstrap

CFG = replace(Config(), bootstrap_n=12, expected_block=5, seed=9)
DAY = datetime.date(2021, 1, 1)


def test_metrics_by_name_follow_the_dates(spark):
    registry.register_all(spark)
    rng = np.random.default_rng(4)
    series = {k: rng.normal(0, 0.05, 40).tolist() for k in "ab"}
    rows = [(k, DAY + datetime.timedelta(days=i), x) for k, values in series.items() for i, x in enumerate(values)]
    rng.shuffle(rows)
    spark.createDataFrame([*rows, ("a", DAY + datetime.timedelta(days=99), None), ("none", DAY, None)], "k string, date date, r double").createOrReplaceTempView("registry_series")
    got = {r.k: r for r in spark.sql("SELECT k, worst_drawdown(date, r) AS fall, tail_mean_05(date, r) AS tail, total_growth(date, r) AS growth FROM registry_series GROUP BY k").collect()}
    for k, values in series.items():
        r = np.array(values)[:, None]
        assert (got[k].fall, got[k].tail, got[k].growth) == pytest.approx((bootstrap.worst_drawdown(r)[0], bootstrap.tail_mean(r, 0.05)[0], np.prod(1 + r) - 1), abs=1e-12)
    assert got["none"].fall is None


def test_a_custom_metric_resampled_in_sql_is_the_bootstrap(spark):
    registry.register_all(spark)
    registry.register(spark, "downside", lambda r: float(np.sqrt((np.minimum(r, 0) ** 2).mean())))
    r = np.random.default_rng(5).normal(0.001, 0.03, 60)
    series = spark.createDataFrame([(DAY + datetime.timedelta(days=i), float(x)) for i, x in enumerate(r)], "date date, r double")
    series.createOrReplaceTempView("registry_one")
    got = spark.sql(f"""
        WITH numbered AS (SELECT row_number() OVER (ORDER BY date) - 1 AS i, r FROM registry_one)
        SELECT replicate, downside(step, r) AS value FROM block_path(60, {CFG.expected_block}, {CFG.seed}, 0, {CFG.bootstrap_n}) JOIN numbered USING (i) GROUP BY replicate""")
    want = bootstrap.block_bootstrap(series, lambda p: np.sqrt((np.minimum(p, 0) ** 2).mean(axis=-2)), CFG).where("replicate >= 0")
    a, b = ({x.replicate: x["value"] for x in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() == set(range(CFG.bootstrap_n)) and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
