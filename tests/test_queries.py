"""Registered queries against their SQL, and what has no SQL against what must hold."""

import datetime
import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from panelforge.functions import hashing
from panelforge.plans import queries
from panelforge.sources import sinks
from panelforge.streaming.panel import streaming_panel

SF = "/root/testdata/sf0.01"
CHECKED = ("metrics_table", "complete_case", "periodic_mix_quarterly", "traded_turnover", "ewma_vol", "rf_act360", "vol_control", "dead_band", "deflated_sharpe", "walk_forward", "crypto_sweep", "pit_weights", "hac_ols", "month_matrix", "bootstrap_argmax", "crypto_sweep_pit", "start_sensitivity", "bootstrap_slope", "bootstrap_paired", "requested_backtest", "archive_verify")


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("lineitem", "orders"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    plain = lambda r: tuple(x.isoformat()[:10] if hasattr(x, "isoformat") else x for x in r)
    key = lambda r: tuple((x is None, round(x, 4) if isinstance(x, float) else x if x is not None else 0) for x in r)
    a = sorted((plain(r) for r in df.select(*columns).collect()), key=key)
    b = sorted((plain(r) for r in want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()), key=key)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        assert all(u == v or isinstance(u, float) and math.isclose(u, v, abs_tol=2e-6) for u, v in zip(x, y, strict=True)), (x, y)


def test_bands_hold_the_point_and_reruns_agree(spark):
    first = {r.share: r for r in queries.queries()["bootstrap_bands"](spark, SF).collect()}
    assert len(first) == 21
    for r in first.values():
        assert r.simultaneous_low <= r.point <= r.simultaneous_high
    again = {r.share: r for r in queries.queries()["bootstrap_bands"](spark, SF).collect()}
    assert first == again


def test_hash_sees_values_dates_and_names(spark):
    rows = [(datetime.date(2024, 1, 1 + i), a, 0.01 * i) for i in range(5) for a in "xy"]
    make = lambda some: hashing.panel_hash(spark.createDataFrame(some, "date date, asset string, r double")).first().dataset_hash
    base = make(rows)
    assert base == make(rows[::-1])
    assert len({base, make([(d, a, r + 1e-9) for d, a, r in rows]), make([(d, a + "z", r) for d, a, r in rows]), make([(d + datetime.timedelta(days=1), a, r) for d, a, r in rows])}) == 4


def test_differences_name_their_kind(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None), ("e", 5.0)], "path string, value double")
    new = spark.createDataFrame([("a", 1.0), ("b", 2.5), ("c", None), ("d", 4.0)], "path string, value double")
    assert sorted((r.path, r.kind) for r in hashing.differences(old, new, ["path"]).collect()) == [("b", "changed"), ("d", "added"), ("e", "missing")]


def test_sinks_write_what_can_be_read(spark, tmp_path):
    table = spark.createDataFrame([("r1", 1234.5), ("r2", float("nan"))], "record string, x double")
    sinks.write_archive(table, str(tmp_path / "archive"))
    assert sorted((r.record, r.x) for r in sinks.read_archive(spark, str(tmp_path / "archive"), "record string, x double").collect()) == [("r1", 1234.5), ("r2", None)]
    assert table.where("record = 'r1'").select(sinks.german(F.col("x")).alias("g")).first().g == "1.234,50"
    assert json.dumps(sinks.provenance(spark))


def test_streamed_panel_is_the_batch_panel(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1 + i, 12), "a", 10.0 + i) for i in range(14)]
    trades = spark.createDataFrame(rows, "ts timestamp, asset string, price double")
    trades.write.parquet(str(tmp_path / "in"))
    stream = streaming_panel(spark.readStream.schema(trades.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("panel_test").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("panel_test").collect())) == [(datetime.date(2024, 1, 1), "a", 13.0, 7), (datetime.date(2024, 1, 8), "a", 20.0, 7)]
