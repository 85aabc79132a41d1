"""Sources, requests and sinks: what is read and written, and what is refused."""

import datetime
import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from panelforge.config import Config
from panelforge.operators import metrics
from panelforge.plans import exhibits as study_exhibits
from panelforge.plans import hypotheses, request, sample, study
from panelforge.plans.request import Request
from panelforge.sources import exhibits, panel, sinks

D = datetime.date
CFG = replace(Config(), bootstrap_n=60, sweep_bootstrap_n=40)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_wide_csv_and_rates_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("date,a,b\n2024-01-02,1.5,\n2024-01-01,1.0,2.0\n")
    assert rows(panel.wide_csv(spark, str(tmp_path / "p.csv"), ["a", "b"])) == [(D(2024, 1, 1), "a", 1.0), (D(2024, 1, 1), "b", 2.0), (D(2024, 1, 2), "a", 1.5)]
    (tmp_path / "r.csv").write_text("date,value\n2024-01-01,3.5\n2024-01-02,n/a\n2024-01-03,-0.5\n")
    assert rows(panel.rates_csv(spark, str(tmp_path / "r.csv"), percent=True)) == [(D(2024, 1, 1), 0.035), (D(2024, 1, 3), -0.005)]


def test_chained_rates_take_the_later_source_from_the_switch_on(spark):
    make = lambda some: spark.createDataFrame(some, panel.RATES)
    old = make([(D(2019, 9, 30), 0.02), (D(2019, 10, 1), 0.02)])
    new = make([(D(2019, 9, 30), 0.5), (D(2019, 10, 1), 0.01), (D(2019, 10, 2), 0.011)])
    got = rows(panel.chained_rates(old, new, "2019-10-01"))
    assert got == [(D(2019, 9, 30), pytest.approx(0.01915)), (D(2019, 10, 1), 0.01), (D(2019, 10, 2), 0.011)]


def test_synthetic_prices(spark):
    df = panel.synthetic_prices(spark, n_days=1700)
    assert rows(df) == rows(df.repartition(3)) and rows(panel.synthetic_prices(spark, n_days=1700, seed=8)) != rows(df)
    by = {r.asset: r for r in df.groupBy("asset").agg(F.count("*").alias("n"), F.min("date").alias("first")).collect()}
    assert {a: r.n for a, r in by.items()} == {a: 1700 - late for a, _, _, late in panel.SYNTHETIC}
    assert df.where(F.weekday("date") >= 5).isEmpty() and by["Gold"]["first"] == D(2014, 1, 1)
    vol = {r.asset: r.ann_vol for r in metrics.describe_assets(df).collect()}
    assert all(abs(vol[a] / v - 1) < 0.15 for a, _, v, late in panel.SYNTHETIC if late < 1000)


def test_converted_takes_the_last_known_rate(spark):
    prices = spark.createDataFrame([(D(2024, 1, d), "a", 10.0) for d in (1, 2, 3)], panel.PRICES)
    fx = spark.createDataFrame([(D(2024, 1, 2), 2.0)], "date date, fx double")
    assert [r[2] for r in rows(panel.converted(prices, fx))] == [5.0, 5.0, 5.0]


def small(spark):
    return spark.createDataFrame([(D(1996, 1, d), a, float(d)) for d in range(1, 6) for a in ("AF", "AO")], panel.PRICES)


def test_requests_are_checked_before_a_plan_is_made(spark):
    sources = {"frozen": lambda: small(spark), "synthetic": lambda: small(spark)}
    with pytest.raises(ValueError, match="EUR"):
        request.prices(Request(base_currency="USD"), sources)
    with pytest.raises(ValueError, match="unknown source"):
        request.prices(Request(source="live"), sources)
    with pytest.raises(ValueError, match="none of the assets"):
        request.prices(Request(assets=("zz",)), sources)
    with pytest.raises(ValueError, match="no price"):
        request.prices(Request(start="2001-01-01"), sources)
    with pytest.raises(ValueError, match="rf_mode"):
        Request(rf_mode="guess")
    with pytest.raises(ValueError, match="unknown sample"):
        Request(scenario="S9").spec()
    assert request.prices(Request(assets=("AF", "zz"), start="1996-01-04"), sources).count() == 2
    assert request.prices(Request(source="synthetic", base_currency="USD", start="2001-01-01"), sources).count() == 10
    assert Request(scenario=None, assets=("AF", "AO")).spec().members == ("AO",)
    assert Request(scenario="S2").spec().point_in_time


def test_base_allocation(spark):
    split = request.traditional_split
    assert request.is_base_allocation(split(Request()))
    assert request.is_base_allocation(split(Request(traditional_weights=(("AF", 6.0), ("NF", 3.0), ("RF", 1.0)))))
    own = split(Request(traditional_weights=(("AF", 1.0), ("AO", 5.0), ("NF", -1.0))))
    assert own == {"AF": 1.0} and not request.is_base_allocation(own)
    assert split(Request(traditional_weights=(("xx", 1.0),))) == split(Request())
    dim = request.with_split(panel.asset_dim(spark), own)
    assert {r.asset: r.base_weight for r in dim.where("asset_class = 'traditional'").collect()} == {"AF": 1.0, "NF": 0.0, "RF": 0.0}


def test_fingerprints_and_keys_see_every_setting(spark):
    returns = small(spark).select("date", "asset", F.col("price").alias("r"))
    rates = spark.createDataFrame([(D(1996, 1, 1), 0.03)], panel.RATES)
    key = lambda req=Request(), cfg=CFG, r=rates, data=returns: request.analysis_key(data, req, cfg, r)
    keys = [key(), key(cfg=replace(CFG, crypto_share=0.2)), key(cfg=replace(CFG, target_vols=(0.3,))), key(Request(start="1996-01-01")), key(r=rates.withColumn("rf_annual", F.lit(0.031))), key(data=returns.withColumn("r", F.col("r") + 1e-9)), key(cfg=replace(CFG, stability_lookbacks=(4, 8)))]
    assert len(set(keys)) == len(keys) and key() == keys[0]
    assert key(Request(rf_mode="constant")) == key(Request(rf_mode="constant"), r=rates.withColumn("rf_annual", F.lit(0.9)))
    a, b = request.fingerprint(returns, {}), request.fingerprint(returns.withColumn("r", F.col("r") + 1e-15), {})
    assert a["dataset_hash"] == b["dataset_hash"] and a["hash_exact"] != b["hash_exact"]
    assert (a["rows"], a["columns"], a["start"], a["end"]) == (10, ["AF", "AO"], "1996-01-01", "1996-01-05")


def test_a_request_becomes_a_study(spark):
    d = "/root/testdata/sf0.001"
    prices, rates = panel.price_panel(spark, d).persist(), panel.rf_fixings(spark, d).persist()
    made = lambda **asked: request.of_request(Request(**asked), {"frozen": lambda: prices, "synthetic": lambda: prices}, rates, CFG)
    s2 = made(scenario="S2", rf_mode="simple", target_vol=0.2, traditional_weights=(("AF", 2.0), ("RF", 1.0)))
    assert s2.pit is not None and s2.cfg.rf_mode == "simple" and s2.cfg.target_vols == (0.15, 0.2, 0.3, 0.6)
    assert {r.asset: r.base_weight for r in s2.inputs.dim.collect() if r.asset_class == "traditional"} == {"AF": 2.0, "NF": 0.0, "RF": 1.0}
    assert s2.report.first().scenario == "S2" and s2.rate.first()["mode"] == "simple"
    own = made(scenario=None, assets=("AF", "NF", "AO", "zz"), start="1996-01-01", end="1998-12-31", rf_mode="constant")
    assert own.pit is None and {r.asset for r in own.inputs.dim.collect()} == {"AF", "NF", "AO"} and own.spec.members == ("AO",)
    first, last = own.inputs.returns.agg(F.min("date"), F.max("date")).first()
    assert D(1996, 1, 1) < first and last <= D(1998, 12, 31) and own.rate.first()["mean"] == CFG.rf_annual
    table = {r.strategy: r for r in request.backtest(Request(scenario=None, assets=("AF", "NF", "AO"), target_vol=0.2), {"frozen": lambda: prices}, rates, replace(CFG, mdd_limit=-1e-9)).collect()}
    assert "VolControl_0.2" in table and all(r.mdd_breach and not r.cvar_breach for r in table.values())
    assert made(scenario=None, source="synthetic", assets=("AF", "AO")).inputs.returns.select("asset").distinct().count() == 2
    with pytest.raises(ValueError, match="no price"):
        made(scenario=None, start="2030-01-01", end="2031-01-01")
    with pytest.raises(ValueError, match="EUR"):
        made(scenario="S1", base_currency="USD")


def test_precomputed_inference_is_served_by_its_key_only(spark, tmp_path):
    result = spark.createDataFrame([("H1", 0.5)], "name string, p double")
    for key, p in (("k1", 0.5), ("k2", 0.25), ("k1", 0.75)):
        sinks.write_inference(key, "S1", result.withColumn("p", F.lit(p)), str(tmp_path / "inference"))
    assert [r.p for r in sinks.read_inference(spark, "k1", str(tmp_path / "inference")).collect()] == [0.75]
    assert [r.p for r in sinks.read_inference(spark, "k2", str(tmp_path / "inference")).collect()] == [0.25]
    assert sinks.read_inference(spark, "k3", str(tmp_path / "inference")) is None


def test_wide_and_rate_files(spark, tmp_path):
    out = sinks.write_wide(small(spark), str(tmp_path), ["AF", "AO"], "abc")
    assert out.endswith("prices_abc")
    assert rows(spark.read.csv(out, header=True))[0] == ("1996-01-01", "1.0", "1.0")
    sinks.write_rates(spark.createDataFrame([(D(2024, 1, 1), -0.0012345678)], panel.RATES), str(tmp_path / "r"))
    assert rows(spark.read.csv(str(tmp_path / "r"), header=True)) == [("2024-01-01", "-0.00123457")]


def test_exhibits_and_their_register(spark, tmp_path):
    table = spark.createDataFrame([("b", 1234.5, 7), ("a", None, 8), ('say "x;y"', -0.125, 9)], "name string, x double, n long")
    entry = exhibits.write_exhibit(table, f"file://{tmp_path}", "tab_1", "Numbers", ["name"], "cafe", note="a note", chapter="4")
    raw = (tmp_path / "tab_1_cafe.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf# tab_1: Numbers") and raw.count(b"\r\n") == raw.count(b"\n") == 7
    assert raw.decode("utf-8-sig").splitlines()[-4:] == ["name;x;n", "a;\u2014;8", "b;1.234,50;7", '"say ""x;y""";-0,12;9']
    lines = (tmp_path / "tab_1_cafe.txt").read_text().splitlines()
    assert lines[:3] == ["tab_1: Numbers", "scenario S1 | run cafe | source ", ""] and lines[-2:] == ["", "a note"]
    assert lines[3:8] == ["name      |        x | n", "=" * 24, "a         |        \u2014 | 8", "b         | 1.234,50 | 7", 'say "x;y" |    -0,12 | 9']
    shown = [exhibits.Shown("name", "Name"), exhibits.Shown("x", "Share", 1, True)]
    exhibits.write_exhibit(table, str(tmp_path), "tab_1", "Numbers", ["n"], "cafe", shown=shown)
    assert (tmp_path / "tab_1_cafe.csv").read_text("utf-8-sig").splitlines()[2:] == ["Name;Share", "b;123.450,0 %", "a;\u2014", '"say ""x;y""";-12,5 %']
    assert [r.exhibit for r in exhibits.write_register(spark, [entry | {"exhibit": "tab_2", "chapter": "5"}, entry | {"title": "a|b"}], str(tmp_path)).collect()] == ["tab_1", "tab_2"]
    made = (tmp_path / "register.md").read_text().splitlines()
    assert made[0] == "# Exhibits" and made[5] == "|" + " --- |" * 8 and made[6].startswith("| tab_1 | table | 4 | S1 |") and "a\\|b" in made[6]
    assert (tmp_path / "register.csv").read_text("utf-8-sig").splitlines()[1].startswith("exhibit;kind;chapter")
    sinks.write_table(table, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True, sep=";").count() == 3
    with pytest.raises(ValueError, match="10000 rows"):
        exhibits.cells(spark.range(10_001), [exhibits.Shown("id", "id", 0)], ["id"])


def test_archives_hold_no_number_that_json_lacks(spark, tmp_path):
    bad = float("nan")
    df = spark.createDataFrame([("r1", (bad, [1.0, float("inf")]), 2.0)], "record string, deep struct<a: double, b: array<double>>, x double")
    sinks.write_archive(df, str(tmp_path / "a"))
    got = sinks.read_archive(spark, str(tmp_path / "a"), "record string, deep struct<a: double, b: array<double>>, x double").first()
    assert got.deep.a is None and got.deep.b == [1.0, None] and got.x == 2.0
    sinks.write_index(spark, str(tmp_path), [{"record": "r1", "n": 3, "run_hash": "cafe"}], sinks.provenance(spark))
    assert "| r1 | 3 |  | cafe |  |" in (tmp_path / "INDEX.md").read_text()
    assert {"numpy", "spark", "commit", "dirty"} <= set(sinks.provenance(spark))


def test_sheets_and_events(spark):
    s = study.inputs(spark, "/root/testdata/sf0.001")
    sheets = sinks.workbook_sheets(s, CFG, 0.30)
    assert list(sheets) == ["Info", "Returns", "Rates", "Weights", "WeightPath", "Portfolio", "Metrics", "Descriptive", "Sweep", "Regimes", "WalkForward", "Hypotheses"]
    assert sheets["Metrics"].table.count() == 7 and sheets["Sweep"].count() == 21
    cost = spark.createDataFrame([(D(2024, 1, d), 0.1 if d % 2 else 0.0, 0.0) for d in range(1, 31)], "date date, turnover double, cost double")
    assert [r.date.day for r in sample.sleeve_events(cost, 3).collect()] == [1, 3, 5]
    study.release(s)


def test_report_families(spark):
    s = study.inputs(spark, "/root/testdata/sf0.001")
    got = {r.name: r for r in hypotheses.report(s, CFG, 0.30).collect()}
    families = {"p_holm": ["H1", "H2", "H3 d_mdd", "H3 d_cvar"], "p_holm_with_wilcoxon": ["H1", "H2", "H3 d_mdd", "H3 d_cvar", "Wilcoxon"], "p_holm_sweep_level": ["H1", "H2", "HAC d_mdd", "HAC d_cvar"]}
    for column, starts in families.items():
        inside = sorted((r for n, r in got.items() if any(n.startswith(x) for x in starts)), key=lambda r: (r.p, r.name))
        assert len(inside) == len(starts) and all(r[column] is None for r in got.values() if r not in inside)
        worst = 0.0
        for i, r in enumerate(inside):
            worst = max(worst, min((len(inside) - i) * r.p, 1.0))
            assert math.isclose(r[column], worst, abs_tol=1e-12)
    assert len(got) == 13 and 0 <= got["Deflated Sharpe ratio"].estimate <= 1


def test_rows_over_samples(spark):
    d = "/root/testdata/sf0.001"
    prices = sample.late_listing(panel.price_panel(spark, d), {"NO": "1996-03-01"}).persist()
    got = hypotheses.over_samples(prices, [sample.scenario("S2")], panel.rf_fixings(spark, d), panel.asset_dim(spark), CFG, 0.30).collect()
    assert [r.scenario for r in got] == ["S2"] and all(r.h1_estimate is not None and 0 <= r.best_share <= 0.5 for r in got)


def test_every_table_of_a_study_is_written(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    prices = panel.price_panel(spark, d).persist()
    made = study_exhibits.tables(study.inputs(spark, d), prices, CFG, 0.30, [sample.scenario("S3")])
    register = study_exhibits.write_all(made, str(tmp_path), "cafe", environment=sinks.provenance(spark)).collect()
    names = {"3_1", "3_2", "3_3", "3_4", *(f"4_{i}" for i in range(1, 14)), "a_1"}
    assert {r.exhibit for r in register} == {f"tab_{n}" for n in names}
    for r in register:
        lines = (tmp_path / f"{r.exhibit}_cafe.txt").read_text().splitlines()
        assert lines[0] == f"{r.exhibit}: {r.title}" and len(lines) >= (5 if r.exhibit == "tab_4_8" else 6), r.exhibit
    metrics_lines = (tmp_path / "tab_4_1_cafe.csv").read_text("utf-8-sig").splitlines()
    assert metrics_lines[3].startswith("Strategy;Return p.a.;CAGR") and len(metrics_lines) == 4 + 7
    want = {r.strategy: r for r in study.metrics_table(study.run_strategies(study.inputs(spark, d), CFG), CFG).collect()}
    for line in metrics_lines[4:]:
        cells = line.split(";")
        assert abs(float(cells[1].removesuffix(" %").replace(".", "").replace(",", ".")) / 100 - want[cells[0]].ann_return) < 6e-5
    assert (tmp_path / "register.md").read_text().count("\n| tab_") == 18
