"""Background jobs, workbooks read from their own format, and saved rate responses."""

import datetime
import math
import re
import string
import time
import zipfile
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.plans.jobs import Jobs
from panelforge.sources import panel, workbook

D = datetime.date


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


def test_jobs_are_run_once_and_their_results_expire(spark):
    clock, runs = Clock(), []
    jobs = Jobs(spark, keep=2, ttl=10, clock=clock)

    def plan(n):
        runs.append(n)
        return spark.range(n)

    for n in (3, 3, 4):
        assert jobs.submit(f"k{n}", lambda n=n: plan(n)) == f"k{n}"
        assert jobs.wait(f"k{n}", 60) == "done"
    assert runs == [3, 4] and jobs.result("k3").count() == 3 and jobs.status("k4")["state"] == "done"
    jobs.submit("k3", lambda: plan(3))
    jobs.submit("k5", lambda: plan(5))
    assert jobs.wait("k5", 60) == "done"
    with pytest.raises(KeyError, match="k4"):
        jobs.status("k4")  # least recently asked of three
    kept = jobs.result("k5")
    clock.now = 11
    with pytest.raises(KeyError, match="expired"):
        jobs.result("k5")
    with pytest.raises(Exception):
        kept.count()
    jobs.submit("k5", lambda: plan(5))
    assert jobs.wait("k5", 60) == "done" and runs == [3, 4, 5, 5]


def test_jobs_fail_and_are_cancelled(spark):
    jobs = Jobs(spark, workers=1)
    jobs.submit("bad", lambda: spark.range(1).select("nothing"))
    assert jobs.wait("bad", 60) == "failed" and "nothing" in jobs.status("bad")["error"]
    with pytest.raises(RuntimeError, match="failed"):
        jobs.result("bad")
    slow = lambda: spark.range(0, 10**13, 1, 16).agg(F.sum(F.sqrt(F.col("id") * 3.0)).alias("s"))
    jobs.submit("slow", slow)
    jobs.submit("waits", lambda: spark.range(1))
    until = time.monotonic() + 60
    while not jobs.status("slow")["tasks"] and time.monotonic() < until:
        time.sleep(0.1)
    assert jobs.status("slow")["state"] == "running" and jobs.status("waits")["state"] == "queued"
    jobs.cancel("waits")
    jobs.cancel("slow")
    assert jobs.wait("slow", 60) == "cancelled" and jobs.wait("waits", 60) == "cancelled"
    jobs.submit("slow", lambda: spark.range(2))
    assert jobs.wait("slow", 60) == "done" and jobs.result("slow").count() == 2


def book(path, rows, shared=(), sheet="Prices_EUR", later=False):
    """A workbook by hand: rows of cells (reference, kind, value)."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(ref, kind, value):
        if kind == "inlineStr":
            return f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>'
        return f'<c r="{ref}"' + (f' t="{kind}"' if kind != "n" else "") + (f"><v>{value}</v></c>" if value != "" else "/>")

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><workbookPr date1904="{int(later)}"/><sheets><sheet name="Other" sheetId="1" r:id="a"/><sheet name="{sheet}" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join("<row>" + "".join(cell(*c) for c in r) + "</row>" for r in rows) + "</sheetData></worksheet>")


def test_a_workbook_is_the_csv_of_its_sheet(spark, tmp_path):
    rows = [[], [("A1", "s", 0), ("B1", "s", 1), ("C1", "inlineStr", "b"), ("AA1", "s", 2)]]
    rows += [[("A2", "n", 45292), ("B2", "n", 1.5), ("C2", "n", ""), ("AA2", "n", "1E2")]]  # 2024-01-01 as a serial day
    rows += [[("A3", "n", 45293.75), ("B3", "e", "#N/A"), ("C3", "str", "2.5"), ("D3", "n", 9)]]  # with a time, no header over D
    rows += [[("A4", "inlineStr", "2024-01-03"), ("B4", "s", 3), ("C4", "n", -1)], [("B5", "n", 7)], [("A6", "inlineStr", "total"), ("B6", "n", 7)], [("A7", "d", "2024-01-04T00:00:00"), ("B7", "n", 4)]]
    book(tmp_path / "p.xlsx", rows, ["Date", "a", "late", "n/a"])
    (tmp_path / "p.csv").write_text("date,a,b,late\n2024-01-01,1.5,,100\n2024-01-02,,2.5,\n2024-01-03,,-1,\n2024-01-04,4,,\n")
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(panel.wide_csv(spark, str(tmp_path / "p.csv"), ["a", "b", "late"]))
    assert key(workbook.workbook_prices(spark, str(tmp_path / "p.xlsx"))) == want
    assert key(workbook.workbook_prices(spark, f"file://{tmp_path}/p.xlsx", assets=["b"])) == [r for r in want if r[1] == "b"]
    with pytest.raises(Exception, match="no sheet 'Nothing'"):
        workbook.workbook_prices(spark, str(tmp_path / "p.xlsx"), "Nothing").count()


def test_workbooks_of_a_folder_and_of_the_other_day_count(spark, tmp_path):
    for k in range(3):
        book(tmp_path / f"p{k}.xlsx", [[("A1", "inlineStr", "d"), ("B1", "inlineStr", "a")], *[[(f"A{i}", "n", 100 * k + i), (f"B{i}", "n", i)] for i in range(2, 60)]], later=True)
    got = workbook.workbook_prices(spark, f"{tmp_path}/*.xlsx")
    assert got.count() == 3 * 58 and got.agg(F.min("date")).first()[0] == D(1904, 1, 3)
    book(tmp_path / "empty.xlsx", [])
    assert workbook.workbook_prices(spark, str(tmp_path / "empty.xlsx")).count() == 0


def test_saved_rate_responses_are_chained(spark, tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "a.csv").write_text("KEY,FREQ,TIME_PERIOD,OBS_VALUE,OBS_STATUS\nEON.D,D,2019-09-30,2.0,A\nEON.D,D,2019-10-01,2.0,A\nX.D,D,2019-09-30,9.0,A\n")
    (tmp_path / "old" / "b.csv").write_text("OBS_VALUE,KEY,TIME_PERIOD\n,EON.D,2019-09-27\n1.5,EON.D,2019-08\n2.5,EON.D,2019-09-30\n")
    (tmp_path / "new.csv").write_text("KEY,TIME_PERIOD,OBS_VALUE\nEST.B,2019-09-30,50\nEST.B,2019-10-01,-0.5\n")
    read = lambda name, **by: panel.sdmx_rates(spark, str(tmp_path / name), **by)
    first = [read(f"old/{n}.csv", key="EON.D") for n in "ab"]
    assert sorted(map(tuple, first[1].collect())) == [(D(2019, 8, 1), 0.015), (D(2019, 9, 30), 0.025)]
    chained = panel.chained_rates(first[0], read("new.csv", start="2019-09-15"), "2019-10-01")
    assert sorted(map(tuple, chained.collect())) == [(D(2019, 9, 30), pytest.approx(0.01915)), (D(2019, 10, 1), -0.005)]


def computed(path, sheet):
    """The cells of a sheet by reference: values, and formulas as they stand."""
    main = workbook._MAIN
    with zipfile.ZipFile(path) as z:
        part, _ = workbook._sheet(z, sheet)
        shared = workbook._strings(z)
        out = {}
        for c in ElementTree.fromstring(z.read(part)).iter(f"{main}c"):
            f, v = c.find(f"{main}f"), c.find(f"{main}v")
            out[c.get("r")] = f"={f.text}" if f is not None else shared[int(v.text)] if c.get("t") == "s" else float(v.text)
        return out


class Calculator:
    """Just the functions that the workbook uses, over its own cells."""

    def __init__(self, path):
        self.sheets = {name: computed(path, name) for name in ("Portfolio", "Metrics")}
        for ref in sorted(self.sheets["Portfolio"], key=lambda r: (int(r.lstrip(string.ascii_uppercase)), len(r), r)):
            self.value("Portfolio", ref)

    def range(self, text):
        (column, a), (_, b) = re.findall(r"([A-Z]+)(\d+)", text)
        return np.array([self.value("Portfolio", f"{column}{i}") for i in range(int(a), int(b) + 1)])

    def value(self, sheet, ref):
        found = self.sheets[sheet][ref]
        if isinstance(found, str) and found.startswith("="):
            self.sheets[sheet][ref] = found = self.formula(sheet, found[1:])
        return found

    def formula(self, sheet, text):
        text = re.sub(r'AVERAGEIF\((?:Portfolio!)?([A-Z0-9:]+),"<="&PERCENTILE\((?:Portfolio!)?[A-Z0-9:]+,([\d.]+)\)\)', lambda m: repr(float((lambda x: x[x <= np.quantile(x, float(m[2]))].mean())(self.range(m[1])))), text)
        call = {"AVERAGE": np.mean, "STDEV": lambda x: np.std(x, ddof=1), "MIN": np.min, "MAX": np.max, "SUM": np.sum, "COUNT": len}
        text = re.sub(r"(AVERAGE|STDEV|MIN|MAX|SUM|COUNT)\((?:Portfolio!)?([A-Z]+\d+:[A-Z]+\d+)\)", lambda m: repr(float(call[m[1]](self.range(m[2])))), text)
        text = re.sub(r"(?:Portfolio!)?\b([A-Z]+\d+)\b", lambda m: f"({self.value('Portfolio', m[1])!r})", text)
        return float(eval(text.replace("^", "**").replace("SQRT", "math.sqrt"), {"math": math}))


def test_formulas_of_the_workbook_give_the_metrics(spark, tmp_path):
    from panelforge.config import Config
    from panelforge.plans import study
    from panelforge.sources import sinks

    cfg, s = Config(), study.inputs(spark, "/root/testdata/sf0.001")
    rows = study.run_strategies(s, cfg)
    table = study.metrics_table(rows, cfg)
    odd = spark.createDataFrame([('a "b" <c> & d', None, True, float("nan")), (" padded ", D(2024, 2, 29), False, 1e-300)], "text string, day date, flag boolean, x double")
    path = f"{tmp_path}/book.xlsx"
    workbook.write_workbook({**sinks.live_sheets(rows, table, cfg), 'odd "names"': odd}, path)
    calculator = Calculator(path)
    header = {v: k.rstrip("1") for k, v in calculator.sheets["Metrics"].items() if re.fullmatch(r"[A-Z]+1", k)}
    names = ("ann_return", "cagr", "ann_vol", "sharpe", "max_drawdown", "cvar", "turnover")
    for n in range(2, 2 + table.count()):
        for name in names:
            assert calculator.value("Metrics", f"{header[name + '_live']}{n}") == pytest.approx(calculator.value("Metrics", f"{header[name]}{n}"), abs=1e-9), (n, name)
    cells = computed(path, 'odd "names"')
    assert cells["A2"] == 'a "b" <c> & d' and "B2" not in cells and cells["C2"] == 1 and "D2" not in cells
    assert cells["A3"] == " padded " and workbook.day_of(str(cells["B3"]), False) == D(2024, 2, 29) and cells["D3"] == 1e-300


def test_written_sheets_are_read_again(spark, tmp_path):
    wide = spark.createDataFrame([(D(2024, 1, 1), 1.5, None), (D(2024, 1, 2), None, 2.5)], "date date, a double, b double")
    workbook.write_workbook({"Prices_EUR": workbook.Sheet(wide, ["date"])}, f"file://{tmp_path}/p.xlsx")
    assert sorted(map(tuple, workbook.workbook_prices(spark, f"{tmp_path}/p.xlsx").collect())) == [(D(2024, 1, 1), "a", 1.5), (D(2024, 1, 2), "b", 2.5)]
    assert [workbook.letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and all(workbook._column(workbook.letters(i) + "1") == i for i in range(2000))
