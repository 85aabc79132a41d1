"""Sinks: wide CSV, large tables, archives by record, the sheets of a study's workbook, and where a result came from."""

from __future__ import annotations

import os
import platform
import subprocess
import sys
from importlib.metadata import version

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exhibits import _fixed, german, write_lines
from .workbook import Sheet, letters


def write_wide(prices: DataFrame, path: str, assets: list[str], run_hash: str) -> str:
    """The sample's price matrix, a column an asset, as one CSV folder whose name carries the hash."""
    target = f"{path}/prices_{run_hash}"
    wide = prices.groupBy("date").pivot("asset", assets).agg(F.first("price"))
    wide.orderBy("date").coalesce(1).write.mode("overwrite").csv(target, header=True)
    return target


def write_table(table: DataFrame, path: str, digits: int = 2) -> None:
    """A table of any size with semicolons and German numbers, one file a task."""
    shown = [german(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in table.dtypes]
    table.select(*shown).write.mode("overwrite").csv(path, header=True, sep=";")


def json_safe(value: Column, kind: T.DataType) -> Column:
    """A value without NaN and infinities, which become null, at any depth of structs and arrays."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[json_safe(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def write_archive(records: DataFrame, path: str) -> None:
    """JSON lines, a folder a record; NaN and infinite values are null."""
    clean = [json_safe(F.col(f.name), f.dataType).alias(f.name) for f in records.schema.fields]
    records.select(*clean).write.mode("overwrite").partitionBy("record").json(path)


def write_index(spark: SparkSession, path: str, entries: list[dict], environment: dict[str, str]) -> None:
    """INDEX.md of an archive: what made it, and record, dates, hashes and run time of each of its records."""
    columns = ["record", "n", "dataset_hash", "run_hash", "runtime_seconds"]
    lines = ["# Archive", "", *[f"- {k}: {v}" for k, v in environment.items()], "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(str(e.get(c, "")) for c in columns) + " |" for e in entries]
    write_lines(_fixed(spark, 0, lines), f"{path}/INDEX.md")


def write_inference(key: str, scenario: str, result: DataFrame, path: str) -> None:
    """A precomputed report under its analysis key; a key that is there is replaced."""
    keyed = result.select(F.lit(scenario).alias("scenario"), *result.columns, F.lit(key).alias("key"))
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(path)


def read_inference(spark: SparkSession, key: str, path: str) -> DataFrame | None:
    """The report of that key, or None: what was computed under other settings is never served."""
    found = spark.read.parquet(path).where(F.col("key") == key)
    return None if found.isEmpty() else found.drop("key")


def read_archive(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_rates(rates: DataFrame, path: str) -> None:
    """date and rate with eight digits."""
    rates.select("date", F.format_string("%.8f", "rf_annual").alias("rf_annual")).orderBy("date").coalesce(1).write.mode("overwrite").csv(path, header=True)


def live_sheets(rows: DataFrame, table: DataFrame, cfg) -> dict[str, Sheet]:
    """Portfolio, with excess return, wealth and drawdown of each date as formulas of the cells before, and Metrics, with each metric beside
    its formula over the strategy's part of Portfolio."""
    rows = rows.select("strategy", "date", "r", "rf", "gross", "exposure", "turnover_exposure", "turnover_sleeve", "turnover")
    at = {c: letters(i) for i, c in enumerate([*rows.columns, "excess", "wealth", "drawdown"])}
    spans, first = {}, 2
    for r in rows.groupBy("strategy").count().orderBy("strategy").collect():  # a number a strategy
        spans[r.strategy] = (first, first + r["count"] - 1)
        first += r["count"]
    begins = {a for a, _ in spans.values()}
    growth = lambda n, _: f"1+{at['r']}{n}" if n in begins else f"{at['wealth']}{n - 1}*(1+{at['r']}{n})"
    fall = lambda n, row: f"{at['wealth']}{n}/MAX({at['wealth']}{spans[row['strategy']][0]}:{at['wealth']}{n})-1"
    portfolio = Sheet(rows, ["strategy", "date"], {"excess": lambda n, _: f"{at['r']}{n}-{at['rf']}{n}", "wealth": growth, "drawdown": fall})

    def over(column: str, row) -> str:
        a, b = spans[row["strategy"]]
        return f"Portfolio!{at[column]}{a}:{at[column]}{b}"

    days = cfg.trading_days
    live = {
        "ann_return_live": lambda n, row: f"AVERAGE({over('r', row)})*{days}",
        "cagr_live": lambda n, row: f"Portfolio!{at['wealth']}{spans[row['strategy']][1]}^({days}/COUNT({over('r', row)}))-1",
        "ann_vol_live": lambda n, row: f"STDEV({over('r', row)})*SQRT({days})",
        "sharpe_live": lambda n, row: f"AVERAGE({over('excess', row)})/STDEV({over('excess', row)})*SQRT({days})",
        "max_drawdown_live": lambda n, row: f"MIN({over('drawdown', row)})",
        "cvar_live": lambda n, row: f"AVERAGEIF({over('r', row)},\"<=\"&PERCENTILE({over('r', row)},{cfg.cvar_alpha}))",
        "turnover_live": lambda n, row: f"SUM({over('turnover', row)})",
    }
    return {"Portfolio": portfolio, "Metrics": Sheet(table, ["strategy"], live)}


def workbook_sheets(study, cfg, target: float) -> dict[str, DataFrame | Sheet]:
    """The sheets of a study's workbook: tables, and formulas where a number can be followed (see live_sheets)."""
    from ..operators import metrics, strategies
    from ..plans import hypotheses
    from ..plans import study as plans

    spark = study.returns.sparkSession
    rows = plans.run_strategies(study, cfg)
    weights = strategies.class_weights(study.dim, plans.shares_of(spark, [cfg.crypto_share]))
    controlled = plans.controlled(study, cfg)
    live = live_sheets(rows, plans.metrics_table(rows, cfg), cfg)
    info = [(k, str(v)) for k, v in {**provenance(spark), **vars(cfg)}.items()]
    names = [r.asset for r in study.dim.select("asset").orderBy("asset").collect()]
    return {
        "Info": spark.createDataFrame(info, "setting string, value string"),
        "Returns": study.returns.groupBy("date").pivot("asset", names).agg(F.first("r")).orderBy("date"),
        "Rates": plans.rate_series(study, cfg).orderBy("date"),
        "Weights": weights,
        "WeightPath": strategies.held_weights(study.returns, weights.drop("share"), cfg.weight_rebalance).groupBy("date").pivot("asset", names).agg(F.first("w")).orderBy("date"),
        **live,
        "Descriptive": metrics.tail_marks(study.returns, ["asset"], cfg.cvar_alpha),
        "Sweep": plans.crypto_sweep(study, cfg, target).orderBy("share"),
        "Regimes": plans.subperiods(rows, study, cfg),
        "WalkForward": plans.walk_forward(controlled, cfg)[0],
        "Hypotheses": hypotheses.report(study, cfg, target),
    }


_captured: dict[str, str] = {}


def provenance(spark: SparkSession) -> dict[str, str]:
    """Interpreter, platform, libraries, Spark, and the library's source revision, taken once before anything is written."""
    if not _captured:
        here = os.path.dirname(os.path.abspath(__file__))
        git = lambda *a: subprocess.run(["git", "-C", here, *a], capture_output=True, text=True).stdout.strip()
        _captured.update(commit=git("rev-parse", "HEAD"), dirty=str(bool(git("status", "--porcelain"))).lower())
    return {
        "python": sys.version.split()[0],
        "platform": platform.platform(),
        **{name: version(name) for name in ("numpy", "pandas", "pyarrow", "pyspark")},
        "spark": spark.version,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "adaptive": spark.conf.get("spark.sql.adaptive.enabled"),
        **_captured,
    }
