"""Exhibits: a small table as lines of text that Spark makes, in one file for programs and one for readers, and their register.

A file is a DataFrame of lines (part, place, line) until it is written: head, table and foot are parts, and widths of
columns are an aggregate. Files are written by Spark's text sink and moved into place by the file system of their path, so a folder may
lie in any store that Spark reaches.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import constants

#: Rows of an exhibit; larger tables have other sinks.
MAX_ROWS = 10_000
NOTHING = "—"
ENTRY = ("exhibit", "kind", "chapter", "scenario", "source", "run_hash", "files", "title")


@dataclass(frozen=True)
class Shown:
    """A column of a table as an exhibit shows it: digits None is text as it is, 0 a whole number; percent is times 100."""

    column: str
    label: str
    digits: int | None = None
    percent: bool = False


def german(x: Column, digits: int = 2) -> Column:
    """1234.5 as 1.234,50."""
    return F.translate(F.format_number(x, digits), ".,", ",.")


def interval(low: str, high: str, digits: int, percent: bool = False) -> Column:
    """[low; high]."""
    a, b = (_text(Shown(c, "", digits, percent)) for c in (low, high))
    return F.concat(F.lit("["), a, F.lit("; "), b, F.lit("]"))


def _text(of: Shown) -> Column:
    value = F.col(of.column)
    if of.digits is not None:
        number = german(value * 100 if of.percent else value, of.digits)
        value = F.concat(number, F.lit(" %")) if of.percent else number
    return F.coalesce(value.cast("string"), F.lit(NOTHING))


def shown_as_they_are(table: DataFrame, digits: int = 2) -> list[Shown]:
    """Every column under its own name, doubles with that many digits."""
    return [Shown(c, c, digits if t in ("double", "float") else None) for c, t in table.dtypes]


def cells(table: DataFrame, shown: Sequence[Shown], order: Sequence[str | Column]) -> DataFrame:
    """place (from 1, by order) and c0, c1, ... (text) of a table of MAX_ROWS rows at most."""
    few = table.limit(MAX_ROWS + 1)
    if few.count() > MAX_ROWS:
        raise ValueError(f"an exhibit has at most {MAX_ROWS} rows; write_table takes larger tables")
    return few.select(F.row_number().over(Window.orderBy(*order)).alias("place"), *[_text(s).alias(f"c{i}") for i, s in enumerate(shown)])


def _part(lines: DataFrame, part: int) -> DataFrame:
    return lines.select(F.lit(part).alias("part"), F.col("place").cast("int").alias("place"), "line")


def _fixed(spark: SparkSession, part: int, lines: Sequence[str]) -> DataFrame | None:
    return _part(constants(spark, list(enumerate(lines)), "place int, line string"), part) if lines else None


def _joined(*parts: DataFrame | None) -> DataFrame:
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])


def _with_header(body: DataFrame, shown: Sequence[Shown]) -> DataFrame:
    labels = constants(body.sparkSession, [(0, *[s.label for s in shown])], "place int, " + ", ".join(f"c{i} string" for i in range(len(shown))))
    return body.unionByName(labels)


def machine_lines(body: DataFrame, shown: Sequence[Shown], about: Sequence[str]) -> DataFrame:
    """Semicolons, after a byte order mark and comment lines; a cell with a separator, a quote or a line break is quoted."""
    quoted = [F.when(c.rlike('[;"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in (F.col(f"c{i}") for i in range(len(shown)))]
    table = _part(_with_header(body, shown).select("place", F.concat_ws(";", *quoted).alias("line")), 1)
    head = [f"# {line}" for line in about if line]
    return _joined(_fixed(body.sparkSession, 0, ["﻿" + head[0], *head[1:]]), table)


def reader_lines(body: DataFrame, shown: Sequence[Shown], about: Sequence[str], note: str) -> DataFrame:
    """Columns padded to their widest cell, the first to the right, the others to the left of it."""
    names = [f"c{i}" for i in range(len(shown))]
    whole = _with_header(body, shown)
    widths = whole.agg(*[F.max(F.length(c)).alias(f"w{c}") for c in names])
    padded = [(F.lpad if i else F.rpad)(F.col(c), F.col(f"w{c}"), F.lit(" ")) for i, c in enumerate(names)]
    rows = whole.crossJoin(F.broadcast(widths)).select("place", F.concat_ws(" | ", *padded).alias("line"))
    header = rows.where("place = 0")
    rule = header.select("place", F.repeat(F.lit("="), F.length("line")).alias("line"))
    return _joined(_fixed(body.sparkSession, 0, [*about, ""]), _part(header, 1), _part(rule, 2), _part(rows.where("place > 0"), 3), _fixed(body.sparkSession, 4, ["", note] if note else []))


def write_lines(lines: DataFrame, path: str, end: str = "\n") -> None:
    """lines (part, place, line) as the one file `path`, in any file system that Spark knows."""
    spark = lines.sparkSession
    folder = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    lines.repartition(1).sortWithinPartitions("part", "place").select("line").write.option("lineSep", end).text(folder)
    at = spark._jvm.org.apache.hadoop.fs.Path
    system = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    made = next(f.getPath() for f in system.listStatus(at(folder)) if f.getPath().getName().startswith("part-"))
    system.delete(at(path), False)
    system.rename(made, at(path))
    system.delete(at(folder), True)


def write_exhibit(table: DataFrame, folder: str, ident: str, title: str, order: Sequence[str | Column], run_hash: str, scenario: str = "S1", source: str = "", note: str = "", chapter: str = "", shown: Sequence[Shown] | None = None) -> dict[str, str]:
    """<ident>_<run_hash>.csv and .txt of a small table; returns its entry of the register."""
    shown = shown or shown_as_they_are(table)
    body = cells(table, shown, order).persist()
    name, about = f"{ident}_{run_hash}", [f"{ident}: {title}", f"scenario {scenario} | run {run_hash} | source {source}"]
    write_lines(machine_lines(body, shown, [*about, note]), f"{folder}/{name}.csv", "\r\n")
    write_lines(reader_lines(body, shown, about, note), f"{folder}/{name}.txt")
    body.unpersist()
    return dict(zip(ENTRY, (ident, "table", chapter, scenario, source, run_hash, f"{name}.csv, {name}.txt", title), strict=True))


def write_register(spark: SparkSession, entries: Sequence[dict[str, str]], folder: str) -> DataFrame:
    """register.csv and register.md (a table) of exhibits in the order of chapters; returns the register."""
    found = constants(spark, [tuple(e[c] for c in ENTRY) for e in entries], ", ".join(f"{c} string" for c in ENTRY)).orderBy("chapter", "exhibit")
    shown = shown_as_they_are(found)
    body = cells(found, shown, ["chapter", "exhibit"])
    write_lines(machine_lines(body, shown, ["exhibits"]), f"{folder}/register.csv", "\r\n")
    cell = lambda i: F.replace(F.col(f"c{i}"), F.lit("|"), F.lit("\\|"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(i) for i in range(len(shown))]), F.lit(" |"))
    rows = _with_header(body, shown).select("place", row.alias("line"))
    rule = _fixed(spark, 2, ["|" + " --- |" * len(shown)])
    write_lines(_joined(_fixed(spark, 0, ["# Exhibits", "", f"{len(entries)} exhibits.", ""]), _part(rows.where("place = 0"), 1), rule, _part(rows.where("place > 0"), 3)), f"{folder}/register.md")
    return found
