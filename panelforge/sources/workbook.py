"""Workbooks of the open spreadsheet format, read and written in the format itself: a zip of XML parts, no library.

Reading: files come as bytes through Spark's binary source, so they may lie in any store that Spark reads. A file is a task; of its sheets only the asked one
is parsed, row by row, and of its columns only the asked ones are kept.

Writing: a sheet's rows stream through the driver, one partition at a time, into the zip; a workbook is one file for people, of MAX_SHEET_ROWS rows a
sheet at most. Columns may be formulas, so that a reader can follow a number to the cells it comes from.
"""

from __future__ import annotations

import datetime
import io
import os
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: namespaces, and the day before serial day 1 (with the format's leap day in 1900) or the first day of the other count.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DAY_ZERO = {False: datetime.date(1899, 12, 30), True: datetime.date(1904, 1, 1)}
_ISO = re.compile(r"\d{4}-\d{2}-\d{2}")


def _sheet(book: zipfile.ZipFile, name: str) -> tuple[str, bool]:
    """The part of a sheet, and whether days count from 1904."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    later = (p := root.find(f"{_MAIN}workbookPr")) is not None and p.get("date1904") in ("1", "true")
    for sheet in root.iter(f"{_MAIN}sheet"):
        if sheet.get("name") == name:
            target = links[sheet.get(f"{_REL}id")]
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}", later
    raise ValueError(f"no sheet {name!r}; the workbook has {[s.get('name') for s in root.iter(f'{_MAIN}sheet')]}")


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]


def _column(reference: str) -> int:
    """B7 is column 1."""
    out = 0
    for c in reference:
        if not c.isalpha():
            break
        out = out * 26 + ord(c.upper()) - 64
    return out - 1


def sheet_rows(content: bytes, sheet: str) -> Iterator[tuple[dict[int, str], bool]]:
    """(column number to text, do days count from 1904) of every row of a sheet; empty cells and errors are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        part, later = _sheet(book, sheet)
        shared = _strings(book)
        with book.open(part) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                found, place = {}, 0
                for cell in row.iter(f"{_MAIN}c"):
                    place = _column(cell.get("r")) if cell.get("r") else place
                    kind, value = cell.get("t", "n"), cell.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif value is None or value.text is None or kind == "e":
                        text = ""
                    else:
                        text = shared[int(value.text)] if kind == "s" else value.text
                    if text.strip():
                        found[place] = text.strip()
                    place += 1
                yield found, later
                row.clear()


def day_of(text: str, later: bool) -> datetime.date | None:
    """A day as a serial number (with a time of day or not), or as text that begins with an ISO date."""
    if _ISO.match(text):
        return datetime.date.fromisoformat(text[:10])
    try:
        return _DAY_ZERO[later] + datetime.timedelta(days=int(float(text)))
    except (ValueError, OverflowError):
        return None


def wide_sheet(spark: SparkSession, path: str, sheet: str, columns: list[str] | None = None, name: str = "asset", value: str = "price") -> DataFrame:
    """date, name, value of a sheet with dates in the first column and a series in each other one, in long form.

    The header is the first row that has cells. Rows without a date, cells that are no finite numbers and columns without a header are left out. columns: those wanted
    (all, if None). path: a file, a folder or a pattern.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.date32(), pa.string(), pa.float64()))], names=["date", name, value])

        for batch in batches:
            for content in batch.column(0).to_pylist():
                header, out = None, []
                for cells, later in sheet_rows(content, sheet):
                    if header is None:
                        header = {i: c for i, c in cells.items() if i and (columns is None or c in columns)} if cells else None
                        continue
                    day = day_of(cells[0], later) if 0 in cells else None
                    if day is None:
                        continue
                    for i, series in header.items():
                        try:
                            number = float(cells[i])
                        except (KeyError, ValueError):
                            continue
                        if abs(number) < float("inf"):
                            out.append((day, series, number))
                    if len(out) > 50_000:
                        yield made(out)
                        out = []
                yield made(out)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, f"date date, `{name}` string, `{value}` double")


def workbook_prices(spark: SparkSession, path: str, sheet: str = "Prices_EUR", assets: list[str] | None = None) -> DataFrame:
    """date, asset, price of a sheet of prices."""
    return wide_sheet(spark, path, sheet, assets).where(F.col("price").isNotNull())


#: Rows that a sheet of the format may hold, but for some.
MAX_SHEET_ROWS = 1_000_000
_OFFICE, _PACKAGE = _REL[1:-1], "http://schemas.openxmlformats.org/package/2006"


@dataclass(frozen=True)
class Sheet:
    """A table in an order, and further columns of formulas: each is a function of the row's number in the sheet (the header is row 1)
    and of the row."""

    table: DataFrame
    order: Sequence[str] = ()
    formulas: Mapping[str, Callable[[int, object], str]] = field(default_factory=dict)


def letters(column: int) -> str:
    """Column 0 is A, 26 is AA."""
    out = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(reference: str, value: object, strings: dict[str, int]) -> str:
    if value is None or isinstance(value, float) and (value != value or abs(value) == float("inf")):
        return ""
    if isinstance(value, bool):
        return f'<c r="{reference}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{reference}"><v>{value!r}</v></c>'
    if isinstance(value, datetime.datetime):
        value = value.date()
    if isinstance(value, datetime.date):
        return f'<c r="{reference}" s="1"><v>{(value - _DAY_ZERO[False]).days}</v></c>'
    return f'<c r="{reference}" t="s"><v>{strings.setdefault(str(value), len(strings))}</v></c>'


def _sheet_xml(sheet: Sheet, strings: dict[str, int]) -> Iterator[str]:
    ordered = sheet.table.orderBy(*sheet.order) if sheet.order else sheet.table
    columns = [*sheet.table.columns, *sheet.formulas]
    yield f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData><row r="1">'
    yield "".join(_cell(f"{letters(i)}1", c, strings) for i, c in enumerate(columns)) + "</row>"
    for n, row in enumerate(ordered.toLocalIterator(), 2):
        if n > MAX_SHEET_ROWS + 1:
            raise ValueError(f"a sheet has at most {MAX_SHEET_ROWS} rows")
        cells = [_cell(f"{letters(i)}{n}", v, strings) for i, v in enumerate(row)]
        cells += [f'<c r="{letters(len(row) + i)}{n}"><f>{escape(f(n, row))}</f></c>' for i, f in enumerate(sheet.formulas.values())]
        yield f'<row r="{n}">' + "".join(cells) + "</row>"
    yield "</sheetData></worksheet>"


def write_workbook(sheets: Mapping[str, Sheet | DataFrame], path: str) -> None:
    """The sheets as one workbook at `path`, in any file system that Spark knows. Null and non-finite cells stay empty; programs compute the formulas when they open it."""
    strings: dict[str, int] = {}
    names = list(sheets)
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    own = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = [("workbook", "sheet.main"), ("styles", "styles"), ("sharedStrings", "sharedStrings"), *((f"worksheets/sheet{i}", "worksheet") for i in range(1, len(names) + 1))]
    handle, local = tempfile.mkstemp(suffix=".xlsx")
    os.close(handle)
    with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as book:
        for i, name in enumerate(names, 1):
            sheet = sheets[name] if isinstance(sheets[name], Sheet) else Sheet(sheets[name])
            spark = sheet.table.sparkSession
            with book.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as f:
                for text in _sheet_xml(sheet, strings):
                    f.write(text.encode())
        types = "".join(f'<Override PartName="/xl/{part}.xml" ContentType="{own}.{kind}+xml"/>' for part, kind in parts)
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_OFFICE}"><sheets>{listed}</sheets><calcPr fullCalcOnLoad="1"/></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        links += "".join(f'<Relationship Id="{k}" Type="{_OFFICE}/{k}" Target="{k}.xml"/>' for k in ("styles", "sharedStrings"))
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
        kinds = '<xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/><xf numFmtId="14" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"/>'
        book.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{_MAIN[1:-1]}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2">{kinds}</cellXfs></styleSheet>')
        book.writestr("xl/sharedStrings.xml", f'{head}<sst xmlns="{_MAIN[1:-1]}">' + "".join(f'<si><t xml:space="preserve">{escape(t)}</t></si>' for t in strings) + "</sst>")
    at = spark._jvm.org.apache.hadoop.fs.Path
    at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).moveFromLocalFile(at(f"file://{local}"), at(path))
