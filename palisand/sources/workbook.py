"""Workbooks (.xlsx) in and out, with the standard library only: a workbook is a zip of XML.

In: Spark reads the files' bytes from any store, and each file's sheets are parsed in a task, row by row.  Out: a data source whose tasks
write ranges of rows as pieces of a sheet into a folder beside the workbook; the commit joins the pieces into one file, which appears at once when it is
whole, and an abort leaves nothing.  Path and folder must be one that the driver and all executors see as files.

Cases: null is an empty cell, NaN and infinite numbers are written as text; a sheet without rows has its header; a failed write leaves no file, and a file
that is there stays unless mode is overwrite; other bytes than a workbook's, or no such sheet, raise ValueError.
"""

from __future__ import annotations

import io
import math
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# Fixed values of the format: its namespaces, the day before its day 1, and rows of a sheet.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
DAY_0, MOST_ROWS = "1899-12-30", 1_048_576
CELLS = "file string, sheet string, row long, col int, kind string, value string"


def column_number(name: str) -> int:
    """A: 1, Z: 26, AA: 27."""
    n = 0
    for c in name:
        n = 26 * n + ord(c) - 64
    return n


def column_name(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{{{MAIN}}}t"))


def parsed(data: bytes) -> Iterator[tuple[str, int, int, str, str]]:
    """(sheet, row, col, kind, value) of every cell that holds something; kind: n (number), b (0 or 1), e (error) or s (text)."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
        names = set(book.namelist())
        sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet")
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError(f"no workbook: {e}") from e
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = [_text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{{{MAIN}}}si")]
    for sheet in sheets:
        target = targets[sheet.get(f"{{{LINKS}}}id")]
        row = 0
        with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for event, node in ElementTree.iterparse(f, ("start", "end")):
                if event == "start" and node.tag == f"{{{MAIN}}}row":
                    row, col = int(node.get("r") or row + 1), 0
                elif event == "end" and node.tag == f"{{{MAIN}}}c":
                    found = re.match("[A-Z]+", node.get("r") or "")
                    col = column_number(found[0]) if found else col + 1
                    kind, value = node.get("t", "n"), node.findtext(f"{{{MAIN}}}v")
                    if kind == "inlineStr":
                        kind, value = "s", _text(node)
                    elif kind == "s" and value is not None:
                        value = shared[int(value)]
                    if value is not None:
                        yield sheet.get("name"), row, col, "s" if kind == "str" else kind, value
                elif event == "end" and node.tag == f"{{{MAIN}}}row":
                    node.clear()


def cells(spark: SparkSession, path: str) -> DataFrame:
    """file, sheet, row and col (from 1), kind and value of the cells of all workbooks at the path (a file, folder or pattern)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"], strict=True):
                rows: list[tuple] = []
                for cell in parsed(bytes(data)):
                    rows.append((file, *cell))
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=["file", "sheet", "row", "col", "kind", "value"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "sheet", "row", "col", "kind", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, CELLS)


def to_date(kind: Column, value: Column) -> Column:
    """Dates are numbers of days in workbooks, or texts."""
    number = F.date_add(F.lit(DAY_0).cast("date"), F.floor(F.when(kind == "n", value).cast("double")).cast("int"))
    return F.when(kind == "n", number).otherwise(F.try_to_timestamp(F.substring(value, 1, 10), F.lit("yyyy-MM-dd")).cast("date"))


def wide_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """date, asset, price of a sheet (default: each file's first by name) whose first row names the assets and whose first column holds dates."""
    found = cells(spark, path)
    if sheet is None:
        first = found.groupBy("file").agg(F.min("sheet").alias("sheet"))
        found = found.join(first, ["file", "sheet"])
    else:
        found = found.filter(F.col("sheet") == sheet)
    names = found.filter("row = 1 and col > 1").select("file", "col", F.col("value").alias("asset"))
    dates = found.filter("row > 1 and col = 1").select("file", "row", to_date(F.col("kind"), F.col("value")).alias("date"))
    body = found.filter("row > 1 and col > 1 and kind = 'n'").select("file", "row", "col", F.col("value").cast("double").alias("price"))
    return body.join(names, ["file", "col"]).join(dates, ["file", "row"]).select("date", "asset", "price")


# --- out


def _cell(col: int, row: int, kind: str, value: str) -> str:
    at = f'r="{column_name(col)}{row}"'
    if kind == "n":
        return f"<c {at}><v>{value}</v></c>"
    if kind == "d":
        return f'<c {at} s="1"><v>{value}</v></c>'
    return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


@dataclass
class Pieces(WriterCommitMessage):
    """sheet, first row and file of what a task has written."""

    found: list[tuple[str, int, str]]


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        self.folder = f"{path}.{uuid.uuid4().hex}"
        if os.path.exists(path) and not overwrite:
            raise ValueError(f"{path} is there already")
        os.makedirs(self.folder)

    def write(self, iterator: Iterator) -> Pieces:
        """Rows sheet, row, cells (kind, value), in order."""
        found: list[tuple[str, int, str]] = []
        out, sheet = None, None
        try:
            for r in iterator:
                if out is None or r.sheet != sheet:
                    if out:
                        out.close()
                    sheet, name = r.sheet, f"{self.folder}/{uuid.uuid4().hex}"
                    found.append((sheet, r.row, name))
                    out = open(name, "w", encoding="utf-8")  # noqa: SIM115  closed below
                line = "".join(_cell(k + 1, r.row, c.kind, c.value) for k, c in enumerate(r.cells) if c.value is not None)
                out.write(f'<row r="{r.row}">{line}</row>')
        finally:
            if out:
                out.close()
        return Pieces(found)

    def commit(self, messages: list) -> None:
        """Join the pieces, a block at a time."""
        pieces = sorted(p for m in messages if m for p in m.found)
        sheets = list(dict.fromkeys(s for s, _, _ in pieces))
        part = f"{self.folder}/book"
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as book:
            kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(len(sheets)))
            book.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>')
            book.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            named = "".join(f'<sheet name="{escape(s, {chr(34): "&quot;"})}" sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k, s in enumerate(sheets))
            book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>{named}</sheets></workbook>')
            linked = "".join(f'<Relationship Id="rId{k + 1}" Type="{LINKS}/worksheet" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(sheets)))
            book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}/relationships">{linked}<Relationship Id="rId0" Type="{LINKS}/styles" Target="styles.xml"/></Relationships>')
            book.writestr("xl/styles.xml", f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>')
            for k, sheet in enumerate(sheets):
                with book.open(f"xl/worksheets/sheet{k + 1}.xml", "w", force_zip64=True) as to:
                    to.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>'.encode())
                    for _, _, name in (p for p in pieces if p[0] == sheet):
                        with open(name, "rb") as piece:
                            shutil.copyfileobj(piece, to)
                    to.write(b"</sheetData></worksheet>")
        os.replace(part, self.path)
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class Workbook(DataSource):
    """df.write.format("workbook").option("path", ...) for rows sheet, row, cells; see export()."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema, overwrite: bool) -> Writer:
        path = self.options["path"]
        if "://" in path and not path.startswith("file://"):
            raise ValueError("workbooks are written to a folder that is mounted as files")
        return Writer(path.removeprefix("file://"), overwrite)


def _shown(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.simpleString()
    c = F.col(f"`{name}`")
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.struct(F.lit("d").alias("kind"), F.date_diff(c, F.lit(DAY_0).cast("date")).cast("string").alias("value"))
    if kind in ("double", "float"):
        odd = F.isnan(c) | (F.abs(c) == math.inf)
        return F.struct(F.when(odd, "s").otherwise("n").alias("kind"), c.cast("string").alias("value"))
    if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        return F.struct(F.lit("n").alias("kind"), c.cast("string").alias("value"))
    return F.struct(F.lit("s").alias("kind"), c.cast("string").alias("value"))


def sheet(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """sheet, row, cells: a header and df's rows in this order.  A sheet has MOST_ROWS rows at most, so their numbers come from a window over all of them."""
    from pyspark.sql import Window

    header = F.array(*[F.struct(F.lit("s").alias("kind"), F.lit(c).alias("value")) for c in df.columns])
    top = df.sparkSession.range(1).select(F.lit(name).alias("sheet"), F.lit(1).cast("long").alias("row"), header.alias("cells"))
    place = F.row_number().over(Window.orderBy(*order)).cast("long") + 1
    body = df.select(F.lit(name).alias("sheet"), place.alias("row"), F.array(*[_shown(df, c) for c in df.columns]).alias("cells"))
    bounded = F.when(F.col("row") <= MOST_ROWS, F.col("row")).otherwise(F.raise_error(F.lit(f"{name} has more rows than a sheet can")).cast("long"))
    return top.unionByName(body.withColumn("row", bounded))


def export(tables: dict[str, tuple[DataFrame, list[str]]], path: str, overwrite: bool = False) -> None:
    """One workbook with a sheet for each table: its rows in the order of the named columns."""
    rows = None
    for name, (df, order) in tables.items():
        own = sheet(df, name, order)
        rows = own if rows is None else rows.unionByName(own)
    spark = rows.sparkSession
    spark.dataSource.register(Workbook)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "sheet", "row").sortWithinPartitions("sheet", "row")
    ranged.write.format("workbook").option("path", path).mode("overwrite" if overwrite else "append").save()
