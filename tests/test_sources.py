"""Workbooks there and back, and what a failed write leaves."""

from __future__ import annotations

import datetime as dt
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from palisand.sources import prices, workbook

ROWS = [(dt.date(2024, 1, k + 1), "A & <B>", 1.5 * k, k) for k in range(9)] + [(None, None, None, None), (dt.date(1999, 12, 31), ' "quoted"\n', float("nan"), -1), (dt.date(2000, 1, 1), "é漢", float("inf"), 2)]


def table(spark):
    return spark.createDataFrame(ROWS, "date date, name string, x double, k int")


def test_tables_come_back(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    workbook.export({"one": (table(spark), ["k", "date"]), "none": (table(spark).limit(0), ["k"])}, path)
    assert os.listdir(tmp_path) == ["book.xlsx"]
    found = {(c.sheet, c.row, c.col): (c.kind, c.value) for c in workbook.cells(spark, path).collect()}
    assert {k: v for k, v in found.items() if k[1] == 1} == {(s, 1, i + 1): ("s", n) for s in ("one", "none") for i, n in enumerate(("date", "name", "x", "k"))}
    ordered = table(spark).orderBy("k", "date").collect()
    for row, r in enumerate(ordered, 2):
        own = [found.get(("one", row, c)) for c in (1, 2, 3, 4)]
        days = None if r.date is None else ("n", str((r.date - dt.date(1899, 12, 30)).days))
        assert own[0] == days and own[1] == (None if r.name is None else ("s", r.name)) and own[3] == (None if r.k is None else ("n", str(r.k)))
        assert own[2] == (None if r.x is None else ("n", str(r.x)) if abs(r.x) < 1e9 else ("s", "NaN" if r.x != r.x else "Infinity"))
    with pytest.raises(Exception, match="is there already"):
        workbook.export({"one": (table(spark), ["k"])}, path)
    workbook.export({"two": (table(spark), ["k"])}, path, overwrite=True)
    assert {c.sheet for c in workbook.cells(spark, path).collect()} == {"two"}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = table(spark).withColumn("x", F.when(F.col("k") == 8, F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="stop"):
        workbook.export({"good": (table(spark), ["k"]), "bad": (bad, ["k"])}, str(tmp_path / "book.xlsx"))
    assert os.listdir(tmp_path) == []


def test_prices_of_other_writers_are_read(spark, tmp_path):
    """Shared strings, dates as text, cells without places, absolute targets."""
    main = f'xmlns="{workbook.MAIN}"'
    sheet = f'<worksheet {main}><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c><c t="str"><v>B</v></c></row><row r="3"><c r="A3" t="s"><v>2</v></c><c r="C3"><v>2.5</v></c></row><row r="4"><c r="A4"><v>45292</v></c><c r="B4"><v>7</v></c><c r="C4" t="e"><v>#N/A</v></c></row></sheetData></worksheet>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{workbook.LINKS}"><sheets><sheet name="p" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{workbook.PACKAGE}/relationships"><Relationship Id="a" Target="/xl/own.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Date</t></si><si><r><t>A</t></r><r><t>1</t></r></si><si><t>2023-12-29 00:00:00</t></si></sst>")
        z.writestr("xl/own.xml", sheet)
    (tmp_path / "prices_data.xlsx").write_bytes(data.getvalue())
    got = sorted(map(tuple, prices.load(spark, str(tmp_path)).collect()))
    assert got == [(dt.date(2023, 12, 29), "B", 2.5), (dt.date(2024, 1, 1), "A1", 7.0)]


def test_other_bytes_are_no_workbook(spark, tmp_path):
    (tmp_path / "x.xlsx").write_bytes(b"not a zip")
    with pytest.raises(Exception, match="no workbook"):
        workbook.cells(spark, str(tmp_path / "x.xlsx")).collect()
    with pytest.raises(ValueError, match="old binary format"):
        prices.load(spark, str(tmp_path / "x.xls"))
    assert [workbook.column_number(workbook.column_name(n)) for n in (1, 26, 27, 702, 703, 16384)] == [1, 26, 27, 702, 703, 16384]
