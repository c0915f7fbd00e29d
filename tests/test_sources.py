import io
import zipfile

import pytest

from dealweave.sources.decision_log import DecisionLog, StaleRevision
from dealweave.sources.page_items import page_lines, table_count, with_pair_header
from dealweave.sources.raw_csv import csv_cells, document_text, upload_summary
from dealweave.sources.workbook import workbook_cells, xlsx_cells

from support import as_set

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>Metric</t></si><si><r><t>Ca</t></r><r><t>sh</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2022</v></c></row><row r="2"><c r="A2"/></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" s="1"><v>45000</v></c><c r="C3" t="b"><v>1</v></c><c r="D3" t="inlineStr"><is><t> x </t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_workbook_cells():
    assert list(workbook_cells(workbook())) == [("One", 0, 0, 0, "Metric"), ("One", 0, 0, 2, "2022"), ("One", 0, 1, 0, "Cash"), ("One", 0, 1, 1, "2023-03-15"), ("One", 0, 1, 2, "true"), ("One", 0, 1, 3, "x")]


def test_files_to_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿Metric,2022\r\n"Cash, net","1 ""x"""\n,\nlone\n'.encode())
    (tmp_path / "b.xlsx").write_bytes(workbook())
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    cells = csv_cells(spark, str(tmp_path))
    assert as_set(cells.select("sheet_name", "row_no", "col_no", "value")) == {("a", 0, 0, "Metric"), ("a", 0, 1, "2022"), ("a", 1, 0, "Cash, net"), ("a", 1, 1, '1 "x"'), ("a", 2, 0, None), ("a", 2, 1, None), ("a", 3, 0, "lone")}
    assert document_text(cells, 12).first().text == "a Metric 202"
    assert xlsx_cells(spark, str(tmp_path)).filter("sheet_name is null").count() == 1
    files = spark.createDataFrame([("x/a.CSV",), ("b.exe",), ("c.pdf",), ("d",)], "path string")
    assert upload_summary(files).first() == (4, 2, 2)


def test_page_items(spark):
    items = [(1, 10.0, 700.0, 40.0, "Summary"), (1, 10.0, 680.0, 30.0, "Total"), (1, 43.0, 681.0, 20.0, "AR"), (1, 120.0, 680.0, 30.0, "1,234"), (1, 10.0, 660.0, 30.0, "Current"), (1, 120.0, 659.0, 30.0, "900")]
    df = spark.createDataFrame([("f", *i) for i in items], "file string, page int, x double, y double, width double, text string")
    lines = page_lines(df, ["file"])
    assert [r.cells for r in lines.orderBy("line_no").collect()] == [["Summary"], ["Total AR", "1,234"], ["Current", "900"]]
    assert table_count(lines, ["file"]).first().n_tables == 1
    assert [r.cells for r in with_pair_header(lines, ["file"]).orderBy("line_no").collect()][1] == ["Metric", "Value"]


def test_two_columns_of_a_page_are_read_one_after_the_other(spark):
    schema = "file string, page int, x double, y double, width double, text string, page_width double"
    page = lambda f, width, n: [(f, 1, x, 700.0 - 20 * k + up, 30.0, f"{t}{k}", width) for k in range(n) for x, up, t in ((50.0, 0.0, "l"), (330.0, 1.0, "r"))]
    lines = page_lines(spark.createDataFrame(page("two", 612.0, 12) + page("wide", 2000.0, 12) + page("few", 612.0, 11), schema), ["file"])
    got = lambda f, df: [r.cells for r in df.filter(f"file = '{f}'").orderBy("line_no").collect()]
    two = [[f"{t}{k}"] for t in "lr" for k in range(12)]
    assert got("two", lines) == two and [r.line_no for r in lines.filter("file = 'two'").orderBy("line_no").collect()] == list(range(24))
    assert got("wide", lines) == [[f"l{k}", f"r{k}"] for k in range(12)] and len(got("few", lines)) == 11
    assert got("two", page_lines(spark.createDataFrame(page("two", 612.0, 12), schema).drop("page_width"), ["file"])) == two


def test_decision_log(spark, tmp_path):
    log = DecisionLog(spark, str(tmp_path / "log"))
    change = lambda *rows: spark.createDataFrame(list(rows), "collection string, key string, payload string, deleted boolean")
    assert log.revision("a") == 0
    assert log.save("a", change(("rules", "k", "v", False), ("rules", "m", "w", False)), 0) == 1
    assert log.save("a", change(("rules", "k", "v", False)), 1) == 1  # nothing new
    with pytest.raises(StaleRevision):
        log.save("a", change(("rules", "k", "x", False)), 0)
    assert log.save("a", change(("rules", "k", None, True), ("rules", "z", None, True)), 1) == 2
    assert as_set(log.state().select("scope", "key", "payload")) == {("a", "m", "w")}
    assert as_set(log.history()) == {("a", 1, 2, 0), ("a", 2, 0, 1)}


def test_synthetic_rows_repeat(spark):
    from dealweave.sources.synthetic import synthetic_statements

    a, b = (synthetic_statements(spark, 20, seed=s) for s in (1, 1))
    assert a.count() == 60 and as_set(a) == as_set(b) and as_set(a) != as_set(synthetic_statements(spark, 20, seed=2))
    assert a.filter("cogs >= revenue or ebitda <= 0").count() == 0


def test_two_writers_of_one_revision(spark, tmp_path):
    change = spark.createDataFrame([("alias", "k", "v", False)], "collection string, key string, payload string, deleted boolean")
    log = DecisionLog(spark, str(tmp_path / "log"))
    fs, claim = log._claim("acme", 1)  # another writer is at it
    with pytest.raises(StaleRevision):
        log.save("acme", change, 0)
    assert log.save("other", change, 0) == 1
    fs.delete(claim, False)
    assert log.save("acme", change, 0) == 1
