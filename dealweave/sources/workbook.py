"""Workbooks (OOXML) as cells, read with the standard library."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .raw_csv import CELLS, read_files

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Built-in number formats that show days.
_DATE_FORMATS = frozenset([14, 15, 16, 17, 22])


def _text(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook_cells(content: bytes) -> Iterator[tuple[str, int, int, int, str | None]]:
    """``(sheet name, sheet index, row, column, value)`` of every filled cell; days as ISO dates, blank rows skipped."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_text(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ET.fromstring(z.read("xl/styles.xml"))
            custom = {int(f.get("numFmtId")) for f in styles.iter(f"{_MAIN}numFmt") if re.search(r"[dy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())}
            xfs = styles.find(f"{_MAIN}cellXfs")
            dates = [int(x.get("numFmtId", 0)) in _DATE_FORMATS | custom for x in (xfs if xfs is not None else [])]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for index, sheet in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")):
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            row_no = 0
            for row in root.iter(f"{_MAIN}row"):
                cells = []
                for k, c in enumerate(row.iter(f"{_MAIN}c")):
                    kind, v = c.get("t"), c.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        value = _text(c)
                    elif v is None or v.text is None:
                        continue
                    elif kind == "s":
                        value = shared[int(v.text)]
                    elif kind == "b":
                        value = "true" if v.text == "1" else "false"
                    else:
                        value = v.text
                        style = int(c.get("s", 0))
                        if kind in (None, "n") and style < len(dates) and dates[style]:
                            value = (dt.date(1899, 12, 30) + dt.timedelta(days=int(float(value)))).isoformat()
                    if value.strip():
                        cells.append((sheet.get("name"), index, row_no, _column(c.get("r")) if c.get("r") else k, value.strip()))
                yield from cells
                row_no += bool(cells)


def xlsx_cells(spark: SparkSession, path: str, pattern: str = "*.xlsx") -> DataFrame:
    """Filled cells of all workbooks under ``path``; a file that cannot be read gives one row with a null sheet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    cells = list(workbook_cells(content))
                except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, IndexError):
                    cells = [(None, None, None, None, None)]
                columns = list(zip(*cells)) or [[]] * 5
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=["path", "sheet_name", "sheet_index", "row_no", "col_no", "value"])

    return read_files(spark, path, pattern).select("path", "content").mapInArrow(run, CELLS)
