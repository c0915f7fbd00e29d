"""Structure of sheets: blank rows, header row, title, value scale, columns, records, sections, unpivoted periods.

A sheet is a group of rows (``sheet`` key) in the order of ``place``; its cells are one array of strings per row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.periods import is_value_period, parse_period
from .relational import numbered

#: Rows among which a header is looked for, and rows below that support it.
HEADER_SCAN, SUPPORT_ROWS = 8, 3
#: What makes a cell a period header.
PERIOD_HEADER = r"(?i)\b(?:19|20)\d{2}\b|ltm|ttm|fy\d{2,4}|\bq[1-4]\b"
#: Statements of the scale of a sheet's values.
THOUSANDS, MILLIONS = r"\(\$?\s*000s?\)|\$000s?\b|\bin thousands?\b|\b000s\b", r"\(\$?\s*mm\)|\(\$?\s*millions?\)|\bin millions?\b|\bmm\b"


def normalize_cell(c: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    t = F.trim(c)
    return F.when(t != "", t)


def is_numeric_text(c: Column) -> Column:
    """Whether a cell reads as a number once separators, currency, percent and brackets are gone."""
    return F.coalesce(F.regexp_replace(F.trim(c), r"[,$()%]", "").rlike(r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"), F.lit(False))


def sheet_rows(df: DataFrame, *, sheet: str, place: str, order: str, cells: list[str]) -> DataFrame:
    """``sheet, row_no, cells`` of the rows that are not blank, numbered from 0 again; of rows with one place the least
    ``order`` stays."""
    rows = df.groupBy(F.col(sheet).alias("sheet"), F.col(place).alias("place")).agg(F.min_by(F.array(*(normalize_cell(F.col(c)) for c in cells)), order).alias("cells"))
    rows = rows.filter(F.exists("cells", lambda x: x.isNotNull()))
    return numbered(rows, ["sheet"], "place", "row_no").select("sheet", "row_no", "cells")


def header_scores(rows: DataFrame) -> DataFrame:
    """``sheet, row_no, cells, score`` of the first rows of each sheet: how much each looks like the header.

    The window only ever sees the first rows of a sheet, however long it is.
    """
    top = rows.filter(F.col("row_no") < HEADER_SCAN + SUPPORT_ROWS)
    w = Window.partitionBy("sheet").orderBy("row_no").rowsBetween(1, SUPPORT_ROWS)
    top = top.withColumn("below", F.collect_list("cells").over(w)).filter(F.col("row_no") < HEADER_SCAN)
    filled = F.filter("cells", lambda x: x.isNotNull())
    n = F.size(filled)
    periods = F.size(F.filter(filled, lambda x: x.rlike(PERIOD_HEADER)))
    numbers = F.size(F.filter(filled, is_numeric_text))
    at = F.sequence(F.lit(0), F.size("cells") - 1)
    has_below = lambda test: lambda i: F.exists("below", lambda r: test(F.get(r, i)))
    supported = F.size(F.filter(at, lambda i: F.get("cells", i).isNotNull() & has_below(lambda c: c.isNotNull())(i)))
    numeric_support = F.size(F.filter(at, has_below(is_numeric_text)))
    title_like = (n <= 1) | ((n == 2) & (periods == 0))
    cap = lambda x, most: F.least(x, F.lit(most))
    score = (
        F.when(n >= 2, 1.5).otherwise(-2.0) + cap(n * 0.55, 2.2) + cap(periods * 0.75, 2.25) - cap(numbers * 0.35, 1.4)
        + F.when(F.get("cells", F.lit(0)).isNotNull(), 0.75).otherwise(0.0) + cap(supported * 0.35, 1.75) + cap(numeric_support * 0.18, 0.9) - F.when(title_like, 1.75).otherwise(0.0)
    )
    return top.select("sheet", "row_no", "cells", F.round(score, 6).alias("score"))


def header_rows(rows: DataFrame) -> DataFrame:
    """``sheet, header_row, header, score``: the best header of each sheet, the first of equal ones."""
    best = header_scores(rows).groupBy("sheet").agg(F.max_by(F.struct("row_no", "cells", "score"), F.struct("score", -F.col("row_no"))).alias("b"))
    return best.select("sheet", F.col("b.row_no").alias("header_row"), F.col("b.cells").alias("header"), F.col("b.score").alias("score"))


def column_names(header: Column) -> Column:
    """Header texts, ``column_N`` where there is none."""
    return F.transform(header, lambda x, i: F.coalesce(x, F.concat(F.lit("column_"), (i + 1).cast("string"))))


def records(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """``sheet, row_no, record``: rows below the header as a map; of columns with one name the last counts."""
    below = rows.join(headers, "sheet").filter(F.col("row_no") > F.col("header_row"))
    names = column_names(F.col("header"))
    last = F.filter(F.sequence(F.lit(0), F.size(names) - 1), lambda i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), F.get(names, i)))
    entries = F.transform(last, lambda i: F.struct(F.get(names, i).alias("key"), F.get("cells", i).alias("value")))
    return below.select("sheet", "row_no", F.map_from_entries(entries).alias("record"))


def sheet_titles(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """``sheet, title``: the first single text cell at or above the header that is no period, else the header's first text."""
    upper = rows.filter(F.col("row_no") < HEADER_SCAN).join(headers.select("sheet", "header_row", "header"), "sheet").filter(F.col("row_no") <= F.col("header_row"))
    filled = F.filter("cells", lambda x: x.isNotNull())
    alone = (F.size(filled) == 1) & ~F.get(filled, F.lit(0)).rlike(PERIOD_HEADER)
    first = F.min(F.when(alone, F.struct(F.col("row_no").alias("r"), F.get(filled, F.lit(0)).alias("t"))))
    fallback = F.first(F.get(F.filter("header", lambda x: x.isNotNull()), F.lit(0)))
    return upper.groupBy("sheet").agg(F.coalesce(first["t"], fallback).alias("title"))


def value_scales(rows: DataFrame, name: str = "sheet") -> DataFrame:
    """``sheet, value_scale``: 1, 1,000 or 1,000,000 as the sheet's name or first three rows state; thousands are read first."""
    text = rows.filter(F.col("row_no") < 3).groupBy("sheet").agg(F.lower(F.concat_ws(" ", F.first(F.col(name).cast("string")), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda r: r["cells"])))).alias("t"))
    return text.select("sheet", F.when(F.col("t").rlike(THOUSANDS), 1000).when(F.col("t").rlike(MILLIONS), 1_000_000).otherwise(1).cast("bigint").alias("value_scale"))


def promoted_headers(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Headers, replaced by the row below where that row reads as two or more periods."""
    nxt = rows.join(headers.select("sheet", "header_row"), "sheet").filter(F.col("row_no") == F.col("header_row") + 1)
    periods = F.size(F.filter("cells", lambda x: is_value_period(x) & parse_period(x).isNotNull()))
    up = nxt.filter(periods >= 2).select("sheet", F.col("row_no").alias("up_row"), F.col("cells").alias("up"))
    return headers.join(up, "sheet", "left").select("sheet", F.coalesce("up_row", "header_row").alias("header_row"), F.coalesce("up", "header").alias("header"), "score")


def unpivot_periods(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """``sheet, row_no, label, col_no, period_key, granularity, raw``: one row per filled cell of a period column."""
    cells = rows.join(headers.select("sheet", "header_row", "header"), "sheet").filter(F.col("row_no") > F.col("header_row"))
    columns = F.filter(F.transform("header", lambda h, i: F.struct(i.alias("i"), h.alias("h"))), lambda c: is_value_period(c["h"]) & (c["i"] > 0))
    long = cells.select("sheet", "row_no", F.get("cells", F.lit(0)).alias("label"), "cells", F.explode(columns).alias("c"))
    long = long.select("sheet", "row_no", "label", F.col("c.i").alias("col_no"), parse_period(F.col("c.h")).alias("p"), F.get("cells", F.col("c.i")).alias("raw"))
    return long.filter("p is not null and raw is not null").select("sheet", "row_no", "label", "col_no", "p.period_key", "p.granularity", "raw")


_PERIOD_RE, _NUMBER_RE = re.compile(PERIOD_HEADER), re.compile(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*")


def _number(v: str) -> bool:
    return bool(_NUMBER_RE.fullmatch(re.sub(r"[,$()%]", "", v)))


def _row_marks(cells: list[list[str | None]], own: int | None = None) -> list[tuple[bool, str | None, list[str]]]:
    """(like a header, title, words) of the first ``own`` rows: what sections need to know of a row. A title is a line of one
    text before a row like a header; only the next ``SUPPORT_ROWS + 1`` rows bear on a row."""
    filled = [[v for v in r if v] for r in cells]

    def header_like(i: int) -> bool:
        row = filled[i]
        if len(row) < 2 or (all(map(_number, row)) and not any(_PERIOD_RE.search(v) for v in row)):
            return False
        below = cells[i + 1 : i + 1 + SUPPORT_ROWS]
        return sum(any(k < len(r) and r[k] for r in below) for k in range(len(cells[i]))) >= max(2, min(len(row), 3))

    n = len(cells) if own is None else own
    like = [header_like(i) for i in range(min(n + 1, len(cells)))] + [False]
    title = lambda i: filled[i][0] if len(filled[i]) == 1 and not _number(filled[i][0]) and like[i + 1] else None
    return [(like[i], title(i), sorted({re.sub(r"\s+", " ", v.lower().strip()) for v in filled[i]})) for i in range(n)]


class _Walk:
    """Finds the sections of one sheet from its marks in order, from the header row on; holds no rows."""

    def __init__(self, header_row: int, words: list[str], min_rows: int = 3):
        self.start, self.words, self.title, self.section, self.min_rows = header_row, set(words), None, 0, min_rows

    def begins(self, row: int, header_like: bool, title: str | None, words: list[str]) -> tuple[bool, str | None]:
        """Whether a row begins a section, and its title."""
        if title is not None:
            self.title = title
        elif header_like and row - self.start >= self.min_rows and (self.title or self._alike(words)):
            found, self.start, self.words, self.title, self.section = self.title, row, set(words), None, self.section + 1
            return True, found
        return False, None

    def _alike(self, words: list[str]) -> bool:
        return bool(self.words and words) and len(self.words.intersection(words)) >= min(len(self.words), len(words), 2)


def find_sections(cells: list[list[str | None]], header_row: int, min_rows: int = 3) -> list[tuple[int, str | None]]:
    """(header row, title) of every section of a sheet: a header like the current one, or one that a title line precedes."""
    marks = _row_marks(cells)
    walk = _Walk(header_row, marks[header_row][2], min_rows)
    found = ((i, *walk.begins(i, *marks[i])) for i in range(header_row + 1, len(cells)))
    return [(header_row, None), *((i, title) for i, begins, title in found if begins)]


def sections(rows: DataFrame, headers: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``sheet, section, header_row, title``: where each sheet splits into sections.

    Rows are marked in blocks of ``max_rows`` places, each with the few rows after it, so a long sheet is marked by many
    tasks. The split depends on the section before, so the marks of a sheet are then walked in order as one stream, of which
    a task holds one batch; the result does not depend on ``max_rows``.
    """
    kind, block = rows.schema["sheet"].dataType.simpleString(), F.floor(F.col("row_no") / max_rows).cast("int")
    reach = F.floor((F.col("row_no") - SUPPORT_ROWS - 1) / max_rows).cast("int")
    placed = rows.join(headers.select("sheet", "header_row"), "sheet").filter(F.col("row_no") >= F.col("header_row"))
    placed = placed.withColumn("own", block).withColumn("block", F.explode(F.sequence(F.greatest(reach, F.lit(0)), block)))

    def mark(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row_no")
        own = group[group["own"] == group["block"]]
        marks = _row_marks([list(r) for r in group["cells"]], len(own))
        column = lambda k, kind: pd.Series([m[k] for m in marks], own.index, kind)
        out = pd.DataFrame({"sheet": own["sheet"], "row_no": own["row_no"], "first": own["row_no"] == own["header_row"], "header_like": column(0, bool), "title": column(1, object), "words": column(2, object)})
        return out[out["first"] | out["header_like"] | out["title"].notna()]

    marks = placed.groupBy("sheet", "block").applyInPandas(mark, f"sheet {kind}, row_no int, first boolean, header_like boolean, title string, words array<string>")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            at, section, title = [], [], []
            for i, (row, first, *m) in enumerate(zip(*(b.column(k).to_pylist() for k in range(1, 6)))):
                if first:
                    now = _Walk(row, m[2])
                begins, text = (True, None) if first else now.begins(row, *m)
                if begins:
                    at.append(i)
                    section.append(now.section)
                    title.append(text)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(section, pa.int32()), b.column(1).take(at), pa.array(title, pa.string())], names=["sheet", "section", "header_row", "title"])

    # every sheet's first mark is its header row
    ordered = marks.repartition("sheet").sortWithinPartitions("sheet", "row_no")
    return ordered.mapInArrow(walk, f"sheet {kind}, section int, header_row int, title string")


def section_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``sheet, row_no, cells``: each section as a sheet of its own, named ``sheet :: title`` and numbered from its header."""
    ends = found.withColumn("end", F.coalesce(F.lead("header_row").over(Window.partitionBy("sheet").orderBy("section")), F.lit(2_147_483_647)))
    name = F.concat_ws(" :: ", F.col("sheet"), F.coalesce("title", F.concat(F.lit("section "), (F.col("section") + 1).cast("string"))))
    ends = ends.select("sheet", "header_row", "end", name.alias("name"))
    cut = rows.join(ends, "sheet").filter((F.col("row_no") >= F.col("header_row")) & (F.col("row_no") < F.col("end")))
    return cut.select(F.col("name").alias("sheet"), (F.col("row_no") - F.col("header_row")).alias("row_no"), "cells")


def usable_sheets(classified: DataFrame, min_score: float = 0.3) -> DataFrame:
    """Sheets of a known type that are no cover, summary or instruction sheet."""
    return classified.filter((F.col("doc_type") != "unknown") & (F.col("score") > min_score) & ~F.lower(F.trim("sheet")).rlike("^(?:cover|summary|instructions?)$"))


def prefer_sections(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """Sections where a sheet has any, else the sheet itself; both with ``parent`` and the same columns."""
    return parts.unionByName(whole.join(parts.select("parent").distinct(), "parent", "left_anti"))
