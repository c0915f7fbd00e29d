"""Placed text items of pages (from a PDF extractor) as rows of cells; byte-level PDF reading needs a library this box lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINE_TOLERANCE, CELL_GAP = 3.0, 24.0
#: When a page has two columns: least gap in points and as a share of the width, items of the page and of either side.
BAND_GAP, BAND_SHARE, BAND_ITEMS, BAND_SIDE = 96.0, 0.16, 24, 10


def _with_bands(items: DataFrame, page: list[str]) -> DataFrame:
    """Adds ``band``: 1 for items right of the widest gap between left edges, if it parts a page into two columns, else 0."""
    whole = Window.partitionBy(*page)
    before = F.lag("x").over(whole.orderBy("x"))
    width = F.max("page_width").over(whole) if "page_width" in items.columns else F.max(F.col("x") + F.col("width")).over(whole)
    i = items.withColumn("step", F.struct((F.col("x") - before).alias("gap"), (-before).alias("left")))
    i = i.withColumn("widest", F.max(F.when(F.col("step.gap").isNotNull(), F.col("step"))).over(whole)).withColumn("page_w", width)
    right = F.col("x") > F.col("widest.gap") / 2 - F.col("widest.left")
    i = i.withColumn("right", F.coalesce(right, F.lit(False)).cast("int")).withColumn("n", F.count("*").over(whole)).withColumn("n_right", F.sum("right").over(whole))
    parted = (F.col("n") >= BAND_ITEMS) & (F.col("page_w") > 0) & (F.col("widest.gap") >= F.greatest(F.lit(BAND_GAP), F.col("page_w") * BAND_SHARE)) & (F.least(F.col("n_right"), F.col("n") - F.col("n_right")) >= BAND_SIDE)
    return i.withColumn("band", F.when(parted, F.col("right")).otherwise(0)).drop("step", "widest", "page_w", "right", "n", "n_right")


def page_lines(items: DataFrame, keys: list[str]) -> DataFrame:
    """``<keys>, page, line_no, cells`` of items ``x, y, width, text``: items within a few points of height are a line, and
    a wide gap begins a new cell. A page of two columns is read column by column; its width is ``page_width``, or as far as
    its items reach where there is no such column. Pages bound every window."""
    page = [*keys, "page"]
    down = Window.partitionBy(*page).orderBy("band", F.desc("y"), "x")
    # a line begins where the height drops by more than the tolerance, and with the second column
    i = _with_bands(items.filter(F.length(F.trim("text")) > 0), page).withColumn("drop", F.coalesce(F.lag("y").over(down) - F.col("y"), F.lit(0.0)))
    i = i.withColumn("begins", (F.col("drop") > LINE_TOLERANCE) | (F.col("band") != F.lag("band", 1, 0).over(down)))
    i = i.withColumn("line_no", F.sum(F.col("begins").cast("int")).over(down))
    across = Window.partitionBy(*page, "line_no").orderBy("x")
    i = i.withColumn("gap", F.col("x") - F.lag(F.col("x") + F.col("width")).over(across)).withColumn("cell", F.sum(F.coalesce(F.col("gap") >= CELL_GAP, F.lit(False)).cast("int")).over(across))
    cells = i.groupBy(*page, "line_no", "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", F.trim("text").alias("t")))), lambda v: v["t"]), " ").alias("t"))
    return cells.groupBy(*page, "line_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "t"))), lambda v: v["t"]).alias("cells"))


def text_line_cells(line: Column) -> Column:
    """Cells of a line of recognised text: split at tabs and two or more spaces, else before a number at its end."""
    parts = F.split(F.trim(line), r"\t+| {2,}")
    tail = F.regexp_extract(F.trim(line), r"^(.*\S)\s+(\(?-?\$?[\d,]+(?:\.\d+)?\)?%?)$", 2)
    head = F.regexp_extract(F.trim(line), r"^(.*\S)\s+(\(?-?\$?[\d,]+(?:\.\d+)?\)?%?)$", 1)
    return F.when(F.size(parts) > 1, parts).when(tail != "", F.array(head, tail)).otherwise(parts)


def with_pair_header(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of a page with a ``Metric, Value`` header put in front where a title is followed by two or more pairs."""
    n = F.size("cells")
    shape = lines.groupBy(*keys, "page").agg(F.min("line_no").alias("first"), F.count_if(n == 2).alias("pairs"), F.count_if(n > 2).alias("wide"), F.min_by(n, "line_no").alias("head"))
    wanted = shape.filter("head = 1 and pairs >= 2 and wide = 0").select(*keys, "page", (F.col("first").cast("double") + 0.5).alias("line_no"), F.array(F.lit("Metric"), F.lit("Value")).alias("cells"))
    return lines.withColumn("line_no", F.col("line_no").cast("double")).select(*keys, "page", "line_no", "cells").unionByName(wanted)


def is_footnote(line: Column) -> Column:
    """Whether a line begins as a footnote does."""
    return F.trim(line).rlike(r"(?i)^(?:notes?\b|footnote\b|\*|\(\d+\)|\[\d+\])")


def is_section_title(cells: Column) -> Column:
    """Whether a row is a single short text."""
    return (F.size(cells) == 1) & (F.length(F.get(cells, F.lit(0))) <= 80)


def table_count(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``<keys>, page, n_tables``: runs of rows with two cells or more."""
    w = Window.partitionBy(*keys, "page").orderBy("line_no")
    wide = (F.size("cells") >= 2).cast("int")
    return lines.withColumn("start", wide * (1 - F.coalesce(F.lag(wide).over(w), F.lit(0)))).groupBy(*keys, "page").agg(F.sum("start").cast("bigint").alias("n_tables"))
