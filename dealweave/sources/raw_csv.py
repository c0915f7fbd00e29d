"""Raw delimited files as cells: ragged rows kept, no header assumed, RFC 4180 quotes, any line end, byte order mark dropped."""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import top_k

CELLS = "path string, sheet_name string, sheet_index int, row_no int, col_no int, value string"


def upload_status(path: Column) -> Column:
    """``accepted`` for files of a readable kind, ``rejected`` for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("csv", "xlsx", "pdf"), "accepted").otherwise("rejected")


def upload_summary(files: DataFrame) -> DataFrame:
    """``total, accepted, rejected`` of a table with ``path``."""
    s = files.select(upload_status(F.col("path")).alias("s"))
    return s.agg(F.count("*").alias("total"), F.count_if(F.col("s") == "accepted").alias("accepted"), F.count_if(F.col("s") == "rejected").alias("rejected"))


def read_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path, length, content`` of the files under ``path`` whose names match, each once by name and size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1)).dropDuplicates(["name", "length"]).select("path", "length", "content")


def csv_rows(text: str) -> Iterator[list[str]]:
    """Rows of delimited text as they stand, ragged ones too."""
    csv.field_size_limit(1 << 30)
    yield from csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""))


def csv_cells(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Cells of all CSV files under ``path``: one row per cell, blank ones null; the sheet is named as its file.

    Files are parsed where they are read, one at a time; a bad byte becomes a replacement character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sheet = os.path.splitext(os.path.basename(name))[0]
                rows, cols, values = [], [], []
                for i, row in enumerate(csv_rows(content.decode("utf-8", "replace"))):
                    for k, v in enumerate(row):
                        rows.append(i)
                        cols.append(k)
                        values.append(v.strip() or None)
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([sheet] * n, pa.string()), pa.array([0] * n, pa.int32()), pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(values, pa.string())], names=["path", "sheet_name", "sheet_index", "row_no", "col_no", "value"])

    return read_files(spark, path, pattern).select("path", "content").mapInArrow(run, CELLS)


def document_text(cells: DataFrame, limit: int = 4000) -> DataFrame:
    """``path, text``: sheet names and cells of a file in order, cut to ``limit`` characters as a preview.

    A cell brings a character and a space at least, so the first ``limit / 2`` filled cells of a file are enough; Spark keeps
    no more of a file before the shuffle.
    """
    first = top_k(cells.filter("value != ''"), ["path"], [F.asc("sheet_index"), F.asc("row_no"), F.asc("col_no")], limit // 2 + 1, "__place")
    text = first.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__place", "value"))), lambda x: x["value"]), " ").alias("t"))
    names = cells.groupBy("path").agg(F.min("sheet_name").alias("name"))
    return names.join(text, "path", "left").select("path", F.substring(F.concat_ws(" ", "name", "t"), 1, limit).alias("text"))
