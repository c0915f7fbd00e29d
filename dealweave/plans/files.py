"""Queries over files that are written first: delimited text, placed page items, the reviewers' decision log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, table
from ..sources.decision_log import DecisionLog
from ..sources.page_items import page_lines
from ..sources.raw_csv import csv_cells, document_text


def _place(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, d: str) -> str:
    at = _place(spark, "csv")
    table(spark, d, "doc_fields").select("doc_type", "doc_label", "field_name", "ordinal").coalesce(1).sortWithinPartitions("doc_type", "ordinal", "field_name").write.option("escape", '"').csv(at)
    return at


def csv_file_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the document fields, written as a delimited file and read again."""
    return csv_cells(spark, _written(spark, d)).select("sheet_index", "row_no", "col_no", "value")


def csv_file_text(spark: SparkSession, d: str) -> DataFrame:
    """The preview of that file, without its name."""
    return document_text(csv_cells(spark, _written(spark, d)).withColumn("sheet_name", F.lit("fields"))).select("text")


def page_columns(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a page in two columns, labels left and sections right: read column by column."""
    items = table(spark, d, "line_items").select("item_id", "label", "section")
    at = lambda x, c: F.struct(F.lit(float(x)).alias("x"), F.lit(60.0).alias("width"), F.col(c).alias("text"))
    placed = items.select(F.lit("f").alias("file"), F.lit(1).alias("page"), (1000.0 - 12 * F.col("item_id")).alias("y"), F.explode(F.array(at(20, "label"), at(300, "section"))).alias("i"))
    lines = page_lines(placed.select("file", "page", "y", "i.*"), ["file"])
    return lines.select(F.col("line_no").cast("bigint").alias("line_no"), F.array_join("cells", "|").alias("line"))


def review_log(spark: SparkSession, d: str) -> DataFrame:
    """The state of a decision log after three revisions: all fields kept, the first of each type removed, the second changed."""
    log = DecisionLog(spark, _place(spark, "log"))
    fields = table(spark, d, "doc_fields").select(F.lit("alias").alias("collection"), F.concat_ws(".", "doc_type", "field_name").alias("key"), F.col("doc_label").alias("payload"), F.lit(False).alias("deleted"), "ordinal")
    changes = [fields, fields.filter("ordinal = 1").withColumn("deleted", F.lit(True)), fields.filter("ordinal = 2").withColumn("payload", F.upper("payload"))]
    for revision, change in enumerate(changes):
        log.save("acme", change.drop("ordinal"), revision)
    return log.state().select("key", "payload", "revision")


Q = {"csv_file_cells": csv_file_cells, "csv_file_text": csv_file_text, "page_columns": page_columns, "review_log": review_log}
_ROWS = "SELECT row_number() OVER (ORDER BY doc_type, ordinal, field_name) - 1 AS n, * FROM doc_fields"
SQL = {
    "csv_file_cells": f"SELECT 0 AS sheet_index, CAST(n AS INTEGER) AS row_no, k AS col_no, v AS value FROM (SELECT n, unnest([0, 1, 2, 3]) AS k, unnest([doc_type, doc_label, field_name, CAST(ordinal AS VARCHAR)]) AS v FROM ({_ROWS}))",
    "csv_file_text": f"SELECT ('fields ' || string_agg(doc_type || ' ' || doc_label || ' ' || field_name || ' ' || ordinal, ' ' ORDER BY n))[1:4000] AS text FROM ({_ROWS})",
    "page_columns": "SELECT row_number() OVER (ORDER BY c, item_id) - 1 AS line_no, line FROM (SELECT item_id, 0 AS c, label AS line FROM line_items UNION ALL SELECT item_id, 1, section FROM line_items)",
    "review_log": "SELECT doc_type || '.' || field_name AS key, CASE WHEN ordinal = 2 THEN upper(doc_label) ELSE doc_label END AS payload, CAST(CASE WHEN ordinal = 2 THEN 3 ELSE 1 END AS BIGINT) AS revision FROM doc_fields WHERE ordinal <> 1",
}
