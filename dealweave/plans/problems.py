"""Queries of the general problems: units (p2), wide tables (p3), rows that fail to parse (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.record_grammar import DEBT_RECORD, REVENUE_RECORD, bad_records, parse_records
from ..operators.units import amounts_in_dollars, rates_in_percent, silent_unit_changes
from ..operators.wide_table import AGING_PATTERNS, Attribute, stitch_wide, typed_cells, wide_keys
from ..session import bounded_collect, table

MAX_ATTRIBUTES = 1000


def p2_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every amount and rate present, in common units, with the evidence its unit rests on."""
    revenue, debt = table(spark, sf_dir, "revenue_breakdown"), table(spark, sf_dir, "debt_schedule")

    def tagged(df: DataFrame, src: str, field: str, value: str, factor: F.Column) -> DataFrame:
        return df.select(F.lit(src).alias("src_table"), "row_id", F.lit(field).alias("field"), F.col(value).alias("value_key"), factor.alias("recorded_otherwise"), "level_shift", "evidence")

    other = F.col("decades") != 0
    amounts = amounts_in_dollars(revenue, row_id="row_id", file="file_id", place="row_idx", value="revenue", name="customer", title="sheet_title", header="revenue_header", share="pct_of_revenue")
    principal = amounts_in_dollars(debt, row_id="row_id", file="file_id", place="row_idx", value="principal", name="instrument", title="sheet_title")
    rates = rates_in_percent(debt, row_id="row_id", file="file_id", place="row_idx", value="interest_rate", name="instrument", title="sheet_title")
    return (
        tagged(amounts, "revenue_breakdown", "revenue", "dollars", other)
        .unionByName(tagged(principal, "debt_schedule", "principal", "dollars", other))
        .unionByName(tagged(rates, "debt_schedule", "interest_rate", "milli_percent", (F.col("points") != 1) | (F.col("times") != 1)))
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values recorded otherwise than in whole dollars or percent per year, converted."""
    return p2_converted(spark, sf_dir).filter("recorded_otherwise").select("src_table", "row_id", "field", "value_key")


def p2_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List prices of parts of which runs are recorded in thousands and nothing says so: those found, in cents.

    The unit change is planted here, every fourth run of forty parts, and found by the levels of each brand's history alone.
    """
    planted = F.floor(F.col("p_partkey") / 40) % 4 == 2
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_retailprice").cast("double") / F.when(planted, 1000.0).otherwise(1.0)).alias("recorded"))
    found = silent_unit_changes(parts, keys=["p_brand"], place="p_partkey", value="recorded", row_id="p_partkey")
    return found.filter("level_shift != 0").select("p_partkey", F.round(F.col("restored") * 100).cast("bigint").alias("cents"))


def aging_attributes(spark: SparkSession, sf_dir: str) -> list[Attribute]:
    """The columns of the wide aging table, as ``aging_fields`` lists them."""
    fields = bounded_collect(table(spark, sf_dir, "aging_fields"), MAX_ATTRIBUTES, "aging_fields")
    own_words = lambda name: name.replace("_", "[ _-]")
    return [Attribute(r.field_name, r.data_type, AGING_PATTERNS.get(r.field_name, own_words(r.field_name))) for r in fields]


def _aging_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributes = aging_attributes(spark, sf_dir)
    cells = typed_cells(table(spark, sf_dir, "ar_aging"), attributes, entity="file_id", label="metric", value="value", latest=["loaded_at", "row_id"])
    return stitch_wide(cells, attributes, entity="file_id")


def p3_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file of ``ar_aging`` with a typed column for each aging field."""
    shown = {"percent": "double", "decimal": "double", "date": "string"}
    kinds = {a.name: shown[a.data_type] for a in aging_attributes(spark, sf_dir) if a.data_type in shown}
    wide = _aging_wide(spark, sf_dir).drop("entity_ordinal")
    return wide.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else c for c in wide.columns))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled cells of the wide aging table."""
    return wide_keys(_aging_wide(spark, sf_dir), aging_attributes(spark, sf_dir), entity="file_id")


def p6_debt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed debt records of the raw lines, with located errors."""
    return parse_records(table(spark, sf_dir, "ugly_debt_schedule"), DEBT_RECORD, id_col="line_id", file_col="file_id", line_col="line_no", text_col="c0")


def p6_revenue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed revenue records of the raw lines, with located errors."""
    return parse_records(table(spark, sf_dir, "ugly_revenue_breakdown"), REVENUE_RECORD, id_col="line_id", file_col="file_id", line_col="line_no", text_col="c0")


def p6_debt_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debt records that load, typed."""
    return p6_debt_rows(spark, sf_dir).filter("reason is null").select("line_id", "file_id", "facility", "outstanding", "rate", F.col("maturity").cast("string").alias("maturity"), "annual_pi")


def p6_revenue_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue records that load, typed."""
    return p6_revenue_rows(spark, sf_dir).filter("reason is null").select("line_id", "file_id", "customer", "revenue", "mix")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad data records of both raw tables with the first reason that applies."""
    found = lambda df, src: bad_records(df, "line_id").select(F.lit(src).alias("src_table"), "line_id", "reason")
    return found(p6_debt_rows(spark, sf_dir), "ugly_debt_schedule").unionByName(found(p6_revenue_rows(spark, sf_dir), "ugly_revenue_breakdown"))


QUERIES = {"p2_found": p2_found, "p2_converted": p2_converted, "p2_silent": p2_silent, "p3_found": p3_found, "p3_wide": p3_wide, "p6_found": p6_found, "p6_debt_loaded": p6_debt_loaded, "p6_revenue_loaded": p6_revenue_loaded, "p6_debt_rows": p6_debt_rows, "p6_revenue_rows": p6_revenue_rows}
