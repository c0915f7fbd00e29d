import datetime as dt
from decimal import Decimal

from dealweave.operators import wide_table as w
from dealweave.operators.wide_table import AGING_PATTERNS, Attribute, stitch_wide, typed_cells, wide_keys

from support import as_set

KINDS = {"days_1_30": "amount", "days_90_plus": "amount", "top5_pct": "percent", "invoice_count": "integer", "dso_days": "decimal", "as_of_date": "date", "currency_code": "text", "unapplied_credits": "amount"}
ATTRS = [Attribute(n, k, AGING_PATTERNS[n]) for n, k in KINDS.items()]
SCHEMA = "row_id long, file_id string, metric string, value string, loaded_at timestamp"


def cells(spark, rows, extra=""):
    t = dt.datetime(2024, 1, 1)
    data = [(i, f, m, v, t + dt.timedelta(days=d) if d is not None else None) for i, (f, m, v, d) in enumerate(rows)]
    return typed_cells(spark.createDataFrame(data, SCHEMA), ATTRS, entity="file_id", label="metric", value="value", latest=["loaded_at", "row_id"])


def test_types_and_keys(spark):
    rows = [("a", "1 – 30", "USD 1,200", 0), ("a", "Over 90:", "14,471-", 0), ("a", "Top five share", "12.5 pct", 0), ("a", "# invoices", "1,204", 0), ("a", "DSO (days)", "68.2 days", 0), ("a", "As of", "May 22, 2024", 0), ("a", "CCY", " usd ", 0), ("a", "Open credits", "($20,438)", 0)]
    wide = stitch_wide(cells(spark, rows), ATTRS, entity="file_id")
    r = wide.collect()[0]
    assert (r.days_1_30, r.days_90_plus, r.top5_pct, r.invoice_count, r.dso_days, r.as_of_date, r.currency_code, r.unapplied_credits) == (1200, -14471, Decimal("12.50"), 1204, Decimal("68.2"), dt.date(2024, 5, 22), "USD", -20438)
    assert as_set(wide_keys(wide, ATTRS, entity="file_id")) >= {("a", "top5_pct", "1250"), ("a", "dso_days", "682"), ("a", "as_of_date", "2024-05-22"), ("a", "days_90_plus", "-14471")}


def test_latest_value_counts_and_unusable_ones_never(spark):
    rows = [("a", "1-30", "5", 1), ("a", "1-30", "7", 3), ("a", "1-30", "pending", 9), ("a", "1-30", None, 9), ("a", "1-30", "6", None), ("a", "1-30", "8", 3), ("a", "Comment", "9", 9), ("b", "1-30", "", 1), (None, "1-30", "1", 1), ("c", None, "1", 1), ("c", "as of", "2024-02-30", 1)]
    wide = stitch_wide(cells(spark, rows), ATTRS, entity="file_id")
    assert as_set(wide.select("file_id", "days_1_30")) == {("a", 8)}  # ties in time go to the later row


def test_many_entities_over_several_segments(spark, monkeypatch):
    monkeypatch.setattr(w, "SEGMENT", 4)
    monkeypatch.setattr(w, "BUCKETS", 3)
    rows = [(f"f{i:03d}", m, str(i), 0) for i in range(50) for m in (("1-30", "90+") if i % 3 else ("1-30",))]
    wide = stitch_wide(cells(spark, rows), ATTRS, entity="file_id")
    assert as_set(wide.select("file_id", "days_1_30", "days_90_plus")) == {(f"f{i:03d}", i, i if i % 3 else None) for i in range(50)}
    assert wide.select("entity_ordinal").distinct().count() == 50


def test_huge_numbers_and_long_texts_do_not_fail(spark):
    rows = [("a", "1-30", "9" * 21, 0), ("a", "90+", "9" * 40, 0), ("a", "top 5 %", "9" * 20, 0), ("a", "ccy", "z" * 100_000, 0), ("a", "m" * 100_000, "1", 0), ("a", "# invoices", "7", 0), ("a", "dso", "9" * 20, 0)]
    got = stitch_wide(cells(spark, rows), ATTRS, entity="file_id").collect()[0]
    assert got.invoice_count == 7 and got.days_1_30 is None and got.top5_pct is None and got.dso_days is None and len(got.currency_code) == 100_000


def test_empty_table_and_clashing_columns(spark):
    assert stitch_wide(cells(spark, []), ATTRS, entity="file_id").count() == 0
    df = spark.createDataFrame([(1, "a", "1-30", "3", dt.datetime(2024, 1, 1), "x", 9)], SCHEMA + ", __bucket string, days_1_30 int")
    got = stitch_wide(typed_cells(df, ATTRS, entity="file_id", label="metric", value="value", latest=["loaded_at", "row_id"]), ATTRS, entity="file_id")
    assert got.select("file_id", "days_1_30").collect() == [("a", 3)]
