import pytest
from pyspark.sql import functions as F

from dealweave.dims import aliases_table, schema_table
from dealweave.operators import matching, sheets

from support import as_set

ROWS = [
    ("s", 0, "Balance Sheet", None, None), ("s", 1, "USD in 000s", None, None), ("s", 2, None, " ", ""), ("s", 3, "Metric", "2022", "2023"), ("s", 4, "Cash", "1,000", "1,200"), ("s", 5, "Total Assets", "5,000", "(6)"), ("s", 6, "Equity", None, "n/a"),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)] + [(99, *ROWS[4][:2], "dup", "9", "9")], "row_id int, f string, p int, c0 string, c1 string, c2 string")
    return sheets.sheet_rows(df, sheet="f", place="p", order="row_id", cells=["c0", "c1", "c2"]).cache()


def test_rows_are_renumbered_without_blanks(rows):
    assert rows.count() == 6 and rows.filter("row_no = 2").first().cells == ["Metric", "2022", "2023"]


def test_header_title_scale_and_unpivot(rows):
    h = sheets.header_rows(rows)
    assert h.select("header_row", "header").first() == (2, ["Metric", "2022", "2023"])
    assert as_set(sheets.sheet_titles(rows, h)) == {("s", "Balance Sheet")}
    assert as_set(sheets.value_scales(rows)) == {("s", 1000)}
    assert as_set(sheets.unpivot_periods(rows, h).select("label", "period_key", "raw")) == {("Cash", "2022", "1,000"), ("Cash", "2023", "1,200"), ("Total Assets", "2022", "5,000"), ("Total Assets", "2023", "(6)"), ("Equity", "2023", "n/a")}


def test_records_keep_the_last_of_equal_headers(spark):
    rows = spark.createDataFrame([("s", 0, ["A", None, "A"]), ("s", 1, ["1", "2", "3"])], "sheet string, row_no int, cells array<string>")
    h = spark.createDataFrame([("s", 0, ["A", None, "A"], 1.0)], "sheet string, header_row int, header array<string>, score double")
    assert sheets.records(rows, h).first().record == {"column_2": "2", "A": "3"}


def test_second_header_is_promoted(spark):
    rows = spark.createDataFrame([("s", 0, ["Income", "Actual", "Plan"]), ("s", 1, [None, "2022", "2023"]), ("s", 2, ["Cash", "1", "2"])], "sheet string, row_no int, cells array<string>")
    h = spark.createDataFrame([("s", 0, ["Income", "Actual", "Plan"], 1.0)], "sheet string, header_row int, header array<string>, score double")
    assert sheets.promoted_headers(rows, h).select("header_row", "header").first() == (1, [None, "2022", "2023"])


def test_sections(spark):
    part = [["Metric", "2022"], ["Cash", "1"], ["Debt", "2"], ["Equity", "3"]]
    cells = part + [["Second table", None]] + part + part
    assert sheets.find_sections(cells, 0) == [(0, None), (5, "Second table"), (9, None)]
    rows = spark.createDataFrame([("s", i, c) for i, c in enumerate(cells)], "sheet string, row_no int, cells array<string>")
    h = spark.createDataFrame([("s", 0, ["Metric", "2022"], 1.0)], "sheet string, header_row int, header array<string>, score double")
    assert as_set(sheets.sections(rows, h)) == {("s", 0, 0, None), ("s", 1, 5, "Second table"), ("s", 2, 9, None)}


def test_empty_sheets(spark):
    df = spark.createDataFrame([], "row_id int, f string, p int, c0 string, c1 string, c2 string")
    rows = sheets.sheet_rows(df, sheet="f", place="p", order="row_id", cells=["c0", "c1", "c2"])
    assert sheets.header_rows(rows).count() == 0 and sheets.value_scales(rows).count() == 0


@pytest.mark.parametrize("label, field, score", [("Cash", "cash", 1.0), ("Total Assets (unaudited)", "totalAssets", 1.0), ("Net cash on hand", "cash", 0.9), ("A/R", "accountsReceivable", 1.0), ("Nothing here", None, None)])
def test_label_scores(spark, label, field, score):
    got = matching.match_labels(spark.createDataFrame([("balance_sheet", label)], "doc_type string, label string"), aliases_table(spark)).filter("match_rank = 1").collect()
    assert (got[0].field_name, got[0].score) == (field, score) if field else not got


def test_learned_aliases_and_coverage(spark):
    base = aliases_table(spark)
    learned = spark.createDataFrame([("balance_sheet", "cash", "Bank balances"), ("balance_sheet", "cash", "CASH"), ("balance_sheet", "cash", "bank  balances")], "doc_type string, field_name string, alias string")
    assert matching.learned_aliases(base, learned).count() == base.count() + 1
    found = spark.createDataFrame([("f", "cash_flow_statement", "capex"), ("f", "cash_flow_statement", "dividendsPaid")], "file string, doc_type string, field_name string")
    c = matching.coverage(schema_table(spark), found, keys=["file"]).first()
    assert (c.n_fields, c.n_found, c.n_required, c.n_required_found, c.missing, c.pct) == (8, 2, 3, 1, "operatingCashFlow,freeCashFlow", 0.25)
    m = matching.mapping_confidence(*(F.lit(x) for x in (2, 4, 5, 7, 10, 1)))
    assert spark.range(1).select(m).first()[0] == pytest.approx(0.49)


def test_sections_become_sheets_and_replace_their_parent(spark):
    rows = spark.createDataFrame([("s", i, [str(i)]) for i in range(5)], "sheet string, row_no int, cells array<string>")
    found = spark.createDataFrame([("s", 0, 0, None), ("s", 1, 3, "Two")], "sheet string, section int, header_row int, title string")
    assert as_set(sheets.section_rows(rows, found).select("sheet", "row_no")) == {("s :: section 1", 0), ("s :: section 1", 1), ("s :: section 1", 2), ("s :: Two", 0), ("s :: Two", 1)}
    whole = spark.createDataFrame([("a", "a"), ("b", "b")], "parent string, sheet string")
    parts = spark.createDataFrame([("a", "a :: 1")], "parent string, sheet string")
    assert as_set(sheets.prefer_sections(whole, parts)) == {("a", "a :: 1"), ("b", "b")}
    typed = spark.createDataFrame([("Cover ", "x", 0.9), ("BS", "x", 0.9), ("IS", "unknown", 0.1), ("CF", "x", 0.2)], "sheet string, doc_type string, score double")
    assert as_set(sheets.usable_sheets(typed).select("sheet")) == {("BS",)}


def test_sections_do_not_depend_on_blocks(spark):
    part = [["Metric", "2022"], ["Cash", "1"], ["Debt", "2"], ["Equity", "3"]]
    sheets_ = {
        "a": [["Note", None]] + part * 3 + [["Second table", None]] + part + [["Item", "2023"], ["Cash", "4"], ["Debt", "5"], ["3", "6"], ["Third", None], ["Item", "Value"], ["x", "y"], ["z", "1"]],
        "b": part + [["Lone", None], ["Other", None], ["Head", "Q1"]] + part[1:] + [["End", None]],
        "c": [["A", "2021"], ["Early", None]] + part + part,
    }
    base = {"a": 1, "b": 0, "c": 0}
    want = {(k, n, *f) for k, cells in sheets_.items() for n, f in enumerate(sheets.find_sections(cells, base[k]))}
    assert {("a", 0, 1, None), ("a", 1, 5, None), ("a", 3, 14, "Second table")} < want
    rows = spark.createDataFrame([(k, i, c) for k, cells in sheets_.items() for i, c in enumerate(cells)], "sheet string, row_no int, cells array<string>")
    h = spark.createDataFrame([(k, b, sheets_[k][b], 1.0) for k, b in base.items()], "sheet string, header_row int, header array<string>, score double")
    for max_rows in (1, 3, 5, 14, 100):
        assert as_set(sheets.sections(rows, h, max_rows)) == want
