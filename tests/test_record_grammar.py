import datetime as dt

import pytest

from dealweave.operators.record_grammar import DEBT_RECORD, REVENUE_RECORD, RecordReader, bad_records, parse_records

from support import as_set


def first(spec, text):
    return next(iter(RecordReader(spec).text(text)))


@pytest.mark.parametrize(
    "text, reason",
    [
        ("Term Loan A,\"6,033\",2.1%,2026-01-28, 1777", None),
        ("Term Loan A,$2653,9.66%,1/8/2030,", None),
        ('"Note ""old""",(6547),6.5%,8/12/2028,1647', None),
        ('"Seller Note\n(cont.)","5,264",3.4%,2034-01-02,1373.0', None),
        ('"Loan,12,3%,2030-01-01,', "quoting"),
        ('Loan",12,3%,2030-01-01,', "quoting"),
        ('"Loan" x,12,3%,2030-01-01,', "quoting"),
        ('Loan,12,3%,2030-01-01,"', "quoting"),
        ("Loan,12,3%,2030-01-01", "column_count"),
        ("Loan,68,073,5.0%,2032-11-09,", "column_count"),
        ("Loan;12;3%;2030-01-01;", "column_count"),
        (",12,3%,2030-01-01,", "invalid_value"),
        ('"",12,3%,2030-01-01,', "invalid_value"),
        ("Loan,2..4,3%,2030-01-01,", "invalid_value"),
        ("Loan,1,23,3%,2030-01-01,", "column_count"),
        ("Loan,12,3%%,2030-01-01,", "invalid_value"),
        ("Loan,12,,2030-01-01,", "invalid_value"),
        ("Loan,12,3%,2027-02-30,", "invalid_value"),
        ("Loan,12,3%,30/06/2028,", "invalid_value"),
        ("Loan,12,3%,2030-01-01,TBD", "invalid_value"),
        ('"Loan,2..4"x,3%', "quoting"),
    ],
)
def test_first_reason(text, reason):
    assert first(DEBT_RECORD, text).reason == reason


def test_values_are_typed():
    assert first(DEBT_RECORD, 'A,"($1,234.5)", 6 %,1/8/2030,').values == ["A", -1234.5, 6.0, dt.date(2030, 1, 8), None]


def test_reading_resumes_at_a_valid_record_after_a_broken_quote():
    got = list(RecordReader(REVENUE_RECORD).text('"Ann,12,3%\nnot a record\nBob,5,1%\nCid,6,2%'))
    assert [(r.reason, r.offset if r.reason else None) for r in got] == [("quoting", 0), (None, None), (None, None)]
    assert got[1].values[0] == "Bob"


def test_headers_notes_blanks_and_nulls(spark):
    lines = [
        (1, "f", 1, "Title"), (2, "f", 2, "Customer / Account,Revenue,% Mix"), (3, "f", 3, "Ann,1,2%"), (4, "f", 4, "customer / account,revenue,% mix"), (5, "f", 5, None), (6, "f", 6, "  "),
        (7, "f", 7, ",,"), (8, "f", 8, "Note, bad"), (9, "f", 9, "* bad"), (10, "f", 10, "Bob,x,1%"), (10, "f", 10, "Bob,x,1%"), (11, None, 1, "no header"), (12, "f", None, "Cid,1"), (13, "g", 1, "a,b"),
    ]
    df = spark.createDataFrame([(*r, "extra", 0) for r in lines], "line_id long, file_id string, line_no int, c0 string, reason string, record_no int")
    parsed = parse_records(df, REVENUE_RECORD, id_col="line_id", file_col="file_id", line_col="line_no", text_col="c0")
    assert as_set(bad_records(parsed, "line_id")) == {(10, "invalid_value"), (11, "column_count"), (12, "column_count"), (13, "column_count")}
    assert parsed.filter("line_id = 3").select("customer", "revenue", "mix").collect()[0] == ("Ann", 1.0, 2.0)


def test_empty_table_and_very_long_text(spark):
    schema = "line_id long, file_id string, line_no int, c0 string"
    empty = parse_records(spark.createDataFrame([], schema), REVENUE_RECORD, id_col="line_id", file_col="file_id", line_col="line_no", text_col="c0")
    assert empty.count() == 0 and "mix" in empty.columns
    long = spark.createDataFrame([(1, "f", 1, "x" * 300_000 + ",1,2"), (2, "f", 2, '"' * 100_001)], schema)
    assert as_set(bad_records(parse_records(long, REVENUE_RECORD, id_col="line_id", file_col="file_id", line_col="line_no", text_col="c0"), "line_id")) == {(2, "quoting")}
