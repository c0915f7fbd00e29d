"""Queries whose SQL leaves rows out, against brute force over all rows."""

import datetime as dt

from dealweave.plans import checks, documents

from support import as_set

EVIDENCE = "evidence_id bigint, deal_id string, concept_key string, doc_type string, period_key string, value double, source_ref string, confidence double, reviewed boolean, extracted_at timestamp_ntz"


def test_conflicts_beyond_the_thirteenth_record(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    near = [(i, "d", "revenue", "x", "2023", 100.0, "", 0.9 - i / 1000, True, day) for i in range(20)]
    far = [(90, "d", "revenue", "x", "2023", 500.0, "", 0.1, False, None), (91, "d", "revenue", "x", "2022", 100.0, "", 0.1, False, day), (92, "d", "revenue", "x", "2023", 104.0, "", 0.1, False, day), (93, "d", "revenue", "x", None, None, "", 0.1, False, day)]
    spark.createDataFrame(far + near, EVIDENCE).write.parquet(f"{tmp_path}/evidence_resolver.parquet")
    want = {("d", "revenue", i, 0.0, "low") for i in range(1, 20)} | {("d", "revenue", 90, 0.8, "high"), ("d", "revenue", 91, 0.0, "medium")}
    assert as_set(documents.evidence_conflicts(spark, str(tmp_path))) == want


def test_nearest_maturity_reads_both_date_styles(spark, tmp_path):
    rows = [("d", "mixed", "a", "2027-01-31", "5"), ("d", "mixed", "b", "3/4/2026", None), ("d", "slashed", "a", "12/1/2030", None), ("d", "slashed", "b", "2/10/2029", "1"), ("d", "none", "a", None, "1"), ("d", "none", None, "2020-01-01", "1")]
    spark.createDataFrame(rows, "deal_id string, file_id string, instrument string, maturity string, annual_debt_service string").write.parquet(f"{tmp_path}/debt_schedule.parquet")
    want = {("d", "mixed", "2026-03-04", 2, 1, 0), ("d", "slashed", "2029-02-10", 2, 1, 0), ("d", "none", "", 1, 1, 1)}
    assert as_set(checks.debt_files(spark, str(tmp_path))) == want


def test_evidence_without_a_type_is_not_suppressed(spark, tmp_path):
    rows = [(1, "d", "revenue", None, "", 1.0, None, 0.5, True, None), (2, "d", "revenue", "Projections", "", 1.0, "x", 0.5, True, None), (3, "d", "ebitda", "qoe_report", "", 1.0, "x", 0.5, True, None), (4, "d", None, None, "", 1.0, None, 0.5, True, None)]
    spark.createDataFrame(rows, EVIDENCE).write.parquet(f"{tmp_path}/evidence_resolver.parquet")
    assert as_set(checks.evidence_unsuppressed(spark, str(tmp_path))) == {(1, "revenue"), (3, "ebitda"), (4, None)}
