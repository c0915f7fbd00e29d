import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dealweave.operators import units
from dealweave.operators.changepoint import level_shifts, segment, segment_pieces
from dealweave.operators.units import amounts_in_dollars, rates_in_percent, silent_unit_changes, stated_scale

SCHEMA = "row_id long, file_id string, row_idx int, sheet_title string, revenue_header string, customer string, revenue string, pct string"


def cost(y, cuts, penalty):
    ends = [0, *cuts, len(y)]
    return sum(((y[a:b] - y[a:b].mean()) ** 2).sum() for a, b in zip(ends, ends[1:])) + penalty * len(cuts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.1, 1.0, 3.0, 3.2, 6.0]), min_size=1, max_size=8), st.sampled_from([0.1, 1.0, 3.0]))
def test_segments_are_optimal(values, penalty):
    y = np.array(values)
    found = [a for a, _ in segment(y, penalty)][1:]
    best = min(cost(y, c, penalty) for n in range(len(y)) for c in itertools.combinations(range(1, len(y)), n))
    assert cost(y, found, penalty) == pytest.approx(best)


def test_level_shifts_name_the_known_factor():
    y = np.array([0.1, -0.1, 0.0, 3.05, 2.9, 0.0, -6.0])
    assert level_shifts(y, (0.0, 3.0, -3.0, 6.0, -6.0), 1.0, 0.5, 0.0).tolist() == [0, 0, 0, 3, 3, 0, -6]
    assert segment(np.array([]), 1.0) == [] and level_shifts(np.array([]), (0.0,), 1.0, 1.0).size == 0


@pytest.mark.parametrize(
    "text, scale",
    [("T (Angaben in Tsd. USD)", 3), ("T | US$ '000", 3), ("$000; T", 3), ("amounts in $K", 3), ("all numbers x 1,000", 3), ("in Mio. USD", 6), ("(US$ M)", 6), ("Revenue (M$)", 6), ("$MM", 6), ("Rev. in $MM", 6),
     ("excludes accounts under $10 thousand", None), ("accounts over $50K only", None), ("top 1,000 accounts", None), ("platform with $30mm target revenue", None), ("Sales mix FY2000", None), (None, None)],
)
def test_stated_scale(spark, text, scale):
    from pyspark.sql import functions as F

    assert spark.range(1).select(stated_scale(F.lit(text).cast("string"))).first()[0] == scale


def amounts(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = amounts_in_dollars(df, row_id="row_id", file="file_id", place="row_idx", value="revenue", name="customer", title="sheet_title", header="revenue_header", share="pct")
    return {r.row_id: (r.dollars, r.decades, r.evidence) for r in out.collect()}


def test_order_of_evidence(spark):
    rows = [
        (1, "a", 1, "T ($ in thousands)", "Sales", "Ann", "1,200", "60%"), (2, "a", 2, "T ($ in thousands)", "Sales", "Bob", "$0.8 mm", "40"), (3, "a", 3, None, "Sales", "Total", "2,000,000", "100%"),
        (4, "b", 1, "T ($ in thousands)", "Sales ($mm)", "Ann", "2", None), (5, "c", 1, None, None, "Ann", "5", None), (6, "c", 2, None, None, "Note: USD in 000s", None, None), (7, "d", 1, None, "Sales", "Ann", "86 143", None),
        (8, "d", 2, None, "Sales", "Bob", "n/a", None), (9, "d", 3, None, "Sales", None, None, None), (10, None, None, None, None, None, "12 (000s)", "x"), (11, "e", 1, "$K", None, "Total", "7", None), (12, "e", 2, "$K", None, "Zed", "0", None),
    ]
    got = amounts(spark, rows)
    assert got[1] == (1_200_000, 3, "stated") and got[2] == (800_000, 6, "cell")
    assert got[3] == (2_000_000, 0, "level")  # the total agrees with its customers in whole dollars
    assert got[4] == (2_000_000, 6, "stated") and got[5] == (5_000, 3, "stated") and got[7] == (86_143, 0, "default")
    assert 8 not in got and 9 not in got and got[10][0] == 12_000
    assert got[11] == (7_000, 3, "stated") and got[12][0] == 0


def test_long_file_in_blocks_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(units, "BLOCK_ROWS", 16)
    rows = [(i, "a", i // 2, "in $K", None, f"C{i}", str(10 + i % 7), None) for i in range(100)] + [(200, "a", 60, None, None, "Grand total", "1,270,000", None)]
    got = amounts(spark, rows)
    assert len(got) == 101 and got[200] == (1_270_000, 0, "level") and all(got[i][1] == 3 for i in range(100))


def test_rates(spark):
    schema = "row_id long, file_id string, row_idx int, sheet_title string, instrument string, rate string, __y string"
    rows = [
        (1, "a", 1, None, "L", "4.95%", "z"), (2, "a", 2, None, "L", "0.137", "z"), (3, "a", 3, None, "L", "865 basis points", "z"), (4, "a", 4, None, "L", "0.28%/mo", "z"), (5, "a", 5, None, "L", "10 1/4%", "z"), (6, "a", 6, None, "L", "6.5", "z"),
        (7, "b", 1, "rates in bps", "L", "425", "z"), (8, "b", 2, "rates in bps", "L", "4.5 %", "z"), (9, "c", 1, None, "* interest in b.p.", None, "z"), (10, "c", 2, None, "L", "1,230", "z"), (11, "c", 3, None, None, "tbd", None), (12, "d", 1, None, "L", "0.9 % monthly", None),
    ]
    out = rates_in_percent(spark.createDataFrame(rows, schema), row_id="row_id", file="file_id", place="row_idx", value="rate", name="instrument", title="sheet_title")
    assert {r.row_id: r.milli_percent for r in out.collect()} == {1: 4950, 2: 13700, 3: 8650, 4: 3360, 5: 10250, 6: 6500, 7: 4250, 8: 4500, 10: 12300, 12: 10800}


def test_huge_numbers_do_not_fail(spark):
    got = amounts(spark, [(1, "a", 1, None, None, "Ann", "9" * 15 + " mm", None), (2, "a", 2, None, None, "Bob", "9" * 40, None), (3, "a", 3, None, None, "Cid", "x" * 100_000, "y" * 100_000), (4, "a", 4, "$K" * 50_000, None, "Dan", "123456789012345678", None)])
    assert got[1][0] is None and 2 not in got and 3 not in got and 4 in got
    schema = "row_id long, file_id string, row_idx int, sheet_title string, instrument string, rate string"
    rates = rates_in_percent(spark.createDataFrame([(1, "a", 1, None, "L", "9" * 18 + "%"), (2, "a", 2, None, "L", "12345678 per month")], schema), row_id="row_id", file="file_id", place="row_idx", value="rate", name="instrument", title="sheet_title")
    assert {r.row_id for r in rates.collect()} == {1, 2}


def test_empty_table(spark):
    assert amounts(spark, []) == {}


def shifts_of(spark, values, block_rows, spread=0.05):
    rng = random.Random(2)
    rows = [(i, "f", i, None if v is None else v * 10 ** rng.uniform(-spread, spread), "clash") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "row_id long, file string, at long, value double, level_shift string")
    out = silent_unit_changes(df, keys=["file"], place="at", value="value", row_id="row_id", block_rows=block_rows).collect()
    return {r.row_id: (r.level_shift, r.restored) for r in out}, {r[0]: r[3] for r in rows}


@pytest.mark.parametrize("block_rows", [1, 7, 16, 1000])
def test_silent_changes_over_the_ends_of_blocks(spark, block_rows):
    truth = [0] * 30 + [-3] * 20 + [0] * 25 + [3] * 9 + [0] * 16
    got, values = shifts_of(spark, [5000.0 * 10**s for s in truth], block_rows)
    assert [got[i][0] for i in range(100)] == truth
    assert all(abs(got[i][1] - values[i] / 10 ** truth[i]) < 1e-6 for i in range(100))


def test_a_level_over_two_blocks_pays_no_second_penalty():
    y = np.array([0.0] * 8 + [0.75] * 2 + [0.75] * 2 + [0.0] * 8)
    pieces = [(8, 0.0, 0.0), (2, 1.5, 1.125), (2, 1.5, 1.125), (8, 0.0, 0.0)]
    n, s1, s2 = (np.array(c, dtype=float) for c in zip(*pieces))
    assert segment(y, 0.5) == [(0, 8), (8, 12), (12, 20)]
    assert segment_pieces(n, s1, s2, 0.5) == [(0, 1), (1, 3), (3, 4)]


def test_silent_changes_of_odd_rows(spark):
    schema = "row_id long, file string, at long, value double"
    rows = [(1, None, 1, 100.0), (2, None, 2, 0.0), (3, None, None, 90.0), (4, None, 3, None), (4, None, 3, 95.0), (5, "g", 1, float("nan"))]
    out = silent_unit_changes(spark.createDataFrame(rows, schema), keys=["file"], place="at", value="value", row_id="row_id").collect()
    assert sorted((r.row_id, r.level_shift) for r in out) == [(1, 0), (2, 0), (3, 0), (4, 0), (4, 0), (5, 0)]
    assert silent_unit_changes(spark.createDataFrame([], schema), keys=["file"], place="at", value="value", row_id="row_id").count() == 0
