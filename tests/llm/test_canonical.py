import random
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dealweave.llm.canonical import ALIASES, LabelMatcher, default_tolerance, label_paths, map_labels, plain_label
from dealweave.llm.edit import Trie, within

LABELS = {i: label for i, label in enumerate(ALIASES)}
ID = {label: i for i, label in LABELS.items()}


def osa(a: str, b: str) -> int:
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


WORDS = st.text("abc ", max_size=9)


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS, st.integers(0, 3))
def test_banded_distance(a, b, k):
    assert within(a, b, k) == min(osa(a, b), k + 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(WORDS, max_size=12), WORDS, st.integers(0, 3))
def test_trie_returns_all_entries_in_reach(paths, query, k):
    trie = Trie([(p, i) for i, p in enumerate(paths)])
    assert {e: d for d, e in trie.search(query, k)} == {i: osa(p, query) for i, p in enumerate(paths) if osa(p, query) <= k}


@pytest.mark.parametrize(
    "text, label",
    [("Cash", "Cash"), ("  Accumulated Depreciation", "Accumulated Depreciation"), ("GL 1050: Deferred Revenue", "Deferred Revenue"), ("1305 Plant, property & equip", "Property, Plant and Equipment"), ("4. Marketable securities", "Short-Term Investments"),
     ("TOTAL ASSErS =", "Total Assets"), ("Curr. Portion of Lg Term Debt (Note 3)", "Current Portion of Long Term Debt"), ("Property,_Plant_and_Equipment", "Property, Plant and Equipment"), ("- Tot. assets .....", "Total Assets"), ("Goodwlil per TB", "Goodwill"), ("AR - net [1]", "Accounts Receivable"),
     ("TCA", "Total Current Assets"), ("TCL", "Total Current Liabilities"), ("Shareholders' eqyity - unaudited", "Equity"), ("Inventory, net", "Inventory"),
     ("TCX", None), ("Due from sister co", None), ("Inventory turns (x)", None), ("Metric", None), ("Closing accounts - Golbrook Veterinary Clinics", None), ("($ thousands)", None), ("?", None), ("Rounding 18", None)],
)
def test_labels(text, label):
    m = LabelMatcher(label_paths(LABELS))
    assert m.match(text)[0] == (ID[label] if label else None)


def test_one_edit_in_any_long_label_is_found():
    rng, m = random.Random(3), LabelMatcher(label_paths(LABELS))
    for i, label in LABELS.items():
        if len(plain_label(label)) > 5:
            for _ in range(5):
                k = rng.randrange(1, len(label))
                assert m.match(label[:k] + rng.choice(string.ascii_lowercase) + label[k:])[0] == i, label


def test_ties_are_unmatched_and_tolerance_grows():
    assert LabelMatcher([("abcdef", 1), ("abcdeg", 2)]).match("abcdeh") == (None, None)
    assert [default_tolerance(n) for n in (4, 5, 11, 12)] == [0, 1, 1, 2]


def test_rows(spark):
    rows = [(1, "Cash", "x"), (2, None, None), (3, "  ", "y"), (4, "Csh & eqivs", None), (4, "Csh & eqivs", None), (5, "x" * 200_000, None), (None, "Goodwill", None)]
    df = spark.createDataFrame(rows, "row_id long, c0 string, item_id string")
    got = map_labels(df, list(LABELS.items()), id_col="row_id", text_col="c0").select("row_id", "item_id", "distance").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, ID["Cash"], 0), (4, ID["Cash"], 1), (4, ID["Cash"], 1), (5, None, None), (None, ID["Goodwill"], 0)], key=str)
    assert map_labels(df.limit(0), list(LABELS.items()), id_col="row_id", text_col="c0").count() == 0
    assert map_labels(df, [], id_col="row_id", text_col="c0").filter("item_id is not null").count() == 0


@pytest.mark.parametrize("text", ["Cash" + " " * 100_000 + "x", "Cash " + "." * 100_000 + " x", ":" * 100_000 + "x", "(" * 100_000, "- " * 50_000, "1" * 100_000, "cash (note 1" * 10_000])
def test_long_odd_texts_end_soon(text):
    assert LabelMatcher(label_paths(LABELS)).match(text) == (None, None)


def test_long_runs_of_dots_are_decoration():
    assert LabelMatcher(label_paths(LABELS)).match("Cash " + "." * 100_000)[0] == ID["Cash"]


def by_labels_alone():
    return LabelMatcher(label_paths(LABELS, {}))


@pytest.mark.parametrize(
    "text, label",
    [("Accts Recv", "Accounts Receivable"), ("A/R", "Accounts Receivable"), ("PPE", "Property, Plant and Equipment"), ("APIC", "Additional Paid-In Capital"), ("Assets, total", "Total Assets"), ("tot. curr. liabs", "Total Current Liabilities"), ("Curr Ptn LT Debt", None),
     ("Def Tx Asts", "Deferred Tax Assets"), ("Ttl Lblts & Eqty", "Total Liabilities and Equity"), ("Total Assessments", None), ("Dep", None), ("Tax", None), ("Long Debt Term", None)],
)
def test_shortened_and_turned_labels_need_no_list(text, label):
    got = by_labels_alone().match(text)[0]
    assert (LABELS[got] if got is not None else None) == label
