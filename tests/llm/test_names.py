import random

import pytest

from dealweave.llm.edit import within
from dealweave.llm.names import SegmentIndex, link_names, meet, read_firm_or_person, read_instrument, variant_pairs, word_changes


@pytest.mark.parametrize(
    "a, b",
    [("Hesburn Manufacturing", "Hesburn Mfg"), ("Stowick, Bob", "Robert Stowick"), ("Selwyn Energy Services L.L.C.", "energy services, selwyn"), ("The Rosfell Logist.", "Rosfell Logistics"), ("Taldor Lakeside Energy Services Inc.", "Taldor Lakeside Energy Services, Co. (main acct)"),
     ("Falwyn School District, LP #080", "Falwyn School District L.L.C."), ("Corbeck, Alexander Roofing", "Alexander Corbeck Roofing"), ("Malrell Property Services Unit 30", "Malrell Property Services Unit 30 Inc"), ("Dovholm Summit Distribution Unit 71", "Summit Distribution Unit 71, Dovholm")],
)
def test_firm_keys_agree(a, b):
    assert read_firm_or_person(a)[:2] == read_firm_or_person(b)[:2]


@pytest.mark.parametrize(
    "a, b",
    [("Calmore Capital Revolving Credit Facility", "Revolver (Calmore)"), ("TL A", "Dovfield Bank Term Loan A"), ("VENDOR NOTE (SELLER)", "Seller Note"), ("Sr Notes 2026", "Nesstad Credit Union Senior Notes 2026"), ("9 Eqpt. Nt", "Equipment Note 9"), ("Mezz. debt", "Mezzanine Notes - Calburn Finance"),
     ("Calburn Finannce Mezzanine Notes", "Mezzannine Notes"), ("Bridge Ln - Acq", "Acquisition Bridge Loan"), ("Term Loan, Delayed Draw (Undlin)", "DDTL"), ("R/E Mtg", "Real Estaet Mortgage"), ("Fleet vehicle lease (Nesgate)", "Vehicle Finanec Lease"), ("EQUIPMENT LOC", "Eqpt Line of Credit"), ("S/H LOAN", "Loan from Shareholder")],
)
def test_instrument_keys_agree(a, b):
    assert read_instrument(a)[:2] == read_instrument(b)[:2]


@pytest.mark.parametrize("a, b", [("Term Loan A", "Term Loan B"), ("Senior Notes 2031", "Senior Notes 2032"), ("Senior Term Loan", "Term Loan A"), ("Equipment Note 1", "Equipment Line"), ("Seller Note", "Senior Note")])
def test_relatives_differ(a, b):
    assert read_instrument(a)[:2] != read_instrument(b)[:2]


def test_segment_index_equals_brute_force():
    rng = random.Random(5)
    names = list({"".join(rng.choices("abc", k=rng.randint(3, 9))) for _ in range(120)})
    index = SegmentIndex(names)
    for q in ["".join(rng.choices("abc", k=rng.randint(3, 9))) for _ in range(120)]:
        assert index.near(q) == sorted(x for x in names if within(q, x, 1) <= 1)


def linked(spark, rows, reader="firm"):
    df = spark.createDataFrame([(i, g, n, "x", 1) for i, (g, n) in enumerate(rows)], "row_id long, deal string, who string, grp string, entity int")
    out = link_names(df, id_col="row_id", group_col="deal", name_col="who", reader=reader)
    got = {}
    for r in out.collect():
        got.setdefault(r.entity, set()).add(r.row_id)
    return out, {frozenset(v) for v in got.values()}


def test_links_within_a_deal(spark):
    names = [
        "Lunvale Manufacturing Company", "Lnuvale Manufacturing", "LUNVALE MANUFACTURING", "Ernwyn Western Precision Castings", "Ernwyn Castings", "Ernwyn Western Pre", "EWPC legacy contract", "Alexander Brenshaw", "BRENSHAW ALEXANDER", "A. Brenshaw",
        "James Stogarth Catering", "Katherine Stogarth Catering", "Malrell Property Services Unit 30", "Malrell Property Services Unit 45", "malrell property svcs unit 45", "Undsby Foods Coastal Ltd", "Undsby Foods East Ltd",
    ]
    _, groups = linked(spark, [("d", n) for n in names] + [("e", names[0]), (None, "x"), ("d", None), ("d", " ")])
    assert groups == {frozenset(x) for x in ({0, 1, 2}, {3, 4, 5, 6}, {7, 8, 9}, {10}, {11}, {12}, {13, 14}, {15}, {16}, {17})}


def test_a_shortened_name_with_two_meanings_stays_alone(spark):
    _, groups = linked(spark, [("d", n) for n in ("James Erndale", "Jennifer Erndale", "J. Erndale")])
    assert groups == {frozenset({0}), frozenset({1}), frozenset({2})}


def test_established_words_a_letter_apart_stay_two(spark):
    rows = [(f"d{i}", n) for i in range(4) for n in ("Ostdale Packaging", "Ostvale Packaging")]
    _, groups = linked(spark, rows)
    assert len(groups) == 8


def test_pairs_repeats_long_names_and_empty(spark):
    out, _ = linked(spark, [("d", "Seller Note"), ("d", "Seller Note"), ("d", "VENDOR NOTE (SELLER)"), ("d", "Seller Note "), ("d", "y" * 50_000)], "instrument")
    assert {tuple(r) for r in variant_pairs(out, "row_id").collect()} == {(0, 2), (1, 2), (0, 3), (1, 3), (2, 3)}
    assert linked(spark, [])[1] == set()


@pytest.mark.parametrize("text", ["a" + " " * 100_000 + "b", "a - " * 20_000, "(" * 50_000, "x" * 100_000, ", " * 50_000, "unit " * 20_000, "'" * 50_000])
def test_long_odd_names_end_soon(text):
    for read in (read_firm_or_person, read_instrument):
        assert len(read(text)) == 3


def test_groups_in_memory_and_joined_give_the_same(spark):
    rng = random.Random(3)
    firsts = ["kestrel", "morland", "hadley", "brookwick", "sandhurst"]
    rests = ["harbor packaging", "precision castings", "county water district", "foods"]
    names = []
    for _ in range(150):
        n = f"{rng.choice(firsts)} {rng.choice(rests)}"
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(n))
            n = rng.choice([n[:i] + n[i + 1 :], n[:i] + rng.choice("aeklr") + n[i:], n[:i] + n[i : i + 2][::-1] + n[i + 2 :], n[: max(9, i)], n])
        names.append(n)
    df = spark.createDataFrame([(i, "d", n) for i, n in enumerate(names)], "row_id long, deal string, who string")
    out = [link_names(df, id_col="row_id", group_col="deal", name_col="who", in_memory=k).collect() for k in (1000, 1)]
    assert sorted(map(tuple, out[0])) == sorted(map(tuple, out[1]))
    assert len({r.entity for r in out[0]}) < len(set(names))


def test_shared_segments_find_all_close_keys():
    rng = random.Random(9)
    keys = list({"".join(rng.choices("ab c", k=rng.randint(4, 16))).strip() for _ in range(150)})
    keys = [" ".join(k.split()) for k in keys if k.split()]
    nodes = {i: (k, "", "full") for i, k in enumerate(dict.fromkeys(keys))}
    want = {(i, j) for i in nodes for j in nodes if i < j and word_changes(nodes[i][0], nodes[j][0]) is not None}
    assert {(a, b) for kind, a, b, _, _ in meet(nodes) if kind == "t"} == want and want


@pytest.mark.parametrize(
    "a, b, same",
    [("lunvale foods", "kunvale foods", True), ("lunvale foods", "lunvalefoods", True), ("lunvale county foods", "lunvael conty foods", True), ("3m foods", "3n foods", False), ("ab foods", "ac foods", False), ("unit 12 foods", "unit 13 foods", False),
     ("a1b foods", "a1c foods", True), ("ashvale hotel", "ashley hotel", False), ("eli", "elj", True)],
)
def test_edits_anywhere_in_a_key(a, b, same):
    assert (word_changes(a, b) is not None) == same


def test_loans_of_one_kind_from_two_lenders(spark):
    names = ["Calmore Capital Revolving Credit Facility", "Dovfield Bank Revolver", "Revolver", "RCF (Calmore)", "Selley Bank Seller Note", "Seller Note", "Sellwy Bank Vendor Note"]
    _, groups = linked(spark, [("d", n) for n in names], "instrument")
    assert groups == {frozenset({0, 3}), frozenset({1}), frozenset({2}), frozenset({4, 5, 6})}


def test_mistyped_short_name_goes_with_the_short_name(spark):
    _, groups = linked(spark, [("d", n) for n in ("Kestrel Harbor Packaging", "Kestrel Packaging", "Kestral Packaging")])
    assert groups == {frozenset({0, 1, 2})}


def test_abbreviations_that_no_table_lists(spark):
    _, groups = linked(spark, [("d", n) for n in ("Rudwick Laundromat Franchise", "Rudwick Lndrmt Frnchs", "Rudwick Launch Fruit")])
    assert groups == {frozenset({0, 1}), frozenset({2})}
