import random

import pytest

from dealweave.llm.leakage import LeakFinder, LeakRule, leaked_items, plain_words, word_offsets

RNG = random.Random(1)
VOCAB = ["".join(RNG.choices("abcdefghijklmnopqrstuvwxyz", k=RNG.randint(3, 8))) for _ in range(3000)]
ITEMS = [(i, " ".join(RNG.sample(VOCAB, 40))) for i in range(20)] + [(90, "just five words in all"), (91, ""), (92, None)]


def filler(n):
    return " ".join(RNG.choices(VOCAB, k=n))


def found(text):
    return sorted(f[0] for f in LeakFinder([x for x in ITEMS if x[1]]).find(text))


def test_words_and_offsets_fit():
    text = "Ｆｕｌｌ-width café, café; z​ero-wi\xaddth асt ﬁ x²"
    words = plain_words(text)
    assert words == ["full", "width", "cafe", "cafe", "zero", "width", "act", "fi", "x2"]
    assert len(word_offsets(text)) == len(words) and [plain_words(text[a:b]) for a, b in word_offsets(text)] == [[w] for w in words]


@pytest.mark.parametrize("length, leaks", [(40, True), (25, True), (18, True), (17, False), (10, False)])
def test_passage_length(length, leaks):
    words = ITEMS[3][1].split()
    start = 5 if length < 30 else 0
    passage = ", ".join(words[start : start + length]).upper()
    assert found(f"{filler(50)}\n{passage}. {filler(50)}") == ([3] if leaks else [])


def test_changed_words_and_interruptions():
    words = ITEMS[4][1].split()
    changed = [w if i % 6 != 3 else "changed" for i, w in enumerate(words[:30])]
    assert found(filler(20) + " " + " ".join(changed)) == [4]
    assert found(" ".join(words[:12]) + " " + filler(10) + " " + " ".join(words[12:26])) == [4]
    assert found(" ".join(words[:9]) + " " + filler(60) + " " + " ".join(words[9:18])) == []
    assert found(" ".join(reversed(words))) == []
    assert found(" ".join(words[:8] + words[14:22])) == []  # a template with another middle


def test_several_items_and_short_items():
    assert found(ITEMS[5][1] + " " + ITEMS[6][1]) == [5, 6]
    assert found("Well: just FIVE words, in all.") == [90] and found("just five words in") == []


def test_equals_brute_force_for_clean_passages():
    rule, finder = LeakRule(), LeakFinder(ITEMS[:20])
    for _ in range(60):
        item, n = RNG.randrange(20), RNG.randint(8, 40)
        w = ITEMS[item][1].split()
        at = RNG.randint(0, 40 - n)
        text = filler(RNG.randint(0, 30)) + " " + " ".join(w[at : at + n]) + " " + filler(5)
        brute = sorted(i for i, t in ITEMS[:20] if any(" ".join(t.split()[k : k + rule.min_words]) in text for k in range(40 - rule.min_words + 1)))
        assert sorted(f[0] for f in finder.find(text)) == brute


def test_rows(spark):
    long = filler(100_000) + " " + ITEMS[7][1] + " " + filler(10)
    rows = [(1, ITEMS[1][1].replace(" ", "  ").title(), "x"), (2, None, "x"), (3, "", "x"), (4, long, "x"), (5, ITEMS[1][1], "x"), (5, ITEMS[1][1], "x"), (None, ITEMS[2][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    got = leaked_items(df, ITEMS, id_col="doc_id", text_col="text").collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted([(1, 1), (4, 7), (5, 1), (5, 1), (None, 2)], key=str)
    r = next(r for r in got if r.doc_id == 4)
    assert long[r.start : r.end] == ITEMS[7][1]
    assert leaked_items(df.limit(0), ITEMS, id_col="doc_id", text_col="text").count() == 0 and leaked_items(df, [], id_col="doc_id", text_col="text").count() == 0


def test_every_third_word_changed_and_changes_at_the_ends():
    words = ITEMS[7][1].split()
    assert found(" ".join(w if i % 3 != 2 else "changed" for i, w in enumerate(words))) == [7]
    for at in (1, 16):
        assert found(filler(9) + " " + " ".join(w if i != at else "changed" for i, w in enumerate(words[:18])) + " " + filler(9)) == [7]
    assert found(" ".join(words[:17]) + " " + filler(20) + " " + " ".join(words[30:31])) == []


def test_pairs_of_words_alone_are_not_chained():
    words = ITEMS[8][1].split()
    assert found(" ".join(" ".join(words[i : i + 2]) + " " + filler(3) for i in range(0, 40, 2))) == []
