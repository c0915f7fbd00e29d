import itertools
import random
import unicodedata

import pytest

from dealweave.llm.lookalikes import TO_LATIN, fold, main_script, one_form, readings, same_look_pairs

BACK = {}
for _other, _latin in TO_LATIN.items():
    BACK.setdefault(_latin, []).append(_other)


@pytest.mark.parametrize("text, want", [("Ｆｕｌｌ　５％", "Full 5%"), ("ﬁrst\xa0o​ﬀer x", "first offer x"), ("café", "café"), ("so­ft﻿", "soft"), ("a‐b‑c－d", "a-b-c-d"), ("a–b", "a–b"), ("x² ½", "x² ½"), ("two  spaces\r\nline", "two  spaces\nline")])
def test_fold(text, want):
    assert fold(text) == want


def test_readings():
    assert readings("plain", "LATIN") == [] and readings("слово", "CYRILLIC") == []
    assert readings("раyment", "LATIN") == ["payment"]
    assert readings("а", "LATIN") == ["a"] and readings("ɡoo", "LATIN") == ["goo"]
    assert readings("жar", "LATIN") == []  # no look-alike
    assert main_script("12 %") == "LATIN" and main_script("слово и а") == "CYRILLIC"


def damage(text, rng):
    out = []
    for c in text:
        x = rng.random()
        if x < 0.06 and c in BACK:
            c = rng.choice(BACK[c])
        elif x < 0.1 and c != "\n":
            c += rng.choice("​‌­﻿")
        elif x < 0.2 and "!" <= c <= "~":
            c = chr(ord(c) + 0xFEE0)
        elif x < 0.5 and c == " ":
            c = rng.choice("\xa0  ")
        elif unicodedata.normalize("NFD", c) != c and x < 0.7:
            c = unicodedata.normalize("NFD", c)
        out.append(c)
    return "".join(out)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(8)
    words = "payment café covenant sales EBITDA of a the margin déficit 2024-Q3 Über lease A2637".split()
    base = [" ".join(rng.choices(words, k=12)) for _ in range(40)]
    texts = []
    for b in base:
        texts += [b, *(damage(b, rng) for _ in range(rng.randint(0, 3)))]
        if rng.random() < 0.3:
            texts.append(b.swapcase())
        if "é" in b:
            texts.append(b.replace("é", "e"))
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1000, None, "x"), (1001, "", "x"), (1002, "", "x"), (1003, "​", "x"), (1004, "слово о cделке", "x"), (1005, "слово о сделке", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form_key string")
    got = {tuple(r) for r in same_look_pairs(one_form(df, id_col="doc_id", text_col="text", with_text=False), "doc_id").collect()}
    look = lambda t: unicodedata.normalize("NFC", "".join(TO_LATIN.get(c, c) for c in unicodedata.normalize("NFD", fold(t))))
    want = {(i, j) for (i, s), (j, t) in itertools.combinations(list(enumerate(texts)), 2) if s != t and look(s) == look(t)}
    assert got == want | {(1001, 1003), (1002, 1003), (1004, 1005)}


def test_forms_keep_foreign_words_and_repeats(spark):
    rows = [(1, "the раyment of a lease"), (2, "payment"), (3, "Это слово"), (4, "xуz unknowп"), (5, "x" * 200_000 + " раyment"), (5, "раyment"), (None, "ﬁne раyment")]
    got = one_form(spark.createDataFrame(rows, "doc_id long, text string"), id_col="doc_id", text_col="text").select("doc_id", "form").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "the payment of a lease"), (2, "payment"), (3, "Это слово"), (4, "xуz unknowп"), (5, "x" * 200_000 + " payment"), (5, "payment"), (None, "fine payment")], key=str)


def test_empty(spark):
    forms = one_form(spark.createDataFrame([], "doc_id long, text string"), id_col="doc_id", text_col="text")
    assert forms.count() == 0 and same_look_pairs(forms, "doc_id").count() == 0
