import random

import pytest

from dealweave.llm.mixing import SPLIT, TOKENIZER, SourceTarget, copy_rates, count_tokens, mix, pivot, shares_reached

TARGETS = [SourceTarget("a", 0.5, 2), SourceTarget("b", 0.3, 3), SourceTarget("c", 0.1, 4), SourceTarget("none", 0.1, 9)]


def test_rates_reach_shares_within_repeats():
    tokens = {"a": 1000, "b": 400, "c": 20}
    r = copy_rates(TARGETS, tokens)
    used = {s: r[s] * tokens[s] for s in r}
    assert r["c"] == 4.0 and used["a"] / used["b"] == pytest.approx(5 / 3) and used["a"] / used["c"] == pytest.approx(5)
    assert all(r[t.source] <= t.max_repeats for t in TARGETS if t.source in r) and copy_rates(TARGETS, {}) == {}
    big = copy_rates(TARGETS, tokens, total=2000)
    assert big["c"] == 4.0 and sum(big[s] * tokens[s] for s in big) == pytest.approx(2000)
    assert copy_rates(TARGETS, tokens, total=1e9) == {"a": 2.0, "b": 3.0, "c": 4.0}


def test_pivot_keeps_size_and_expectation():
    rng = random.Random(3)
    sizes, probs = [rng.randint(0, 50) for _ in range(40)], [rng.choice([0.0, 1.0, 0.3, 0.7]) for _ in range(40)]
    ones = [0] * 40
    for seed in range(600):
        out = pivot(list(range(40)), sizes, probs, seed)
        loose = [p for p in out if p not in (0.0, 1.0)]
        assert len(loose) <= 1
        assert sum(s * p for s, p in zip(sizes, out)) == pytest.approx(sum(s * p for s, p in zip(sizes, probs)), abs=1e-6)
        ones = [n + p for n, p in zip(ones, out)]
    assert all(abs(n / 600 - p) < 0.1 for n, p in zip(ones, probs))


def frame(spark, n=3000):
    rng = random.Random(5)
    words = "revenue debt margin of the and 12,345 façade naïve".split()
    rows = [(i, rng.choices(["a", "b", "c", "x", None], [60, 25, 5, 5, 5])[0], " ".join(rng.choices(words, k=rng.randint(0, 60))) if i % 50 else None, 1) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, copies int")


def test_mixture(spark, monkeypatch):
    import dealweave.llm.mixing as m

    monkeypatch.setattr(m, "FAN_IN", 16)  # several levels of the tree
    df = frame(spark)
    got = mix(df, TARGETS, id_col="doc_id", source_col="source", text_col="text").toPandas()
    assert got.doc_id.is_unique and set(got.source) == {"a", "b", "c"}
    limits = {t.source: t.max_repeats for t in TARGETS}
    assert all(got.copies <= got.source.map(limits)) and (got.copies >= 1).all()
    shares = {r.source: r for r in shares_reached(spark.createDataFrame(got), TARGETS).collect()}
    for s in "abc":
        assert shares[s].actual_share == pytest.approx(shares[s].target_share / 0.9, abs=0.02)
    assert shares["none"].actual_share == 0 and shares["none"].n_docs == 0
    again = mix(df, TARGETS, id_col="doc_id", source_col="source", text_col="text").toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, again.values.tolist()))


def test_empty_and_unwanted(spark):
    df = frame(spark, 60)
    assert mix(df.limit(0), TARGETS, id_col="doc_id", source_col="source", text_col="text").count() == 0
    assert mix(df, [SourceTarget("zzz", 1.0, 2)], id_col="doc_id", source_col="source", text_col="text").count() == 0


def test_tokens_equal_the_public_pattern(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    one, two = (tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for n, p in (("own", SPLIT), ("public", P.PATTERN)))
    for text in ("It's 12,345  apples\n\n of Mr. X's,\tnaïve ", "  lead", "a" * 300, "'ll we've DON'T", "<|endoftext|>"):
        assert one.encode_ordinary(text) == two.encode_ordinary(text)
    df = spark.createDataFrame([(1, "a", "hello world"), (2, "a", None), (3, None, "")], "doc_id long, source string, text string")
    assert [r["__tokens"] for r in count_tokens(df, id_col="doc_id", source_col="source", text_col="text").collect()] == [2, 0, 0]
