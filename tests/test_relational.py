import random

import pytest
from pyspark.sql import functions as F

from dealweave.operators import entities, relational as r
from dealweave.operators.graph import components

from support import as_set


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_penalty_fold_rounds_after_each(spark):
    df = frame(spark, [("a", 2, 0.015), ("a", 1, 0.015), ("a", 3, 0.4), ("a", 4, 0.2), ("b", 1, 0.001)], "k string, o int, x double")
    assert as_set(r.penalty_fold(df, ["k"], "o", "x")) == {("a", 0.45), ("b", 0.0)}


def test_series_stats(spark):
    df = frame(spark, [("a", 3, 121.0), ("a", 1, 100.0), ("a", 2, 110.0), ("a", 4, None), ("b", 1, 5.0), ("c", 1, None)], "k string, o int, v double")
    got = {x.k: x for x in r.series_stats(df, ["k"], "o", "v").collect()}
    assert got["a"].n == 3 and got["a"].last_value == 121 and got["a"].prev_value == 110 and got["a"].cagr == pytest.approx(10) and got["a"].trend == 1 and got["a"].yoy_stddev == pytest.approx(0, abs=1e-9)
    assert got["b"].cagr is None and got["b"].trend is None and got["c"].n == 0 and got["c"].last_value is None


def test_upsert_and_latest(spark):
    base = frame(spark, [(1, 5, "x", False), (2, 1, "y", False)], "k int, s int, v string, gone boolean")
    new = frame(spark, [(1, 1, "z", False), (2, 2, "w", True), (3, 1, "n", False)], "k int, s int, v string, gone boolean")
    assert as_set(r.upsert(base, new, ["k"], "s", "gone").select("k", "v")) == {(1, "z"), (3, "n")}
    events = frame(spark, [(1, 1, "map"), (1, 2, "delete"), (2, 1, None)], "k int, s int, a string")
    assert as_set(r.latest_state(events, ["k"], ["s"], "a", "delete")) == {(2, 1, None)}


def test_wildcard_anti(spark):
    df = frame(spark, [("a", "p"), ("a", "q"), ("b", "p"), ("c", None)], "k string, ref string")
    rules = frame(spark, [("a", "p"), ("b", "")], "k string, ref string")
    assert as_set(r.wildcard_anti(df, rules, ["k"], "ref")) == {("a", "q"), ("c", None)}


def test_pairs_ranges_and_as_of(spark):
    rng = random.Random(1)
    rows = [(k, i, f"{k}{i}") for k in "ab" for i in range(20)]
    got = as_set(r.pairs_within(frame(spark, rows, "k string, o int, v string"), ["k"], "o", ["v"], 3))
    assert got == {(k, f"{k}{i}", f"{k}{j}") for k in "ab" for i in range(20) for j in range(i + 1, min(20, i + 4))}
    points = [("a", float(rng.randint(-20, 60))) for _ in range(40)]
    spans = [("a", float(lo), float(lo + w)) for lo, w in ((-10, 25), (5, 5), (10, 50), (60, 0))]
    got = sorted(tuple(x) for x in r.range_join(frame(spark, points, "k string, x double"), frame(spark, spans, "k string, lo double, hi double"), ["k"], "x", "lo", "hi", 7.0).select("x", "lo").collect())
    assert got == sorted((x, lo) for _, x in points for _, lo, hi in spans if lo <= x < hi)
    left, right = frame(spark, [("a", 5), ("a", 1), ("b", 9)], "k string, t int"), frame(spark, [("a", 3, "u"), ("a", 5, "v"), ("b", 10, "w")], "k string, s int, x string")
    assert as_set(r.as_of_join(left, right, ["k"], "t", "s", ["x"])) == {("a", 5, "v"), ("a", 1, None), ("b", 9, None)}


def test_top_and_modes(spark):
    df = frame(spark, [("a", 3), ("a", 3), ("a", 9), ("a", 9), ("a", 1), ("b", None)], "k string, v int")
    assert as_set(r.greatest_mode(df, ["k"], "v")) == {("a", 9, 2)}
    assert as_set(r.top_shares(df.filter("v is not null"), ["k"], "v", (1, 2))) == {("a", 5, 25, 9, 18)}
    assert as_set(r.top_k(df, ["k"], [F.desc_nulls_last("v")], 1).select("k", "v")) == {("a", 9), ("b", None)}
    w = frame(spark, [("a", 10.0, 5.0), ("a", 30.0, None), ("b", 0.0, 1.0)], "k string, w double, v double")
    assert as_set(r.weighted_average(w, ["k"], "w", "v")) == {("a", 40.0, 1.25), ("b", 0.0, None)}


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(7)
    words = ["term", "loan", "senior", "note", "bank", "line", "real"]
    names = list({" ".join(rng.sample(words, rng.randint(1, 5))) for _ in range(80)})
    got = as_set(entities.similar_pairs(frame(spark, [("g", x) for x in names], "g string, k string"), ["g"], "k", 0.6).select("key_a", "key_b"))
    like = lambda a, b: len(set(a.split()) & set(b.split())) / max(len(set(a.split())), len(set(b.split())))
    assert got == {(a, b) for a in names for b in names if a < b and like(a, b) >= 0.6}


def test_greedy_clusters_compare_with_the_first_name(spark):
    assert [c for c, _ in entities.cluster_in_order(["Acme Steel Works Inc", "Acme Steel Works", "Steel Works", "Acme Steel", "Zed"], 0.66)] == [0, 0, 0, 0, 1]
    df = frame(spark, [("g", "b c", 2), ("g", "a b c", 1), ("h", "a b c", 1), ("g", "Inc.", 3), ("g", "zed", 4)], "g string, n string, o int")
    assert as_set(entities.greedy_clusters(df, ["g"], "n", "o", 0.6).select("g", "name", "cluster")) == {("g", "a b c", "a b c"), ("g", "b c", "a b c"), ("h", "a b c", "a b c"), ("g", "Inc.", "Inc."), ("g", "zed", "zed")}


def test_clusters_by_component_equal_clusters_of_the_whole_group(spark):
    rng = random.Random(11)
    words = ["term", "loan", "senior", "note", "bank", "line", "real", "estate", "bridge"]
    names = list(dict.fromkeys(" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(60)))
    whole = entities.cluster_in_order(names, 0.6)
    first = {}
    for n, (c, _) in zip(names, whole):
        first.setdefault(c, n)
    got = entities.greedy_clusters(frame(spark, [("g", n, i) for i, n in enumerate(names)], "g string, n string, o int"), ["g"], "n", "o", 0.6)
    assert as_set(got.select("name", "cluster")) == {(n, first[c]) for n, (c, _) in zip(names, whole)}


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(12)]
    got = {x.node: x.comp for x in components(frame(spark, edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent}
    assert components(frame(spark, [], "a long, b long")).count() == 0


def test_numbering_in_blocks(spark):
    rng = random.Random(4)
    rows = [(k, p) for k in ("a", "b", None) for p in rng.sample([*range(-50, 300), None], 40)]
    got = r.numbered(frame(spark, rows, "k string, p int"), ["k"], "p", "n", block=16)
    want = {(k, p, i) for k in ("a", "b", None) for i, p in enumerate(sorted((p for x, p in rows if x == k), key=lambda v: (v is not None, v or 0)))}
    assert as_set(got.select("k", "p", "n")) == want
