import itertools
import random

from pyspark.sql import functions as F

from dealweave.llm.representative import Bundle, Dependency, best_records, choose, spelling_key

SCHEMA = "g long, id long, a string, b string, c string, reviewed boolean, conf double, __n int"


def test_branch_and_bound_equals_trying_all():
    rng = random.Random(4)
    for _ in range(200):
        options = [sorted(([({f"f{i}": str(v)}, rng.random()) for v in range(rng.randint(0, 4))]), key=lambda x: -x[1]) for i in range(3)]
        rule = (Dependency("f0", "f1", {"0": "1", "1": "0"}), Dependency("f1", "f2", {"2": "2"}))

        def ok(s):
            return all(not (s.get(d.source) in d.demands and s.get(d.target) is not None and d.demands[s[d.source]] != s[d.target]) for d in rule)

        best = max(sum(w for _, w in pick) for pick in itertools.product(*([*o, ({}, 0.0)] for o in options)) if ok({k: v for p, _ in pick for k, v in p.items()}))
        got = choose(options, rule)
        worth = {tuple(v.items())[0]: w for o in options for v, w in o}
        assert ok(got) and abs(sum(worth[kv] for kv in got.items()) - best) < 1e-12


def run(spark, rows, bundles, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r) for r in best_records(df, group="g", bundles=bundles, trust=[F.coalesce("reviewed", F.lit(False)), F.col("conf"), -F.col("id")], **more).collect()}


EACH = [Bundle(("a",), ("a",)), Bundle(("b",), ("b",))]


def test_each_field_from_its_best_record(spark):
    rows = [
        (1, 1, "x", None, None, False, 0.9, 0), (1, 2, "y", "q", None, True, 0.1, 0), (1, 3, None, "r", None, None, None, 0), (2, 4, "x", "q", None, True, 0.5, 0), (3, 5, None, None, None, True, 0.5, 0), (3, 6, None, None, None, True, 0.5, 0),
        (None, 7, "z", "z", None, True, 1.0, 0), (None, 8, "z", "z", None, True, 1.0, 0), (4, 9, "m", "n", None, None, 0.3, 0), (4, 10, "k", "o", None, None, 0.3, 0), (5, 11, "u", None, None, None, None, 0), (5, 11, "u", None, None, None, None, 0),
    ]
    assert run(spark, rows, EACH) == {(1, "y", "q"), (3, None, None), (4, "m", "n"), (5, "u", None)}
    assert run(spark, [], EACH) == set()


def test_bundles_are_whole_and_dependencies_hold(spark):
    rows = [(1, 1, "x", None, "p", True, 0.9, 0), (1, 2, "y", "q", "s", False, 0.5, 0), (1, 3, "z", "r", "t", False, 0.4, 0)]
    pair = [Bundle(("a", "b"), ("a", "b")), Bundle(("c",), ("c",))]
    assert run(spark, rows, pair) == {(1, "y", "q", "p")}
    assert run(spark, rows, pair, dependencies=(Dependency("c", "a", {"p": "nobody", "s": "y"}),)) == {(1, "y", "q", "s")}


def test_hot_group_with_long_texts(spark):
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("g"), F.col("id"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("v"), 5000)).otherwise("w").alias("a"))
    got = best_records(df, group="g", bundles=[Bundle(("a",), ("a",))], trust=[F.col("id")]).collect()
    assert [(r.g, r.a) for r in got] == [(1, "w")]


def test_spelling_key(spark):
    got = spark.createDataFrame([("Quality.of Earnings_Report",), (" - ",), (None,), ("#REF!",)], "s string").select(spelling_key(F.col("s")).alias("k")).collect()
    assert [r.k for r in got] == ["qualityofearningsreport", None, None, "ref"]
