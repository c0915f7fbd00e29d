"""Relational operators over groups of rows: latest and best rows, merges, anti joins, pairs, folds, series statistics.

All take DataFrames and column names and return DataFrames; order is always an explicit column. Rankings that only keep
the first rows use ``row_number`` with a filter, which Spark turns into a group limit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group in ``order``, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def numbered(df: DataFrame, keys: list[str], place: str, name: str, block: int = 65_536) -> DataFrame:
    """Adds ``name``: the rank of a row in its group by the whole number ``place``, from 0, nulls first.

    Rows are ranked within blocks of ``block`` places and moved up by the rows of the blocks before, so a group with a
    third of all rows is ranked by many tasks; only a count per block is ranked as a whole.
    """
    # null keys and the block before all others (null places) are told by themselves
    rows = df.withColumn("__blk", F.floor(F.col(place) / block).cast("bigint"))
    counts = rows.groupBy(*keys, "__blk").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("__blk")).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__blk").alias("__b"), F.coalesce(before, F.lit(0)).alias("__start"))
    same = rows["__blk"].eqNullSafe(starts["__b"])
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(starts[f"__k{i}"])
    rank = F.row_number().over(Window.partitionBy(*keys, "__blk").orderBy(F.asc_nulls_first(place)))
    return rows.join(starts, same).withColumn(name, (F.col("__start") + rank - 1).cast("int")).select(*df.columns, name)


def best_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per group: the one with the greatest ``order``, as a partial aggregation rather than a window."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("__r"))
    return picked.select(*keys, "__r.*")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], seq: str, deleted: str | None = None) -> DataFrame:
    """Both sides merged by key: the greatest ``seq`` wins, changes before the base; keys marked ``deleted`` go."""
    both = base.withColumn("__side", F.lit(0)).unionByName(changes.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    out = best_by(both, keys, [F.col("__side"), F.col(seq)]).drop("__side")
    return out.filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else out


def latest_state(events: DataFrame, keys: list[str], seq: list[str], action: str, tombstone: str) -> DataFrame:
    """The last event of every key, without keys whose last event is a ``tombstone``."""
    return best_by(events, keys, [F.col(c) for c in seq]).filter(F.coalesce(F.col(action), F.lit("")) != tombstone)


def wildcard_anti(df: DataFrame, rules: DataFrame, keys: list[str], wild: str) -> DataFrame:
    """Rows that no rule hits; a rule with an empty ``wild`` holds for every value of that column.

    The OR of the two cases is two equi anti joins, so neither needs a nested loop.
    """
    every, exact = rules.filter(F.coalesce(F.col(wild), F.lit("")) == ""), rules.filter(F.coalesce(F.col(wild), F.lit("")) != "")
    return df.join(every.select(*keys).distinct(), keys, "left_anti").join(exact.select(*keys, wild).distinct(), [*keys, wild], "left_anti")


def pairs_within(df: DataFrame, keys: list[str], order: str, columns: list[str], max_gap: int) -> DataFrame:
    """Pairs of rows of one group at most ``max_gap`` places apart, earlier first, as ``<column>_a``, ``<column>_b``.

    A group of any size gives a bounded number of pairs per row: places are cut into bands and only neighbouring bands
    are joined on equality.
    """
    band = F.floor(F.col(order) / max_gap)
    a = df.select(*keys, F.col(order).alias("__oa"), band.alias("__band"), *(F.col(c).alias(f"{c}_a") for c in columns))
    b = df.select(*keys, F.col(order).alias("__ob"), F.explode(F.array(band, band - 1)).alias("__band"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return a.join(b, [*keys, "__band"]).filter((F.col("__oa") < F.col("__ob")) & (F.col("__ob") - F.col("__oa") <= max_gap)).drop("__oa", "__ob", "__band")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """Left rows with the columns of the last right row at or before them.

    Both sides are laid in one sorted stream per key and the last value is carried forward, so there is no range join.
    """
    tag = lambda df, t, side: df.withColumn("__t", F.col(t)).withColumn("__side", F.lit(side))
    l = tag(left.withColumn("__v", F.lit(None).cast(right.select(F.struct(*columns).alias("v")).schema["v"].dataType)), left_time, 1)  # noqa: E741
    r = tag(right.select(*keys, F.col(right_time), F.struct(*columns).alias("__v")), right_time, 0)
    both = l.unionByName(r.select(*keys, "__v", "__t", "__side"), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).filter("__side = 1")
    return carried.select(*left.columns, *(F.col(f"__v.{c}").alias(c) for c in columns))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], value: str, lo: str, hi: str, width: float) -> DataFrame:
    """Left rows with every right row of their key whose [lo, hi) holds ``value``.

    Intervals are listed in each band of ``width`` they touch and joined to the value's band on equality.
    """
    bands = F.sequence(F.floor(F.col(lo) / width).cast("bigint"), F.floor(F.col(hi) / width).cast("bigint"))
    r = right.withColumn("__band", F.explode(bands))
    l = left.withColumn("__band", F.floor(F.col(value) / width).cast("bigint"))  # noqa: E741
    return l.join(r, [*keys, "__band"]).filter((F.col(value) >= F.col(lo)) & (F.col(value) < F.col(hi))).drop("__band")


def penalty_fold(df: DataFrame, keys: list[str], order: str, amount: str, cap: float = 0.45, digits: int = 2) -> DataFrame:
    """``<keys>, penalty``: amounts added in order, rounded half up and capped after every one."""
    scale = 10.0**digits
    step = lambda p, x: F.floor(F.least(F.lit(cap), p + x["a"]) * scale + 0.5) / scale
    seq = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(amount).cast("double").alias("a"))))
    return df.groupBy(*keys).agg(F.aggregate(seq, F.lit(0.0), step).alias("penalty"))


def series_stats(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``<keys>, n, first_value, last_value, prev_value, cagr, yoy_mean, yoy_stddev, trend`` of short ordered series.

    Nulls are left out; ``prev_value`` is the last but one of what is left; ``trend`` is +1 for only rises, -1 for only
    falls; yearly changes are in percent with population deviation.
    """
    v = F.transform(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))))), lambda x: x["v"])
    s = df.groupBy(*keys).agg(v.alias("v")).withColumn("n", F.size("v"))
    steps = F.when(F.col("n") > 1, F.sequence(F.lit(1), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    s = s.withColumn("rates", F.filter(F.transform(steps, lambda i: F.when(F.get("v", i - 1) != 0, (F.get("v", i) - F.get("v", i - 1)) / F.abs(F.get("v", i - 1)) * 100)), lambda x: x.isNotNull()))
    s = s.withColumn("ups", F.size(F.filter(steps, lambda i: F.get("v", i) > F.get("v", i - 1)))).withColumn("m", F.size("rates"))
    total = lambda c, f: F.aggregate(c, F.lit(0.0), f)
    s = s.withColumn("yoy_mean", F.when(F.col("m") > 0, total("rates", lambda a, x: a + x) / F.col("m")))
    s = s.withColumn("yoy_stddev", F.when(F.col("m") > 0, F.sqrt(total("rates", lambda a, x: a + (x - F.col("yoy_mean")) * (x - F.col("yoy_mean"))) / F.col("m"))))
    first, last = F.get("v", F.lit(0)), F.get("v", F.col("n") - 1)
    cagr = F.when((F.col("n") > 1) & (first > 0) & (last > 0), (F.pow(last / first, F.lit(1.0) / (F.col("n") - 1)) - 1) * 100)
    prev = F.when(F.col("n") > 1, F.get("v", F.col("n") - 2))
    trend = F.when(F.col("n") > 1, F.lit(2.0) * F.col("ups") / (F.col("n") - 1) - 1)
    return s.select(*keys, "n", first.alias("first_value"), last.alias("last_value"), prev.alias("prev_value"), cagr.alias("cagr"), "yoy_mean", "yoy_stddev", trend.alias("trend"))


def top_shares(df: DataFrame, keys: list[str], amount: str, ks: tuple[int, ...]) -> DataFrame:
    """``<keys>, n, total, top<k>`` with the sum of the ``k`` greatest amounts of every group."""
    w = Window.partitionBy(*keys).orderBy(F.desc(amount))
    top = df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= max(ks)).groupBy(*keys).agg(*(F.sum(F.when(F.col("__r") <= k, F.col(amount))).alias(f"top{k}") for k in ks))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(amount).alias("total")).join(top, keys)


def greatest_mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``<keys>, mode, mode_count``: the most frequent value, the greater one on a tie, from two partial aggregations."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(F.max(F.struct("__n", value)).alias("m")).select(*keys, F.col(f"m.{value}").alias("mode"), F.col("m.__n").alias("mode_count"))


def weighted_average(df: DataFrame, keys: list[str], weight: str, value: str) -> DataFrame:
    """``<keys>, total, weighted``: the sum of weights, and weighted values over that whole sum, unknown values included."""
    return df.groupBy(*keys).agg(F.sum(weight).alias("total"), F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(weight)).alias("weighted"))
