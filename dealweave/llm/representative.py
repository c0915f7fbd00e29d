"""One surviving record per group of duplicates, put together from consistent bundles of fields.

Fields that depend on each other form a bundle and are taken from one record as a whole. Which bundle values go together
is found by branch and bound: bundles are decided one after the other, best trusted value first, and a branch is left as
soon as even the best trust of all undecided bundles could not beat the best selection found; functional dependencies
(this value of A demands that value of B) rule selections out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bundle:
    """Fields taken together: the output names and the columns that hold their usable values (null: not usable)."""

    fields: tuple[str, ...]
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Dependency:
    """Functional dependency between output fields: a value of ``source`` listed in ``demands`` needs that of ``target``."""

    source: str
    target: str
    demands: dict[str, str]


def choose(options: list[list[tuple[dict[str, str], float]]], dependencies: tuple[Dependency, ...] = ()) -> dict[str, str]:
    """The consistent selection of at most one value per bundle with the greatest total trust.

    ``options[i]`` are the values of bundle i with their positive trust (whole numbers compare exactly), best first. Ties keep the selection found first,
    which prefers the better trusted values of earlier bundles. A bundle may be left out if nothing consistent remains.
    """
    n = len(options)
    ahead = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (options[i][0][1] if options[i] else 0.0)
    best: tuple[float, dict[str, str]] = (-1.0, {})

    def consistent(chosen: dict[str, str]) -> bool:
        for d in dependencies:
            x, y = chosen.get(d.source), chosen.get(d.target)
            if x is not None and y is not None and x in d.demands and d.demands[x] != y:
                return False
        return True

    def branch(i: int, trust: float, chosen: dict[str, str]) -> None:
        nonlocal best
        if trust + ahead[i] <= best[0]:
            return
        if i == n:
            best = (trust, chosen)
            return
        for values, worth in options[i]:
            if trust + worth + ahead[i + 1] <= best[0]:
                break  # later values are trusted less
            if consistent(both := chosen | values):
                branch(i + 1, trust + worth, both)
        branch(i + 1, trust, chosen)

    branch(0, 0.0, {})
    return best[1]


def best_records(df: DataFrame, *, group: str, bundles: list[Bundle], trust: list[Column], dependencies: tuple[Dependency, ...] = (), min_records: int = 2) -> DataFrame:
    """``<group>`` and all bundle fields, one row for each group with at least ``min_records`` records.

    ``trust`` are the columns that order records, most trusted greatest, compared from left to right, nulls last. Within a
    bundle the trust of a value is that of its most trusted record; the selection maximises the sum over bundles of the
    value's rank (best = 1, evenly down to 0), which for independent bundles is the first usable value of each.

    Defined results: records with a null group belong to none and give no row; a bundle with a null or unusable part is
    no candidate; a group without any usable value has null fields; records equal in all of ``trust`` tie and the
    smallest value wins; repeated records count as records; an empty table gives an empty result; columns of ``df`` that
    are not named are ignored.

    Plan: two aggregations. The first reduces each (group, value) to its best trust before the shuffle, so a group with a
    third of all records arrives as its few distinct values; the second gathers those per group, bounded by the
    vocabulary of usable values. Branch and bound runs on the gathered arrays in Arrow batches.
    """
    order = F.struct(*(F.struct(t.isNotNull().alias("given"), t.alias("value")).alias(f"t{i}") for i, t in enumerate(trust)))
    rows = df.filter(F.col(group).isNotNull()).select(F.col(group).alias("__group"), order.alias("__trust"), *(F.array(*(F.col(c).cast("string") for c in b.columns)).alias(f"__b{i}") for i, b in enumerate(bundles)))
    none = F.lit(None).cast("array<string>")
    usable = [F.struct(F.lit(i).alias("b"), F.when(~F.exists(f"__b{i}", lambda x: x.isNull()), F.col(f"__b{i}")).alias("v")) for i in range(len(bundles))]
    candidates = rows.select("__group", "__trust", F.explode(F.array(F.struct(F.lit(-1).alias("b"), none.alias("v")), *usable)).alias("c")).select("__group", "__trust", "c.b", "c.v")
    # b = -1 counts the records of the group
    candidates = candidates.filter("b < 0 or v is not null").groupBy("__group", "b", "v").agg(F.max("__trust").alias("__trust"), F.count("*").alias("n"))
    best_first = lambda x, y: F.when(x["t"] > y["t"], -1).when(x["t"] < y["t"], 1).when(x["v"] < y["v"], -1).when(x["v"] > y["v"], 1).otherwise(0)
    gathered = candidates.groupBy("__group").agg(
        F.max(F.when(F.col("b") < 0, F.col("n"))).alias("__n"),
        *(F.transform(F.array_sort(F.collect_list(F.when(F.col("b") == i, F.struct(F.col("__trust").alias("t"), F.col("v").alias("v")))), best_first), lambda x: x["v"]).alias(f"o{i}") for i in range(len(bundles))),
    )
    fields = [f for b in bundles for f in b.fields]

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            out = []
            for group_options in zip(*columns):
                # ranks evenly down from 1 to 0, as whole numbers over one denominator, so that sums compare exactly
                whole = math.lcm(*(len(values) for values in group_options if len(values)))
                options = [[(dict(zip(b.fields, v)), whole - k * (whole // len(values))) for k, v in enumerate(values)] for b, values in zip(bundles, group_options)]
                out.append(choose(options, dependencies))
            yield pd.DataFrame({f: pd.Series([r.get(f) for r in out], dtype=object) for f in fields})

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    chosen = F.pandas_udf(run, ", ".join(f"`{f}` string" for f in fields))
    columns = [f"o{i}" for i in range(len(bundles))]
    if len(columns) == 1:  # a UDF over tuples of series needs two columns at least
        columns.append("o0")
    return gathered.filter(F.col("__n") >= min_records).select(F.col("__group").alias(group), chosen(*columns).alias("r")).select(group, *(F.col(f"r.{f}").alias(f) for f in fields))


def spelling_key(c: Column) -> Column:
    """A name without case, spaces and separators; null if nothing is left."""
    k = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    return F.when(k != "", k)
