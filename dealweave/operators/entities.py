"""Names compared by the words they share: similar pairs by prefix filtering, and greedy clusters in order."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LEGAL_FORMS, entity_key, word_overlap
from .graph import components


def similar_pairs(df: DataFrame, keys: list[str], name: str, threshold: float) -> DataFrame:
    """``<keys>, key_a, key_b``: names of one group whose word overlap is at least ``threshold``, key_a < key_b.

    Two such names must share one of the rarest words of each (prefix filter: the words of a name by rising frequency, of
    which the first ``n - ceil(threshold * n) + 1`` are listed), so only those words are joined on, and a word that many
    names have is joined on for none that has rarer ones enough. Nothing is lost and no group is compared pair by pair.
    """
    names = df.select(*keys, F.col(name).alias("k")).distinct().withColumn("w", F.array_distinct(F.split("k", " ")))
    counts = names.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = names.select(*keys, "k", F.size("w").alias("size"), F.explode("w").alias("word")).join(counts, "word")
    listed = words.groupBy(*keys, "k", "size").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("by"))
    listed = listed.select(*keys, "k", F.explode(F.slice("by", F.lit(1), F.col("size") - F.ceil(F.col("size") * threshold - 1e-9).cast("int") + 1)).alias("x")).select(*keys, "k", F.col("x.word").alias("word"))
    a, b = listed.withColumnRenamed("k", "key_a"), listed.withColumnRenamed("k", "key_b")
    met = a.join(b, [*keys, "word"]).filter("key_a < key_b").select(*keys, "key_a", "key_b").distinct()
    return met.filter(word_overlap(F.col("key_a"), F.col("key_b")) >= threshold)


def cluster_in_order(names: list[str], threshold: float) -> list[tuple[int, float]]:
    """For each name the number of its cluster and its likeness to the name that began it.

    A name joins the first cluster whose first name is like it, else it begins one. Candidates come from an index of words.
    """
    legal, index, sets, out = set(LEGAL_FORMS), {}, [], []
    for name in names:
        words = [w for w in re.sub(r"[^a-z0-9]+", " ", name.lower().replace("&", " and ")).split() if w not in legal]
        mine = frozenset(words)
        best = None
        for c in sorted({c for w in mine for c in index.get(w, ())}):
            like = len(mine & sets[c]) / max(len(mine), len(sets[c]))
            if like >= threshold:
                best = (c, like)
                break
        if best is None:
            best = (len(sets), 1.0)
            for w in mine:
                index.setdefault(w, []).append(len(sets))
            sets.append(mine)
        out.append(best)
    return out


def greedy_clusters(df: DataFrame, keys: list[str], name: str, order: str, threshold: float) -> DataFrame:
    """``<keys>, name, cluster, similarity`` of distinct names, clustered greedily per group in ``order``; a cluster is
    called by its first name.

    Whom a name joins depends on the clusters before it, but only on those it is like: names that no chain of likeness
    connects never meet. So similar pairs are found first, their components are walked in order one by one, and a group
    with a third of all names is as many tasks as it has components.
    """
    named = df.select(*keys, F.col(name).alias("name"), F.col(order).alias("ord"), entity_key(F.col(name)).alias("k"))
    named = named.withColumn("node", F.xxhash64(*keys, "k"))
    pairs = similar_pairs(named.filter("k != ''"), keys, "k", threshold)
    found = components(pairs.select(F.xxhash64(*keys, "key_a").alias("a"), F.xxhash64(*keys, "key_b").alias("b")))
    named = named.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node")).drop("node", "k")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "name string", "cluster string", "similarity double"])

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ord", "name"])
        names = group["name"].tolist()
        places = cluster_in_order(names, threshold)
        first: dict[int, str] = {}
        for n, (c, _) in zip(names, places):
            first.setdefault(c, n)
        out = group[keys].reset_index(drop=True)
        out["name"], out["cluster"], out["similarity"] = names, [first[c] for c, _ in places], [s for _, s in places]
        return out

    return named.groupBy(*keys, "comp").applyInPandas(walk, schema)
