"""Connected components of an edge table, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every greater neighbour of a node to the least node around it."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return near.filter("v > u").hint("merge").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its lesser neighbours to the least of them; edges go from the greater node to the lesser."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    low = edges.hint("merge").join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return low.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, comp``: the connected components of ``a, b``, named by their smallest node.

    Large-star and small-star alternate until no edge changes, which takes rounds in the logarithm of the number of nodes,
    whatever the length of chains; each round is checkpointed in the shared folder. Minima are combined before the shuffle,
    so a node with very many neighbours is no hot key of an aggregate, and the adaptive join splits it. Only the number of
    edges and a checksum come to the driver. Loops and repeated edges do no harm; an empty table has no components.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u is not null and v is not null").distinct())
    nodes = now.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now, before = now.filter("u != v"), None
    while True:
        r = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (r["n"], r["h"]) == before or not r["n"]:
            break
        before = (r["n"], r["h"])
        now = checkpointed(_small_star(_large_star(now)))
    return nodes.hint("merge").join(now.groupBy("u").agg(F.min("v").alias("v")).toDF("node", "comp"), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
