"""Made-up sheets for demonstrations and load tests; off unless called."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synthetic_statements(spark: SparkSession, n_deals: int, seed: int = 42, years: tuple[int, ...] = (2022, 2023, 2024)) -> DataFrame:
    """``deal, period, revenue, cogs, ebitda`` of ``n_deals`` deals: the same seed gives the same rows on one layout."""
    base = spark.range(n_deals).withColumnRenamed("id", "deal").withColumn("size", F.exp(F.rand(seed) * 4 + 13))
    rows = base.withColumn("period", F.explode(F.array(*(F.lit(y) for y in years)))).withColumn("growth", F.pow(1 + F.rand(seed + 1) * 0.2, F.col("period") - min(years)))
    revenue = F.round(F.col("size") * F.col("growth"), 2)
    return rows.select("deal", "period", revenue.alias("revenue"), F.round(revenue * (0.5 + F.rand(seed + 2) * 0.2), 2).alias("cogs"), F.round(revenue * (0.05 + F.rand(seed + 3) * 0.2), 2).alias("ebitda"))
