"""Queries over warehouse tables read as deals: series, shares, comparisons, agings, merges, rollups.

A deal is a nation; its periods are order years; revenue is discounted line value. Sums run over whole cents or ten
thousandths, so that results do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import growth_rate, half_up, ratio, relative_difference, scale_signal, to_millions
from ..operators.relational import as_of_join, best_by, penalty_fold, range_join, series_stats, top_k, top_shares, weighted_average
from ..session import table


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def percents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


#: DuckDB text of the fact views below; queries put it before their own SQL.
FACTS_SQL = """
WITH ord AS (
    SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority, c_nationkey AS deal, year(o_orderdate) AS period,
           CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents
    FROM orders JOIN customer ON o_custkey = c_custkey
), fact AS (
    SELECT deal, period, o_custkey, o_orderdate, l_suppkey,
           CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS revenue_e4,
           CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) * CAST(round(l_tax * 100) AS BIGINT) AS tax_e6,
           CAST(l_quantity AS BIGINT) * CAST(round(p_retailprice * 100) AS BIGINT) AS cogs_cents, CAST(l_quantity AS BIGINT) AS units
    FROM lineitem JOIN ord ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
), income AS (
    SELECT deal, period, CAST(sum(revenue_e4) AS BIGINT) AS revenue_e4, CAST(sum(cogs_cents) AS BIGINT) AS cogs_cents, CAST(sum(tax_e6) AS BIGINT) AS tax_e6
    FROM fact GROUP BY 1, 2
), receipts AS (
    SELECT deal, period, CAST(sum(total_cents) AS BIGINT) AS receipts_cents FROM ord GROUP BY 1, 2
)
"""


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their deal and period."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", F.col("c_nationkey").alias("deal"), F.year("o_orderdate").cast("bigint").alias("period"), cents("o_totalprice").alias("total_cents"))


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with deal, period, revenue, tax and cost."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", cents("l_extendedprice").alias("price"), percents("l_discount").alias("disc"), percents("l_tax").alias("tax"), F.col("l_quantity").cast("bigint").alias("units"))
    part = table(spark, sf_dir, "part").select("p_partkey", cents("p_retailprice").alias("retail"))
    orders = order_facts(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderdate", "deal", "period")
    f = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    e4 = F.col("price") * (100 - F.col("disc"))
    return f.select("deal", "period", "o_custkey", "o_orderdate", "l_suppkey", e4.alias("revenue_e4"), (e4 * F.col("tax")).alias("tax_e6"), (F.col("units") * F.col("retail")).alias("cogs_cents"), "units")


def income(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Income by deal and period."""
    return line_facts(spark, sf_dir).groupBy("deal", "period").agg(F.sum("revenue_e4").alias("revenue_e4"), F.sum("cogs_cents").alias("cogs_cents"), F.sum("tax_e6").alias("tax_e6"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals by deal and period: an independent measure of revenue."""
    return order_facts(spark, sf_dir).groupBy("deal", "period").agg(F.sum("total_cents").alias("receipts_cents"))


Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, facts: bool = True):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (FACTS_SQL if facts else "") + sql
        return f

    return add


@query("""
SELECT deal, period, CAST(revenue_e4 AS DOUBLE) / 10000 AS revenue, CAST(cogs_cents AS DOUBLE) / 100 AS cogs,
       CAST(revenue_e4 AS DOUBLE) / 10000 - CAST(cogs_cents AS DOUBLE) / 100 AS gross_profit,
       floor(((CAST(revenue_e4 AS DOUBLE) / 10000 - CAST(cogs_cents AS DOUBLE) / 100) / (CAST(revenue_e4 AS DOUBLE) / 10000) * 100) * 100 + 0.5) / 100 AS gross_margin,
       floor(CAST(revenue_e4 AS DOUBLE) / 10000 / 100000.0 + 0.5) / 10 AS revenue_m
FROM income""")
def income_series(spark, d):
    """Revenue, cost, profit, margin and revenue in millions by deal and period."""
    revenue, cogs = F.col("revenue_e4").cast("double") / 10000, F.col("cogs_cents").cast("double") / 100
    return income(spark, d).select("deal", "period", revenue.alias("revenue"), cogs.alias("cogs"), (revenue - cogs).alias("gross_profit"), half_up((revenue - cogs) / revenue * 100).alias("gross_margin"), to_millions(revenue).alias("revenue_m"))


_STATS_SQL = """
, s AS (SELECT deal, period, CAST({value} AS DOUBLE) AS v FROM {table}), a AS (
    SELECT deal, count(v) AS n, list(v ORDER BY period) FILTER (WHERE v IS NOT NULL) AS vs FROM s GROUP BY deal
), r AS (
    SELECT deal, n, vs, list_transform(range(2, n + 1), lambda i: (vs[i] - vs[i-1]) / abs(vs[i-1]) * 100) AS rates,
           len(list_filter(range(2, n + 1), lambda i: vs[i] > vs[i-1])) AS ups FROM a
)
SELECT deal, CAST(n AS INTEGER) AS n, vs[1] AS first_value, vs[n] AS last_value, CASE WHEN n > 1 THEN vs[n-1] END AS prev_value,
       CASE WHEN n > 1 THEN floor(((pow(vs[n] / vs[1], 1.0 / (n - 1)) - 1) * 100) * 1000000 + 0.5) / 1000000 END AS cagr,
       CASE WHEN n > 1 THEN floor(list_avg(rates) * 1000000 + 0.5) / 1000000 END AS yoy_mean,
       CASE WHEN n > 1 THEN floor(list_stddev_pop(rates) * 1000000 + 0.5) / 1000000 END AS yoy_stddev,
       CASE WHEN n > 1 THEN 2.0 * ups / (n - 1) - 1 END AS trend
FROM r"""


@query(_STATS_SQL.format(value="revenue_e4", table="income"))
def revenue_statistics(spark, d):
    """Growth, volatility and trend of each deal's revenue."""
    s = series_stats(income(spark, d).withColumn("v", F.col("revenue_e4").cast("double")), ["deal"], "period", "v")
    return s.select("deal", "n", "first_value", "last_value", "prev_value", *(half_up(F.col(c), 6).alias(c) for c in ("cagr", "yoy_mean", "yoy_stddev")), "trend")


@query("""
, g AS (SELECT deal, period, CAST(receipts_cents AS DOUBLE) AS v, lag(CAST(receipts_cents AS DOUBLE)) OVER (PARTITION BY deal ORDER BY period) AS p FROM receipts)
SELECT deal, period, v AS receipts, p AS prior, CASE WHEN p > 0 THEN floor((v / p - 1) * 10000 + 0.5) / 100 END AS yoy_pct FROM g""")
def receipts_yoy(spark, d):
    """Yearly change of order totals by deal."""
    prior = F.lag("receipts").over(Window.partitionBy("deal").orderBy("period"))
    g = receipts(spark, d).select("deal", "period", F.col("receipts_cents").cast("double").alias("receipts")).withColumn("prior", prior)
    return g.withColumn("yoy_pct", F.when(F.col("prior") > 0, half_up((F.col("receipts") / F.col("prior") - 1) * 100)))


@query("""
, j AS (SELECT i.deal, i.period, CAST(i.revenue_e4 AS DOUBLE) / 10000 AS a, CAST(r.receipts_cents AS DOUBLE) / 100 AS b FROM income i LEFT JOIN receipts r USING (deal, period))
SELECT deal, period, coalesce(b, a) AS best_revenue, floor(abs(a - b) / greatest(abs(a), abs(b), 1.0) * 10000 + 0.5) / 10000 AS variance,
       CASE WHEN greatest(abs(a), abs(b)) / greatest(least(abs(a), abs(b)), 1.0) BETWEEN 900 AND 1100 THEN '1,000x'
            WHEN greatest(abs(a), abs(b)) / greatest(least(abs(a), abs(b)), 1.0) BETWEEN 900000 AND 1100000 THEN '1,000,000x' END AS scale_hint
FROM j""")
def reconcile_periods(spark, d):
    """Both measures of revenue joined on the period: the preferred value, their difference, a hint at another scale."""
    j = income(spark, d).join(receipts(spark, d), ["deal", "period"], "left").select("deal", "period", (F.col("revenue_e4").cast("double") / 10000).alias("a"), (F.col("receipts_cents").cast("double") / 100).alias("b"))
    return j.select("deal", "period", F.coalesce("b", "a").alias("best_revenue"), half_up(relative_difference(F.col("a"), F.col("b")), 4).alias("variance"), scale_signal(F.col("a"), F.col("b")).alias("scale_hint"))


@query("""
, li AS (SELECT deal, arg_max(revenue_e4, period) AS e4, max(period) AS p FROM income GROUP BY 1),
  lr AS (SELECT deal, arg_max(receipts_cents, period) AS c, max(period) AS p FROM receipts GROUP BY 1)
SELECT deal, li.p AS income_period, lr.p AS receipts_period, abs(li.p - lr.p) > 1 AS stale,
       floor(abs(CAST(e4 AS DOUBLE) / 100 - CAST(c AS DOUBLE)) / greatest(CAST(e4 AS DOUBLE) / 100, CAST(c AS DOUBLE), 1.0) * 10000 + 0.5) / 10000 AS variance
FROM li JOIN lr USING (deal)""")
def reconcile_latest(spark, d):
    """The latest period of each side compared, whichever period that is."""
    li = income(spark, d).groupBy("deal").agg(F.max_by("revenue_e4", "period").alias("e4"), F.max("period").alias("income_period"))
    lr = receipts(spark, d).groupBy("deal").agg(F.max_by("receipts_cents", "period").alias("c"), F.max("period").alias("receipts_period"))
    a, b = F.col("e4").cast("double") / 100, F.col("c").cast("double")
    return li.join(lr, "deal").select("deal", "income_period", "receipts_period", (F.abs(F.col("income_period") - F.col("receipts_period")) > 1).alias("stale"), half_up(relative_difference(a, b), 4).alias("variance"))


@query("""
, c AS (SELECT deal, o_custkey, CAST(sum(revenue_e4) AS BIGINT) AS r FROM fact GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY deal ORDER BY r DESC) AS n FROM c)
SELECT deal, count(*) AS n, CAST(sum(r) AS BIGINT) AS total, CAST(sum(r) FILTER (WHERE n <= 1) AS BIGINT) AS top1, CAST(sum(r) FILTER (WHERE n <= 3) AS BIGINT) AS top3,
       CAST(sum(r) FILTER (WHERE n <= 5) AS BIGINT) AS top5, floor(CAST(sum(r) FILTER (WHERE n <= 5) AS DOUBLE) / CAST(sum(r) AS DOUBLE) * 10000 + 0.5) / 100 AS top5_pct
FROM k GROUP BY deal""")
def customer_concentration(spark, d):
    """Revenue of the largest one, three and five customers of each deal."""
    c = line_facts(spark, d).groupBy("deal", "o_custkey").agg(F.sum("revenue_e4").alias("r"))
    return top_shares(c, ["deal"], "r", (1, 3, 5)).withColumn("top5_pct", half_up(F.col("top5").cast("double") / F.col("total").cast("double") * 100))


@query("""
, c AS (SELECT deal, o_custkey, CAST(sum(revenue_e4) AS BIGINT) AS r FROM fact GROUP BY 1, 2)
SELECT deal, o_custkey, r, floor(CAST(r AS DOUBLE) / CAST(sum(r) OVER (PARTITION BY deal) AS DOUBLE) * 10000 + 0.5) / 100 AS share_pct FROM c""")
def customer_shares(spark, d):
    """Each customer's share of its deal; totals are aggregated and joined back, so no deal is one window."""
    c = line_facts(spark, d).groupBy("deal", "o_custkey").agg(F.sum("revenue_e4").alias("r"))
    total = c.groupBy("deal").agg(F.sum("r").alias("t"))
    return c.join(total, "deal").select("deal", "o_custkey", "r", half_up(F.col("r").cast("double") / F.col("t").cast("double") * 100).alias("share_pct"))


@query("""
, c AS (SELECT deal, o_custkey, CAST(sum(revenue_e4) AS BIGINT) AS r FROM fact GROUP BY 1, 2)
SELECT deal, o_custkey, r, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY deal ORDER BY r DESC, o_custkey) AS rank FROM c) WHERE rank <= 8""")
def top_customers(spark, d):
    """The eight largest customers of each deal."""
    c = line_facts(spark, d).groupBy("deal", "o_custkey").agg(F.sum("revenue_e4").alias("r"))
    return top_k(c, ["deal"], [F.desc("r"), F.asc("o_custkey")], 8)


_AGING = "CASE WHEN age <= 0 THEN 'current' WHEN age <= 30 THEN 'days_1_30' WHEN age <= 60 THEN 'days_31_60' WHEN age <= 90 THEN 'days_61_90' ELSE 'days_90_plus' END"


@query(f"""
, last AS (SELECT max(CAST(o_orderdate AS DATE)) AS d FROM ord), a AS (
    SELECT deal, total_cents, date_diff('day', CAST(o_orderdate AS DATE), d) - 1500 AS age FROM ord, last WHERE o_orderstatus IN ('O', 'P'))
SELECT deal, CAST(coalesce(sum(total_cents) FILTER (WHERE b = 'current'), 0) AS BIGINT) AS current, CAST(coalesce(sum(total_cents) FILTER (WHERE b = 'days_1_30'), 0) AS BIGINT) AS days_1_30,
       CAST(coalesce(sum(total_cents) FILTER (WHERE b = 'days_31_60'), 0) AS BIGINT) AS days_31_60, CAST(coalesce(sum(total_cents) FILTER (WHERE b = 'days_61_90'), 0) AS BIGINT) AS days_61_90,
       CAST(coalesce(sum(total_cents) FILTER (WHERE b = 'days_90_plus'), 0) AS BIGINT) AS days_90_plus, CAST(sum(total_cents) AS BIGINT) AS total_ar
FROM (SELECT deal, total_cents, {_AGING} AS b FROM a) GROUP BY deal""")
def aging_buckets(spark, d):
    """Open orders of each deal by age, terms of 1,500 days from the last order day."""
    o = order_facts(spark, d)
    last = o.agg(F.max(F.to_date("o_orderdate"))).first()[0]
    age = F.datediff(F.lit(last), F.to_date("o_orderdate")) - 1500
    b = F.when(age <= 0, "current").when(age <= 30, "days_1_30").when(age <= 60, "days_31_60").when(age <= 90, "days_61_90").otherwise("days_90_plus")
    names = ["current", "days_1_30", "days_31_60", "days_61_90", "days_90_plus"]
    a = o.filter(F.col("o_orderstatus").isin("O", "P")).select("deal", "total_cents", b.alias("b"))
    return a.groupBy("deal").agg(*(F.coalesce(F.sum(F.when(F.col("b") == n, F.col("total_cents"))), F.lit(0)).cast("bigint").alias(n) for n in names), F.sum("total_cents").alias("total_ar"))


@query("""
SELECT s_nationkey AS deal, CAST(sum(p) AS BIGINT) AS total, CASE WHEN sum(p) <> 0 THEN CAST(sum(p * rate) AS DOUBLE) / CAST(sum(p) AS DOUBLE) END AS weighted
FROM (SELECT s_nationkey, CAST(round(greatest(s_acctbal, 0) * 100) AS BIGINT) AS p, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 50 END AS rate FROM supplier) GROUP BY 1""", facts=False)
def weighted_debt_rate(spark, d):
    """Principal-weighted rate; unrated principal counts in the denominator."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("deal"), F.round(F.greatest("s_acctbal", F.lit(0.0)) * 100).cast("bigint").alias("p"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey") % 50).alias("rate"))
    return weighted_average(s, ["deal"], "p", "rate")


@query("""
, g AS (SELECT deal, o_custkey, min(o_orderdate) AS first_order FROM ord GROUP BY 1, 2), w AS (SELECT *, min(first_order) OVER (PARTITION BY deal) AS lo, max(first_order) OVER (PARTITION BY deal) AS hi FROM g)
SELECT deal, o_custkey, floor((CASE WHEN hi > lo THEN CAST(date_diff('day', CAST(lo AS DATE), CAST(first_order AS DATE)) AS DOUBLE) / date_diff('day', CAST(lo AS DATE), CAST(hi AS DATE)) ELSE 0 END * 100) * 100 + 0.5) / 100 AS position FROM w""")
def timeline_position(spark, d):
    """Where each customer's first order stands between the deal's first and last one, 0 to 100."""
    g = order_facts(spark, d).groupBy("deal", "o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("f"))
    ends = g.groupBy("deal").agg(F.min("f").alias("lo"), F.max("f").alias("hi"))
    p = F.when(F.col("hi") > F.col("lo"), F.datediff("f", "lo").cast("double") / F.datediff("hi", "lo")).otherwise(0.0) * 100
    return g.join(ends, "deal").select("deal", "o_custkey", half_up(p).alias("position"))


@query("""
, y AS (SELECT CAST(2024 - period AS BIGINT) AS seq, deal, CASE WHEN gap > 0.08 THEN 0.12 WHEN gap > 0.03 THEN 0.05 ELSE 0.015 END AS amount FROM (
    SELECT i.deal, i.period, abs(CAST(revenue_e4 AS DOUBLE) / 100 - receipts_cents) / greatest(CAST(revenue_e4 AS DOUBLE) / 100, receipts_cents, 1.0) AS gap FROM income i JOIN receipts r USING (deal, period))),
  l AS (SELECT deal, list(amount ORDER BY seq) AS xs FROM y GROUP BY deal)
SELECT deal, list_reduce(list_prepend(CAST(0.0 AS DOUBLE), xs), lambda p, x: floor(least(CAST(0.45 AS DOUBLE), p + x) * 100 + 0.5) / 100) AS penalty FROM l""")
def penalty_by_deal(spark, d):
    """An ordered fold: rounded and capped after every finding, so it is no sum."""
    j = income(spark, d).join(receipts(spark, d), ["deal", "period"])
    gap = relative_difference(F.col("revenue_e4").cast("double") / 100, F.col("receipts_cents").cast("double"))
    f = j.select("deal", (2024 - F.col("period")).alias("seq"), F.when(gap > 0.08, 0.12).when(gap > 0.03, 0.05).otherwise(0.015).alias("amount"))
    return penalty_fold(f, ["deal"], "seq", "amount")


@query("""
SELECT coalesce(n_regionkey, -1) AS region, coalesce(deal, -1) AS deal, coalesce(period, -1) AS period, CAST(sum(receipts_cents) AS BIGINT) AS receipts, CAST(grouping(n_regionkey) * 4 + grouping(deal) * 2 + grouping(period) AS BIGINT) AS level
FROM receipts JOIN nation ON deal = n_nationkey GROUP BY CUBE (n_regionkey, deal, period)""")
def deal_cube(spark, d):
    """All subtotals over region, deal and period."""
    r = receipts(spark, d).join(table(spark, d, "nation").select(F.col("n_nationkey").alias("deal"), F.col("n_regionkey").alias("region")), "deal")
    cube = r.cube("region", "deal", "period").agg(F.sum("receipts_cents").alias("receipts"), F.grouping_id().alias("level"))
    return cube.select(*(F.coalesce(c, F.lit(-1)).alias(c) for c in ("region", "deal", "period")), "receipts", "level")


@query("""
SELECT r_name AS region, n_name AS nation, CAST(sum(receipts_cents) AS BIGINT) AS receipts FROM receipts JOIN nation ON deal = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ROLLUP (r_name, n_name)""")
def deal_rollup(spark, d):
    """Totals by region and nation with subtotals."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return receipts(spark, d).join(n, F.col("deal") == F.col("n_nationkey")).rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.sum("receipts_cents").alias("receipts"))


@query("""
SELECT o_orderstatus, o_orderpriority, coalesce(period, -1) AS period, count(*) AS n FROM ord GROUP BY GROUPING SETS ((o_orderstatus, period), (o_orderpriority), ())""")
def order_grouping_sets(spark, d):
    """Order counts by status and period, by priority, and over all."""
    o = order_facts(spark, d)
    sets = [[F.col("o_orderstatus"), F.col("period")], [F.col("o_orderpriority")], []]
    return o.groupingSets(sets, "o_orderstatus", "o_orderpriority", "period").agg(F.count("*").alias("n")).withColumn("period", F.coalesce("period", F.lit(-1)))


@query("""
SELECT deal, o_custkey, o_orderkey, total_cents, gap_days FROM (
    SELECT deal, o_custkey, o_orderkey, total_cents, date_diff('day', CAST(lag(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE)) AS gap_days FROM ord WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE gap_days > 365""")
def order_gaps(spark, d):
    """Orders more than a year after the customer's one before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = order_facts(spark, d).withColumn("gap_days", F.datediff(F.to_date("o_orderdate"), F.to_date(F.lag("o_orderdate").over(w))).cast("bigint"))
    return o.filter("gap_days > 365").select("deal", "o_custkey", "o_orderkey", "total_cents", "gap_days")


@query("""
SELECT o_custkey, period, o_orderkey, total_cents FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, period ORDER BY total_cents DESC, o_orderkey) AS n FROM ord) WHERE n = 1""")
def best_order_per_period(spark, d):
    """The largest order of each customer and year, the first of equal ones, by partial aggregation."""
    o = order_facts(spark, d).select("o_custkey", "period", "o_orderkey", "total_cents")
    return best_by(o, ["o_custkey", "period"], [F.col("total_cents"), -F.col("o_orderkey")]).select("o_custkey", "period", "o_orderkey", "total_cents")


@query("""
, late AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'error'), buy AS (SELECT user_id, ts AS t, event_id AS e, value AS v FROM events WHERE event_type = 'purchase')
SELECT event_id, user_id, coalesce(e, -1) AS last_purchase, v AS last_value FROM (
    SELECT late.*, e, v, row_number() OVER (PARTITION BY event_id ORDER BY t DESC, e DESC) AS n FROM late LEFT JOIN buy ON late.user_id = buy.user_id AND t <= ts) WHERE n = 1""")
def as_of_purchase(spark, d):
    """For each error the user's last purchase at or before it."""
    e = table(spark, d, "events")
    late = e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    buy = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_purchase"), F.max_by("value", "event_id").alias("last_value"))
    return as_of_join(late, buy, ["user_id"], "ts", "ts", ["last_purchase", "last_value"]).select("event_id", "user_id", F.coalesce("last_purchase", F.lit(-1)).alias("last_purchase"), "last_value")


@query("""
, band AS (SELECT c_nationkey AS deal, width_lo, width_lo + 2500.0 AS width_hi FROM (SELECT DISTINCT c_nationkey FROM customer), (SELECT unnest([CAST(-1000 AS DOUBLE), 1500, 4000, 6500, 9000]) AS width_lo))
SELECT deal, width_lo AS lo, count(*) AS n, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS balance FROM customer JOIN band ON deal = c_nationkey AND c_acctbal >= width_lo AND c_acctbal < width_hi GROUP BY 1, 2""", facts=True)
def balance_bands(spark, d):
    """Customers in each deal's bands of balances, by a banded range join."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("deal"), "c_acctbal")
    lows = F.explode(F.array(*(F.lit(x) for x in (-1000.0, 1500.0, 4000.0, 6500.0, 9000.0)))).alias("lo")
    bands = c.select("deal").distinct().select("deal", lows).withColumn("hi", F.col("lo") + 2500.0)
    j = range_join(c, bands, ["deal"], "c_acctbal", "lo", "hi", 2500.0)
    return j.groupBy("deal", "lo").agg(F.count("*").alias("n"), F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("balance"))


@query("""
, a AS (SELECT DISTINCT deal, period FROM ord WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT deal, period FROM ord WHERE o_orderstatus = 'P')
SELECT deal, period, 'only_f' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT deal, period, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL
SELECT deal, period, 'only_p' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def period_sets(spark, d):
    """Periods of finished and of partial orders: difference, intersection and union."""
    o = order_facts(spark, d)
    side = lambda s: o.filter(F.col("o_orderstatus") == s).select("deal", "period").distinct()
    a, b = side("F"), side("P")
    return a.subtract(b).withColumn("side", F.lit("only_f")).unionByName(a.intersect(b).withColumn("side", F.lit("both"))).unionByName(b.subtract(a).withColumn("side", F.lit("only_p")))


@query("""
SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""", facts=False)
def customers_without_orders(spark, d):
    """Anti join: what is required and missing."""
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(table(spark, d, "orders").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""
, t AS (SELECT deal, period, receipts_cents AS v FROM receipts)
SELECT deal, period, v, CAST(sum(v) OVER (PARTITION BY deal ORDER BY period) AS BIGINT) AS running, CAST(first_value(v) OVER (PARTITION BY deal ORDER BY period) AS BIGINT) AS first_v,
       CAST(last_value(v) OVER (PARTITION BY deal ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS BIGINT) AS last_v,
       CAST(ntile(3) OVER (PARTITION BY deal ORDER BY v DESC, period) AS INTEGER) AS third, CAST(dense_rank() OVER (PARTITION BY deal ORDER BY v DESC) AS INTEGER) AS place FROM t""")
def period_windows(spark, d):
    """Running totals, ends, thirds and places of each deal's periods."""
    by, whole = Window.partitionBy("deal").orderBy("period"), Window.partitionBy("deal").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    down = Window.partitionBy("deal").orderBy(F.desc("receipts_cents"))
    t = receipts(spark, d)
    return t.select("deal", "period", F.col("receipts_cents").alias("v"), F.sum("receipts_cents").over(by).alias("running"), F.first("receipts_cents").over(by).alias("first_v"), F.last("receipts_cents").over(whole).alias("last_v"), F.ntile(3).over(Window.partitionBy("deal").orderBy(F.desc("receipts_cents"), "period")).alias("third"), F.dense_rank().over(down).alias("place"))


@query("""
, w AS (SELECT deal, period, cogs_cents, tax_e6, revenue_e4 FROM income)
SELECT deal, period, 'cogs' AS part, CAST(cogs_cents AS DOUBLE) / 100 AS amount FROM w UNION ALL SELECT deal, period, 'tax', CAST(tax_e6 AS DOUBLE) / 1000000 FROM w
UNION ALL SELECT deal, period, 'other', greatest(CAST(0 AS DOUBLE), CAST(revenue_e4 AS DOUBLE) / 10000 - CAST(cogs_cents AS DOUBLE) / 100 - CAST(tax_e6 AS DOUBLE) / 1000000) FROM w""")
def expense_composition(spark, d):
    """Where revenue goes, one row per part; what is left is never negative."""
    cogs, tax, revenue = F.col("cogs_cents").cast("double") / 100, F.col("tax_e6").cast("double") / 1000000, F.col("revenue_e4").cast("double") / 10000
    wide = income(spark, d).select("deal", "period", cogs.alias("cogs"), tax.alias("tax"), F.greatest(F.lit(0.0), revenue - cogs - tax).alias("other"))
    return wide.unpivot(["deal", "period"], ["cogs", "tax", "other"], "part", "amount")


@query("""
, g AS (SELECT deal, max(period) AS p, list(CAST(revenue_e4 AS DOUBLE) ORDER BY period) AS v FROM income GROUP BY deal)
SELECT deal, CAST(p + i AS BIGINT) AS period, 'projected' AS segment, v[len(v)] * pow(pow(v[len(v)] / v[1], 1.0 / (len(v) - 1)), i) / 10000 > 0 AS usable FROM g, (SELECT unnest([1, 2, 3]) AS i)
UNION ALL SELECT deal, period, 'historical', revenue_e4 > 0 FROM income""")
def forecast_segments(spark, d):
    """Historical and projected periods in one series with a segment column instead of padded arrays."""
    i = income(spark, d)
    s = series_stats(i.withColumn("v", F.col("revenue_e4").cast("double")), ["deal"], "period", "v").join(i.groupBy("deal").agg(F.max("period").alias("p")), "deal")
    ahead = s.select("deal", F.explode(F.array(*(F.lit(x).cast("bigint") for x in (1, 2, 3)))).alias("i"), "p", "last_value", growth_rate(F.col("first_value"), F.col("last_value"), F.col("n")).alias("g"))
    projected = ahead.select("deal", (F.col("p") + F.col("i")).alias("period"), F.lit("projected").alias("segment"), (F.col("last_value") * F.pow(1 + F.col("g") / 100, F.col("i")) / 10000 > 0).alias("usable"))
    return projected.unionByName(i.select("deal", "period", F.lit("historical").alias("segment"), (F.col("revenue_e4") > 0).alias("usable")))


@query("""
, lat AS (SELECT deal, period, CAST(revenue_e4 AS DOUBLE) / 10000 AS rev, CAST(cogs_cents AS DOUBLE) / 100 AS cogs, CAST(tax_e6 AS DOUBLE) / 1000000 AS tax FROM income)
SELECT deal, period, CASE WHEN cogs > 0 THEN floor(rev / cogs * 10000 + 0.5) / 10000 END AS cover, CASE WHEN rev > 0 THEN floor(tax / rev * 10000 + 0.5) / 10000 END AS tax_rate,
       CASE WHEN rev > 0 AND (rev - cogs) / rev BETWEEN 0.1 AND 0.9 THEN 'ok' ELSE 'out of range' END AS sanity FROM lat""")
def period_ratios(spark, d):
    """Ratios that need a positive base, and a plausibility check."""
    rev, cogs, tax = F.col("revenue_e4").cast("double") / 10000, F.col("cogs_cents").cast("double") / 100, F.col("tax_e6").cast("double") / 1000000
    margin = F.when(rev > 0, (rev - cogs) / rev)
    return income(spark, d).select("deal", "period", half_up(ratio(rev, cogs), 4).alias("cover"), half_up(ratio(tax, rev), 4).alias("tax_rate"), F.when(margin.between(0.1, 0.9), "ok").otherwise("out of range").alias("sanity"))
