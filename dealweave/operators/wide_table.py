"""Attribute-value rows into one typed row per entity, by positional stitching.

Every entity gets a global ordinal (hash bucket in the high bits, rank within the bucket in the low bits). Each attribute
is written as a dense, typed column segment aligned to a range of ordinals, and the wide rows come from laying the
segments of a range side by side: position p of every segment belongs to the same entity.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hash buckets that hold the ordinals: at least so many, and so many for each shuffle partition of the session, so that they
#: grow with the cluster; the rank within a bucket stays small.
BUCKETS, BUCKETS_A_PARTITION = 4096, 4
#: Entities in one column segment; bounds every array.
SEGMENT = 1024

PLACEHOLDERS = ("", "-", "--", "---", ".", "?", "??", "n/a", "na", "n.a.", "nan", "none", "null", "nil", "tbd", "tba", "pending", "see tab", "see note", "see above", "unknown", "#n/a", "#ref!", "x", "xx")


@dataclass(frozen=True)
class Attribute:
    """A column of the wide table: name, data type, and the pattern that a cleaned attribute label must match in full."""

    name: str
    data_type: str
    pattern: str


#: Columns of a receivables aging with the wordings that mean them.
_DAYS = r"(?: ?d(?:ays?)?\.?)?(?: past due)?"


def _bucket(lo: int, hi: int) -> str:
    return rf"(?:past due |aged )?0?{lo} ?(?:-|to) ?{hi}{_DAYS}"


def _beyond(n: int) -> str:
    return rf"(?:past due )?(?:(?:over|>|more than|older than) ?{n}|{n} ?(?:\+|plus|and over|or more)){_DAYS}"


AGING_PATTERNS = {
    "current_amt": r"current(?: \(0 days\)| amount| balance)?|curr\.?|not (?:yet )?due",
    "days_1_30": _bucket(1, 30),
    "days_31_60": _bucket(31, 60),
    "days_61_90": _bucket(61, 90),
    "days_90_plus": _beyond(90),
    "days_91_120": _bucket(91, 120),
    "days_120_plus": _beyond(120),
    "unapplied_credits": r"unapplied (?:credits?|cash)|open credits?|(?:credits?|cash) \(?unapplied\)?",
    "allowance": r"(?:less:? )?(?:bad debt )?allowance(?: for .*)?",
    "total_ar": r"total(?: ar| a/r| receivables| accounts receivable)?|(?:ar|a/r|receivables) total",
    "top_customer_pct": r"(?:top|largest|#1|biggest) cust(?:omer|\.)? ?(?:%|pct\.?|percent|share|concentration)",
    "top5_pct": r"(?:top[ -]?(?:5|five)|(?:5|five) largest)(?: customers?)? ?(?:%|pct\.?|percent|share|concentration)",
    "invoice_count": r"(?:# ?|no\. of |number of )?(?:open )?(?:inv\.|invoices)|invoice count|open invoices",
    "customer_count": r"(?:# ?|no\. of |number of )customers|customers with (?:a )?balance|customer count",
    "as_of_date": r"(?:as[ -]of|report|aging)(?: date)?",
    "currency_code": r"currency(?: code)?|ccy|curr\.? code",
    "dso_days": r"dso(?: \(?days\)?)?|days sales outstanding",
}


def clean_label(c: Column) -> Column:
    """Lower case, one kind of dash and space, no colon or dots at the end."""
    c = F.translate(F.lower(c), "   ‐‑‒–—−_", "   ------ ")
    c = F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r" ?[:*]+$", "")
    return F.regexp_replace(c, r" ?- ?", "-")


def clean_value(c: Column) -> Column:
    """Trimmed text with plain spaces; null for blanks and placeholders."""
    c = F.trim(F.regexp_replace(F.translate(c, "   −", "   -"), r"\s+", " "))
    return F.when(~F.lower(c).isin(*PLACEHOLDERS), c)


def _numbers(df: DataFrame) -> DataFrame:
    """Adds ``__number``: ``1,234.5``, ``$1,234``, ``USD 1,234``, ``12.5 pct``, ``68 days``; ``(1)``, ``-1``, ``1-`` are negatives.

    Works in steps of one column each, so that no expression is written out more than once.
    """
    number = F.col("__kind").isin("amount", "percent", "integer", "decimal")  # null text costs no patterns
    df = df.withColumn("__plain", F.regexp_replace(F.lower(F.when(number, F.col("__text"))), r"us\$|usd|\$|%|percent|pct\.?|days?|\s", ""))
    df = df.withColumn("__digits", F.regexp_replace("__plain", r"^[-(]+|[-)]+$", ""))
    ok = F.col("__digits").rlike(r"^(?:\d{1,3}(?:,\d{3})+|\d+)?(?:\.\d+)?$") & F.col("__digits").rlike(r"\d")
    df = df.withColumn("__size", F.when(ok, F.regexp_replace("__digits", ",", "")).try_cast("decimal(28,6)"))
    return df.withColumn("__number", F.when(F.col("__plain").rlike(r"^\(.*\)$|^-|-$"), -F.col("__size")).otherwise(F.col("__size")))


def _days(df: DataFrame) -> DataFrame:
    """Adds ``__day``: ``2024-05-22``, ``5/22/2024``, ``May 22, 2024``, ``22 May 2024``; null for days that do not exist."""
    df = df.withColumn("__title", F.initcap(F.when(F.col("__kind") == "date", F.col("__text"))))
    df = df.withColumn("__dmy", F.regexp_replace("__title", r"^([A-Z][a-z]{2})[a-z]*\.? (\d{1,2}),? (\d{4})$", "$2 $1 $3"))
    df = df.withColumn("__dmy", F.regexp_replace("__dmy", r"^(\d{1,2}) ([A-Z][a-z]{2})[a-z]*\.?,? (\d{4})$", "$1 $2 $3"))
    read = lambda pattern, fmt: F.when(F.col("__dmy").rlike(pattern), F.try_to_timestamp("__dmy", F.lit(fmt)).cast("date"))
    return df.withColumn("__day", F.coalesce(read(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), read(r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), read(r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy")))


def value_keys(df: DataFrame) -> DataFrame:
    """Adds ``__key`` to rows with ``__kind`` and ``__text``: the value in one form per type, null if it cannot be read.

    amount: whole dollars; percent: hundredths of a point; integer: plain; decimal: tenths; date: ISO; text: upper case.
    """
    kind = F.col("__kind")
    scaled = F.col("__number") * F.when(kind == "percent", 100).when(kind == "decimal", 10).otherwise(1)
    return _days(_numbers(df)).withColumn(
        "__key",
        F.when(kind.isin("amount", "percent", "integer", "decimal"), F.round(scaled, 0).cast("decimal(38,0)").cast("string"))
        .when(kind == "date", F.col("__day").cast("string"))
        .when(kind == "text", F.upper("__text")),
    )


#: The Spark type of a wide column and how its key becomes one.
_TYPED = {
    "amount": ("bigint", lambda k: k.try_cast("bigint")),
    "percent": ("decimal(20,2)", lambda k: (k.try_cast("decimal(18,0)") / 100).cast("decimal(20,2)")),
    "integer": ("bigint", lambda k: k.try_cast("bigint")),
    "decimal": ("decimal(20,1)", lambda k: (k.try_cast("decimal(18,0)") / 10).cast("decimal(20,1)")),
    "date": ("date", lambda k: k.try_cast("date")),
    "text": ("string", lambda k: k),
}


def typed_cells(df: DataFrame, attributes: list[Attribute], *, entity: str, label: str, value: str, latest: list[str]) -> DataFrame:
    """``__entity, __attr, __key``: the latest readable value of each attribute of each entity.

    ``latest`` are the columns whose greatest values win, compared from left to right, nulls last.
    """
    order = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(latest)))
    rows = df.select(F.col(entity).alias("__entity"), clean_label(F.col(label)).alias("__label"), clean_value(F.col(value)).alias("__text"), order.alias("__order"))
    attr = F.coalesce(*(F.when(F.col("__label").rlike(f"^(?:{a.pattern})$"), F.lit(a.name)) for a in attributes))
    kinds = F.create_map(*(F.lit(x) for a in attributes for x in (a.name, a.data_type)))
    rows = rows.select("__entity", "__text", "__order", attr.alias("__attr")).filter("__entity is not null")
    rows = value_keys(rows.withColumn("__kind", kinds[F.col("__attr")]))
    # unknown labels and unreadable values are left out by aggregates: a filter before them would be pushed down to the scan
    # and write out the label's and value's expressions once for every use
    best = F.expr("max_by(__key, __order) filter (where __key is not null)").alias("__key")
    cells = rows.groupBy("__entity", "__attr").agg(best, F.first("__attr").alias("__named"))
    return cells.filter("__named is not null and __key is not null").drop("__named")


def stitch_wide(cells: DataFrame, attributes: list[Attribute], *, entity: str) -> DataFrame:
    """``entity_ordinal, <entity>`` and one typed column per attribute, one row per entity that has any value.

    Defined results: rows with a null entity, an unknown label or an unreadable value give no cell (see ``typed_cells``);
    of several values the latest counts, whole ties going to the greatest key of ``latest``; an entity without any cell
    has no row; a number beyond the range of its column's type is a null cell; an empty table gives an empty wide table; attribute columns never clash with input columns, as only the
    entity is carried over.

    Plan: one shuffle with map-side combine for the cells, so an entity or attribute with a third of all rows arrives
    already reduced; one shuffle by ordinal bucket, whose partitioning serves the rank, the segments and the stitching.
    Arrays hold at most ``SEGMENT`` values.
    """
    # the column segments of a bucket are built where the bucket lies
    buckets = max(BUCKETS, BUCKETS_A_PARTITION * int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cells.withColumn("__bucket", F.pmod(F.xxhash64("__entity"), F.lit(buckets)).cast("int")).repartition("__bucket")
    w = Window.partitionBy("__bucket").orderBy("__entity")
    placed = placed.withColumn("__rank", F.dense_rank().over(w) - 1)
    placed = placed.withColumn("__range", F.floor(F.col("__rank") / SEGMENT).cast("int")).withColumn("__at", (F.col("__rank") % SEGMENT).cast("int"))
    segments = placed.groupBy("__bucket", "__range", "__attr").agg(
        F.map_from_entries(F.collect_list(F.struct("__at", "__key"))).alias("__seg"),
        F.map_from_entries(F.collect_set(F.struct("__at", "__entity"))).alias("__names"),
    )
    # every range has as many positions as entities; each segment is laid out densely over them
    side = segments.groupBy("__bucket", "__range").agg(
        F.max(F.array_max(F.map_keys("__seg"))).alias("__last"),
        *(F.first(F.when(F.col("__attr") == a.name, F.col("__seg")), ignorenulls=True).alias(a.name) for a in attributes),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.map_entries("__names"))))).alias("__who"),
    )

    def dense(a: Attribute) -> Column:
        convert = _TYPED[a.data_type][1]
        at = F.col(a.name)
        return F.transform(F.sequence(F.lit(0), F.col("__last")), lambda p: convert(F.try_element_at(at, p))).alias(a.name)

    columns = side.select("__bucket", "__range", F.transform("__who", lambda e: e["value"]).alias("__who"), *(dense(a) for a in attributes))
    wide = columns.select("__bucket", "__range", F.posexplode(F.arrays_zip("__who", *(a.name for a in attributes))).alias("__at", "__row"))
    ordinal = F.shiftleft(F.col("__bucket").cast("bigint"), 32) + F.col("__range").cast("bigint") * SEGMENT + F.col("__at")
    return wide.select(ordinal.alias("entity_ordinal"), F.col("__row.__who").alias(entity), *(F.col(f"__row.{a.name}").alias(a.name) for a in attributes))


def wide_keys(wide: DataFrame, attributes: list[Attribute], *, entity: str) -> DataFrame:
    """The filled cells of a wide table as ``<entity>, field_name, value_key``."""

    def key(a: Attribute) -> Column:
        c = F.col(a.name)
        factor = {"percent": 100, "decimal": 10}.get(a.data_type)
        return (c * factor).cast("decimal(20,0)").cast("string") if factor else c.cast("string")

    pairs = F.array(*(F.struct(F.lit(a.name).alias("field_name"), key(a).alias("value_key")) for a in attributes))
    return wide.select(entity, F.explode(pairs).alias("p")).select(entity, "p.field_name", "p.value_key").filter("value_key is not null")
