"""Period labels as column expressions: key, granularity and sort value of ``FY 2022``, ``Q3-24``, ``2024-03``, ``LTM``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SINGLE = "_single"
LTM_SORT, LAST_SORT = 999_999, 9_007_199_254_740_991
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH_NAMES = r"^(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def parse_period(c: Column, strict_compat: bool = False) -> Column:
    """STRUCT(period_key, granularity, sort_value), null if the label is no period.

    Quarters and months come before a year inside a longer label; with ``strict_compat`` the year comes first, so that
    ``Q1 2024`` and ``2024-03`` are the year 2024.
    """
    s = _plain(c)
    year = F.regexp_extract(s, r"^(?:fy ?)?((?:19|20)\d{2})e?$", 1)
    within = F.regexp_extract(s, r"(?:^|[^a-z0-9])(?:fy ?)?((?:19|20)\d{2})e?(?:[^a-z0-9]|$)", 1)
    full = lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    q_first, q_last = r"^q([1-4])[ /-]*((?:19|20)?\d{2})$", r"^((?:19|20)?\d{2})[ /-]*q([1-4])$"
    quarter = F.concat(F.regexp_extract(s, q_first, 1), F.regexp_extract(s, q_last, 2))
    q_year = full(F.concat(F.regexp_extract(s, q_first, 2), F.regexp_extract(s, q_last, 1)))
    iso = r"^((?:19|20)\d{2})[/-](0?[1-9]|1[0-2])$"
    named = _MONTH_NAMES + r"[ /,-]+((?:19|20)\d{2}|\d{2})$"
    word = F.substring(F.regexp_extract(s, named, 1), 1, 3)
    by_name = F.lpad(F.array_position(F.array(*map(F.lit, _MONTHS)), word).cast("string"), 2, "0")
    month = F.when(s.rlike(iso), F.lpad(F.regexp_extract(s, iso, 2), 2, "0")).when(word != "", by_name)
    m_year = F.when(s.rlike(iso), F.regexp_extract(s, iso, 1)).otherwise(full(F.regexp_extract(s, named, 2)))

    def made(key: Column, granularity: str, sort: Column) -> Column:
        return F.struct(key.alias("period_key"), F.lit(granularity).alias("granularity"), sort.cast("bigint").alias("sort_value"))

    is_year, is_within = (year != "", made(year, "year", year.cast("int") * 100)), (within != "", made(within, "year", within.cast("int") * 100))
    is_quarter = (quarter != "", made(F.concat_ws("-Q", q_year, quarter), "quarter", q_year.cast("int") * 100 + quarter.cast("int")))
    is_month = (month.isNotNull(), made(F.concat_ws("-", m_year, month), "month", m_year.cast("int") * 100 + month.cast("int")))
    order = [is_year, is_within, is_quarter, is_month] if strict_compat else [is_year, is_quarter, is_month, is_within]
    out = F.when(s.isin("ltm", "ttm"), made(F.lit("LTM"), "ltm", F.lit(LTM_SORT)))
    for test, value in order:
        out = out.when(test, value)
    return out


def is_value_period(c: Column) -> Column:
    """Whether a column header with a year names values, not their growth, margin or share."""
    s = _plain(c)
    has_year = s.rlike(r"\b(?:19|20)\d{2}\b")
    return (s != "") & (~has_year | ~s.rlike(r"(?:^|\s)(?:yoy|margin|mix|growth|cagr|percent|%)(?:\s|$)"))


def period_of(*labels: Column) -> Column:
    """Key of the first label that is a period, else ``_single``."""
    return F.coalesce(*(parse_period(x)["period_key"] for x in labels), F.lit(SINGLE))


def describe_period(key: Column) -> Column:
    """Granularity and sort value of a period key; ``_single`` is a point in time and sorts last."""
    p = parse_period(key)
    g = F.when(key == SINGLE, "point_in_time").otherwise(F.coalesce(p["granularity"], F.lit("unknown")))
    return F.struct(key.alias("period_key"), g.alias("granularity"), F.coalesce(F.when(key == SINGLE, F.lit(LAST_SORT)), p["sort_value"], F.lit(LAST_SORT)).cast("bigint").alias("sort_value"))


def year_in(c: Column) -> Column:
    """The first year 19xx or 20xx that stands alone in a text, null if none."""
    y = F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1)
    return F.when(y != "", y.cast("int"))


def to_day(c: Column) -> Column:
    """DATE of ``2024-05-22``, ``5/22/2024`` or ``May 22, 2024``, null for others and for days that do not exist."""
    t = F.trim(c)
    read = lambda p, f: F.when(t.rlike(p), F.try_to_timestamp(t, F.lit(f)).cast("date"))
    return F.coalesce(read(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), read(r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), read(r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"), read(r"^[A-Z][a-z]{3,8} \d{1,2}, \d{4}$", "MMMM d, yyyy"))
