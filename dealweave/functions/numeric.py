"""Number rules as column expressions: rounding half up on the binary double, tolerant parsing, differences, growth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 2) -> Column:
    """Rounds half up toward plus infinity on the binary double, so -2.5 becomes -2 and 1.005 becomes 1.0."""
    scale = 10.0**digits
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def to_millions(x: Column) -> Column:
    """Whole dollars in millions with one decimal."""
    return F.floor(x / F.lit(1e5) + F.lit(0.5)) / F.lit(10.0)


def clamp(x: Column, lo: float, hi: float, missing: float | None = None) -> Column:
    """``x`` within [lo, hi]; ``missing`` (if given) for null and NaN."""
    c = F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    return c if missing is None else F.when(x.isNull() | F.isnan(x), F.lit(missing)).otherwise(c)


def relative_difference(a: Column, b: Column) -> Column:
    """Difference over the larger magnitude, which counts as 1 at least."""
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def confidence_label(x: Column) -> Column:
    """none, low, medium (from .55) or high (from .8)."""
    return F.when(x >= 0.8, "high").when(x >= 0.55, "medium").when(x > 0, "low").otherwise("none")


def scale_signal(a: Column, b: Column) -> Column:
    """Whether two values that should agree differ by a thousand or a million: ``1,000x``, ``1,000,000x`` or null."""
    ratio = F.greatest(F.abs(a), F.abs(b)) / F.greatest(F.least(F.abs(a), F.abs(b)), F.lit(1.0))
    return F.when(ratio.between(900, 1100), "1,000x").when(ratio.between(9e5, 1.1e6), "1,000,000x")


def to_number(c: Column) -> Column:
    """DOUBLE of ``1,234``, ``$5``, ``7%``, ``(8)``; null for anything else, also for symbols without a digit."""
    raw = F.trim(c)
    cleaned = F.trim(F.regexp_replace(raw, r"[,$%()]", ""))
    number = F.when(cleaned.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), cleaned).try_cast("double")
    return F.when(raw.rlike(r"^\(.*\)$"), -number).otherwise(number)


def to_percent(c: Column) -> Column:
    """Percentage points of a text: a magnitude up to 1 is a fraction; else the first ``n %`` in the text."""
    n = to_number(c)
    found = F.regexp_extract(c, r"(-?\d+(?:\.\d+)?)\s*%", 1).try_cast("double")
    return F.when(n.isNull(), half_up(found)).when(F.abs(n) <= 1, half_up(n * 100)).otherwise(half_up(n))


def growth_rate(first: Column, last: Column, periods: Column) -> Column:
    """Compound growth in percent over ``periods`` values; null unless there are two and both ends are positive."""
    return F.when((periods >= 2) & (first > 0) & (last > 0), (F.pow(last / first, F.lit(1.0) / (periods - 1)) - 1) * 100)


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` where b is positive, else null."""
    return F.when(b > 0, a / b)
