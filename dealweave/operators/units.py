"""Quantities recorded in different units: amounts to whole dollars, rates to percent per year.

What a cell, a column header, a title or a note row states about the unit is read first. The column of each file is then
a history of log values under that reading, and an exact penalised changepoint search splits it into levels; a level that
lies a known factor away from the file's own reference marks a unit change, which is reversed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .changepoint import known_shift, level_shifts, segment, segment_pieces

#: Places of a file searched in one task; the changes of longer files are found block by block and then searched as a whole.
BLOCK_ROWS = 4096
PENALTY = 1.0
#: Log10 of the factors between units: dollars, thousands, millions; fractions, percent, basis points.
AMOUNT_SHIFTS = (0.0, 3.0, 6.0, -3.0, -6.0)
RATE_SHIFTS = (0.0, 2.0, -2.0)
#: Reference level of a rate history, in percent a year: rates within a factor of eight of it are no unit change.
TYPICAL_RATE = 6.0

_NOT_AFTER_NUMBER = r"(?<!\d )(?<!\d)"
THOUSAND_STATED = rf"(?i)(?:{_NOT_AFTER_NUMBER}\bthousands?\b|\btsd\b|\$ ?k\b|\bk (?:usd|\$)|\busd k\b|(?<![\d,.])'?000'?s?\b|\bx ?1,?000\b)"
MILLION_STATED = rf"(?i)(?:{_NOT_AFTER_NUMBER}\bmillions?\b|\bmio\b|\bmm\b|\$ ?mm?\b|\bm\$|\b(?:us\$|usd) ?mm?\b|\bx ?1,?000,?000\b)"
BASIS_POINTS_STATED = r"(?i)(?:\bbps?\b|\bb\.p\.|\bbasis points?\b)"
NOTE_ROW = r"(?i)^\s*(?:\*|note\s*:|basis\s*:|n\.\s?b\.)"
TOTAL_ROW = r"(?i)^\s*(?:(?:grand|sub) ?-?)?total(?: (?:revenue|sales|net sales|debt|principal|outstanding))?\s*:?\s*$"


def stated_scale(text: Column) -> Column:
    """Decades (3, 6) of the dollar unit that ``text`` states for a column, null if it states none.

    A number before the unit (``over $50K``, ``$10 thousand``) is a quantity, not a statement.
    """
    return F.when(text.rlike(MILLION_STATED), 6).when(text.rlike(THOUSAND_STATED), 3)


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "\u2019", "'"), r"[\s\x{A0}\x{2007}\x{2009}\x{202F}]+", " "))


def amount_cells(df: DataFrame) -> DataFrame:
    """Adds ``__number`` (as written) and ``__own`` (decades of the cell's own unit, null if none) for ``__raw``."""
    df = df.withColumn("__text", F.lower(_plain(F.col("__raw"))))
    pattern = r"^(-?\(?)(?:usd|us\$|\$)? ?(-?\d[\d, ]*(?:\.\d+)?) ?(\)?) ?([^\d].*|'000s?)?$"
    df = df.withColumn("__size", F.regexp_replace(F.regexp_extract("__text", pattern, 2), "[ ,]", "").try_cast("decimal(28,6)"))
    df = df.withColumn("__unit", F.trim(F.regexp_extract("__text", pattern, 4)))
    df = df.withColumn("__number", F.when(F.regexp_extract("__text", pattern, 1) != "", -F.col("__size")).otherwise(F.col("__size")))
    own = (
        F.when(F.col("__unit").rlike(r"^(?:k|thousands?|tsd\.?|\(?(?:in )?'?000'?s?\)?)(?: ?(?:usd|us\$|\$))?$|^(?:usd|us\$|\$) ?(?:k|'?000s?)$"), 3)
        .when(F.col("__unit").rlike(r"^(?:m|mm|mn|mio\.?|mill?\.?|millions?)(?: ?(?:usd|us\$|\$))?$|^(?:usd|us\$|\$) ?mm?$"), 6)
        .when(F.col("__unit").rlike(r"^(?:usd|us\$|\$|dollars?)$"), 0)
    )
    return df.withColumn("__own", own)


def rate_cells(df: DataFrame) -> DataFrame:
    """Adds ``__number`` (as written), ``__own`` (percent points per unit, null if none) and ``__times`` (periods a year)."""
    df = df.withColumn("__text", F.lower(_plain(F.col("__raw"))))
    pattern = r"^(-?\d[\d,]*(?:\.\d+)?)(?: (\d+)/([1-9]\d*))? ?([^\d].*)?$"
    whole = F.regexp_replace(F.regexp_extract("__text", pattern, 1), ",", "").try_cast("decimal(28,8)")
    part = F.regexp_extract("__text", pattern, 2).try_cast("decimal(10,0)") / F.regexp_extract("__text", pattern, 3).try_cast("decimal(10,0)")
    df = df.withColumn("__unit", F.trim(F.regexp_extract("__text", pattern, 4)))
    df = df.withColumn("__number", (whole + F.coalesce(part, F.lit(0))).try_cast("decimal(28,8)"))
    own = F.when(F.col("__unit").rlike(r"^(?:bps?|b\.p\.|basis points?)\b|^b\.p\."), F.lit("0.01").cast("decimal(10,4)")).when(F.col("__unit").rlike(r"^(?:%|percent|per cent|pct)"), F.lit("1").cast("decimal(10,4)"))
    times = (
        F.when(F.col("__unit").rlike(r"/ ?mo\b|per month|p\.m\.|monthly|/month|a month"), 12)
        .when(F.col("__unit").rlike(r"/ ?qtr|/ ?q\b|per quarter|p\.q\.|quarterly"), 4)
        .when(F.col("__unit").rlike(r"semi-?annual|per half|half-?yearly"), 2)
        .when(F.col("__unit").rlike(r"/ ?wk|per week|weekly"), 52)
        .when(F.col("__unit").rlike(r"/ ?day|per day|daily|per diem"), 365)
        .otherwise(1)
    )
    return df.withColumn("__own", own).withColumn("__times", times)


def _search(shifts: tuple[float, ...], penalty: float, tolerance: float):
    """Pandas UDF: for each history (log values and their reference) the known shift of every value, in decades."""

    def one(logs: np.ndarray, ref: float | None) -> list[int]:
        y = np.array(logs, dtype=float)  # null becomes NaN
        out, known = np.zeros(len(y), dtype=int), ~np.isnan(y)
        out[known] = level_shifts(y[known], shifts, penalty, tolerance, None if ref is None or np.isnan(ref) else float(ref)).astype(int)
        return out.tolist()

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for logs, refs in batches:
            yield pd.Series([one(y, r) for y, r in zip(logs, refs)])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<int>")


def _pieces(penalty: float):
    """Pandas UDF: the segments of each block: place, number, sum and sum of squares of their values."""

    def one(logs: np.ndarray) -> list[dict]:
        y = np.array(logs, dtype=float)
        at = np.flatnonzero(~np.isnan(y))
        v = y[at]
        return [{"at": int(at[a]), "n": b - a, "s1": float(v[a:b].sum()), "s2": float((v[a:b] ** 2).sum())} for a, b in segment(v, penalty)]

    return F.pandas_udf(lambda logs: pd.Series([one(y) for y in logs]), "array<struct<at:int,n:int,s1:double,s2:double>>")


def _merged(shifts: tuple[float, ...], penalty: float, tolerance: float):
    """Pandas UDF: the known shift of each piece of a history, whose pieces are searched as one series."""

    def one(pieces: np.ndarray, ref: float | None) -> list[int]:
        n, s1, s2 = (np.array([p[k] for p in pieces], dtype=float) for k in ("n", "s1", "s2"))
        out = [0] * len(pieces)
        base = s1.sum() / n.sum() if ref is None or np.isnan(ref) else float(ref)
        for a, b in segment_pieces(n, s1, s2, penalty):
            out[a:b] = [int(known_shift(s1[a:b].sum() / n[a:b].sum(), base, shifts, tolerance))] * (b - a)
        return out

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pieces, refs in batches:
            yield pd.Series([one(p, r) for p, r in zip(pieces, refs)])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<int>")


def with_level_shifts(df: DataFrame, *, keys: list[str], place: str, log: str, reference: str, shifts: tuple[float, ...], spread: str, penalty: float = PENALTY, tolerance: float = 1.5, block_rows: int = BLOCK_ROWS, last_place: int | None = None) -> DataFrame:
    """Adds ``level_shift``: the known shift of the changepoint segment that a value lies in, in decades.

    Histories are the rows of ``keys`` ordered by ``place``, cut into blocks of ``block_rows`` places, so a history with a
    third of all rows is spread over many tasks and no array exceeds a block. The segments of all blocks of a history, few
    numbers each, are then searched as one series, so a level that goes over the end of a block is one segment and pays no
    penalty there. ``last_place`` is the greatest place, if the caller knows it: histories of one block need no second
    search. Rows without a place have no neighbours and are spread by a hash of their ``spread`` column. Rows whose ``log``
    is null (zero values) belong to no level and get 0.
    """
    own = [c for c in df.columns if c not in keys]
    block = F.coalesce(F.floor(F.col(place) / block_rows).cast("bigint"), -1 - F.pmod(F.xxhash64(spread), F.lit(1 << 20)))
    row = F.struct(F.col(place).alias("p"), F.col(log).alias("y"), F.struct(*own).alias("r"))
    grouped = df.withColumn("__block", block).groupBy(*keys, "__block").agg(F.array_sort(F.collect_list(row)).alias("__rows"), F.max(reference).alias("__ref"))
    if last_place is not None and last_place < block_rows:
        searched = grouped.withColumn("__shift", _search(shifts, penalty, tolerance)(F.col("__rows.y"), F.col("__ref")))
    else:
        # rows without a place are histories of their own
        series = [*keys, F.when(F.col("__block") < 0, F.col("__block")).alias("__alone")]
        # blocks are cut finer than the penalty asks: what stays a change is decided by the second search alone
        pieces = grouped.select(*series, "__block", "__ref", F.explode(_pieces(penalty / 8)("__rows.y")).alias("p")).groupBy(*keys, "__alone")
        pieces = pieces.agg(F.array_sort(F.collect_list(F.struct("__block", "p.at", "p.n", "p.s1", "p.s2"))).alias("__pieces"), F.max("__ref").alias("__ref"))
        found = pieces.withColumn("__s", _merged(shifts, penalty, tolerance)("__pieces", "__ref")).select(*keys, F.explode(F.arrays_zip("__pieces", "__s")).alias("z"))
        found = found.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("z.__pieces.__block").alias("__b")).agg(F.array_sort(F.collect_list(F.struct("z.__pieces.at", F.col("z.__s").alias("s")))).alias("__starts"))
        same = grouped["__block"] == found["__b"]
        for i, k in enumerate(keys):
            same = same & grouped[k].eqNullSafe(found[f"__k{i}"])
        joined = grouped.hint("merge").join(found, same, "left")
        begun = lambda i: F.filter("__starts", lambda x: x["at"] <= i)
        shift = F.transform("__rows", lambda r, i: F.when(r["y"].isNotNull(), F.coalesce(F.try_element_at(begun(i), F.lit(-1))["s"], F.lit(0))).otherwise(0))
        searched = joined.withColumn("__shift", shift)
    out = searched.select(*keys, F.explode(F.arrays_zip("__rows", "__shift")).alias("z"))
    return out.select(*keys, F.col("z.__rows.r.*"), F.col("z.__shift").alias("level_shift"))


def _last_place(df: DataFrame, place: str) -> int:
    """The greatest place of a table: one number, from one integer column."""
    return df.agg(F.max(F.col(place).cast("bigint"))).first()[0] or 0


def silent_unit_changes(df: DataFrame, *, keys: list[str], place: str, value: str, row_id: str, shifts: tuple[float, ...] = AMOUNT_SHIFTS, penalty: float = PENALTY, tolerance: float = 1.5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``<keys>, <row_id>, level_shift, restored``: every value with the unit change that only its level shows, reversed.

    No text speaks here: each history of ``keys`` in the order of ``place`` is split by the changepoint search on log values,
    and a segment a known factor off the history's median is taken back by that factor.

    Defined results: null and zero values have no level and stay; a null key is a history; rows without a place are judged
    one by one; a history of which half or more is recorded otherwise is taken to be in that unit; repeated rows are kept;
    an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    rows = df.select(*(F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)), F.col(row_id).alias("__row"), F.col(place).cast("bigint").alias("__place"), F.col(value).cast("double").alias("__value"))
    named = [f"__key{i}" for i in range(len(keys))]
    rows = rows.withColumn("__log", F.when((F.col("__value") != 0) & ~F.isnan("__value"), F.log10(F.abs("__value"))))
    middle = rows.groupBy(*(F.col(k).alias(f"{k}r") for k in named)).agg(F.percentile_approx("__log", 0.5, 10_000).alias("__reference"))
    same = F.lit(True)
    for k in named:
        same = same & rows[k].eqNullSafe(middle[f"{k}r"])
    cells = rows.join(middle, same).select(*named, "__row", "__place", "__value", "__log", "__reference")
    found = with_level_shifts(cells, keys=named, place="__place", log="__log", reference="__reference", shifts=shifts, spread="__row", penalty=penalty, tolerance=tolerance, block_rows=block_rows, last_place=_last_place(rows, "__place"))
    return found.select(*(F.col(k).alias(c) for k, c in zip(named, keys)), F.col("__row").alias(row_id), "level_shift", (F.col("__value") * F.pow(F.lit(10.0), -F.col("level_shift"))).alias("restored"))


def amounts_in_dollars(df: DataFrame, *, row_id: str, file: str, place: str, value: str, name: str, title: str, header: str | None = None, share: str | None = None) -> DataFrame:
    """``row_id, number, decades, dollars, level_shift, evidence`` for every amount present in ``value``.

    The unit of an amount is, in this order: the cell's own; for a total row, the one that its level has against its
    customers; the one stated in the file's header, title or note rows; dollars. ``decades`` is its power of ten.

    Defined results: blanks, placeholders and texts that are no amount give no row, nulls neither; null titles, names and
    shares state nothing; a null file is one file; a total without customers is in the file's stated unit; a zero has no
    level; an amount too large for a BIGINT of dollars has null dollars; repeated rows are each converted; other columns of
    ``df`` are ignored, whatever their names.

    Plan: statements and the reference level are partial aggregates per file (a few numbers each), joined back on the
    file, where the adaptive skew join splits a hot file; then one shuffle on (file, block) for the search.
    """
    n, text = F.col(name), lambda c: F.col(c) if c else F.lit(None).cast("string")
    rows = df.select(
        F.col(row_id).alias("row_id"), F.coalesce(F.col(file).cast("string"), F.lit("")).alias("__file"), F.col(place).cast("bigint").alias("__place"), F.col(value).alias("__raw"),
        F.coalesce(n.rlike(TOTAL_ROW), F.lit(False)).alias("__total"),
        F.coalesce(stated_scale(text(header)), stated_scale(text(title)), F.when(n.rlike(NOTE_ROW), stated_scale(n))).alias("__said"),
        F.regexp_replace(text(share), r"[%\s]", "").try_cast("double").alias("__pct"),
    )
    rows = amount_cells(rows)
    log = lambda c: F.when(c != 0, F.log10(F.abs(c.cast("double"))))
    rows = rows.withColumn("__log", log(F.col("__number")))
    part = F.col("__log") - F.log10(F.when(F.col("__pct") > 0, F.col("__pct") / 100))
    customer = ~F.col("__total") & F.col("__number").isNotNull()
    # the level of a file as written, apart from cells with their own unit: customers' value over their share, or their sum
    plain = customer & F.col("__own").isNull()
    files = rows.groupBy("__file").agg(
        F.max("__said").alias("__stated"),
        F.avg(F.when(plain, part)).alias("__level"),
        F.log10(F.sum(F.when(plain, F.abs(F.col("__number").cast("double")) * F.lit(1.0)))).alias("__sum"),
        F.log10(F.sum(F.when(customer & F.col("__own").isNotNull(), F.abs(F.col("__number").cast("double")) * F.pow(F.lit(10.0), F.col("__own"))))).alias("__own_sum"),
        F.avg(F.when(customer & F.col("__own").isNotNull(), part + F.col("__own"))).alias("__own_level"),
    )
    stated = F.coalesce(F.col("__stated"), F.lit(0))
    # rows without a number stay to the end: a filter here would be pushed to the scan and read every cell twice
    cells = rows.select("row_id", "__file", "__place", "__number", "__own", "__total", "__pct", "__log").join(files, "__file")
    reading = F.coalesce(F.col("__own"), stated)
    share_log = F.when(F.col("__total"), F.lit(0.0)).when(F.col("__pct") > 0, F.log10(F.col("__pct") / 100))
    reference = F.coalesce(F.col("__level") + stated, F.col("__own_level"), F.col("__sum") + stated, F.col("__own_sum"))
    cells = cells.select(
        "row_id", "__file", "__place", "__number", "__own", "__total", F.col("__stated"), reading.alias("__reading"), reference.alias("__reference"),
        (F.col("__log") + reading - F.coalesce(share_log, F.col("__log") + reading - reference, F.lit(0.0))).alias("__y"),
    )
    found = with_level_shifts(cells, keys=["__file"], place="__place", log="__y", reference="__reference", shifts=AMOUNT_SHIFTS, spread="row_id", last_place=_last_place(df, place))
    turned = F.col("__total") & F.col("__own").isNull() & F.col("__reference").isNotNull()
    decades = F.when(turned, F.col("__reading") - F.col("level_shift")).otherwise(F.col("__reading")).cast("int")
    power = F.element_at(F.create_map(*(x for e in range(-6, 13, 3) for x in (F.lit(e), F.lit(f"{10.0**e:.6f}").cast("decimal(20,6)")))), F.col("decades"))
    return found.filter("__number is not null").withColumn("decades", decades).select(
        "row_id", F.col("__number").alias("number"), "decades",
        F.round(F.try_multiply(F.col("__number").try_cast("decimal(22,6)"), power.cast("decimal(16,6)")), 0).try_cast("bigint").alias("dollars"), "level_shift",
        F.when(F.col("__own").isNotNull(), "cell").when(turned & (F.col("level_shift") != 0), "level").when(F.col("__stated").isNotNull(), "stated").otherwise("default").alias("evidence"),
    )


def rates_in_percent(df: DataFrame, *, row_id: str, file: str, place: str, value: str, name: str, title: str) -> DataFrame:
    """``row_id, number, points, times, milli_percent, level_shift, evidence`` for every rate present in ``value``.

    ``points`` is what one of the recorded unit is in percent points (100 fraction, 1 percent, 0.01 basis point) and
    ``times`` the periods a year; ``milli_percent`` is thousandths of a percentage point a year. The unit is the cell's
    own, else the one stated in the file's title or note rows, else a fraction below 1 and percent from 1 up.

    Defined results: as for ``amounts_in_dollars``.
    """
    n = F.col(name)
    says = lambda c: F.when(c.rlike(BASIS_POINTS_STATED), 1)
    rows = df.select(
        F.col(row_id).alias("row_id"), F.coalesce(F.col(file).cast("string"), F.lit("")).alias("__file"), F.col(place).cast("bigint").alias("__place"), F.col(value).alias("__raw"),
        F.coalesce(says(F.col(title)), F.when(n.rlike(NOTE_ROW), says(n))).alias("__said"),
    )
    rows = rate_cells(rows)
    files = rows.groupBy("__file").agg(F.max("__said").alias("__stated"))
    cells = rows.select("row_id", "__file", "__place", "__number", "__own", "__times").join(files, "__file")
    # one history of log percent; bare numbers as written, so that fractions among percents show as a level of their own
    reading = F.coalesce(F.col("__own"), F.when(F.col("__stated").isNotNull(), F.lit("0.01").cast("decimal(10,4)")), F.lit("1").cast("decimal(10,4)"))
    cells = cells.withColumn("__reading", reading)
    y = F.log10(F.when(F.col("__number") != 0, F.abs((F.col("__number") * F.col("__reading")).cast("double")) * F.col("__times")))
    cells = cells.withColumn("__y", y).withColumn("__reference", F.log10(F.lit(TYPICAL_RATE)))
    found = with_level_shifts(cells, keys=["__file"], place="__place", log="__y", reference="__reference", shifts=RATE_SHIFTS, spread="row_id", tolerance=0.9, last_place=_last_place(df, place))
    bare = F.col("__own").isNull() & F.col("__stated").isNull()
    fraction = bare & (F.abs("__number") < 1) & (F.col("__number") != 0)
    points = F.when(fraction, F.lit("100").cast("decimal(10,4)")).otherwise(F.col("__reading"))
    return found.filter("__number is not null").withColumn("points", points).select(
        "row_id", F.col("__number").alias("number"), "points", F.col("__times").alias("times"),
        F.round(F.try_multiply(F.try_multiply(F.col("__number").try_cast("decimal(18,8)"), F.col("points")), (F.col("__times") * 1000).cast("decimal(7,0)")), 0).try_cast("bigint").alias("milli_percent"), "level_shift",
        F.when(F.col("__own").isNotNull(), "cell").when(~bare, "stated").when(fraction & (F.col("level_shift") == -2), "level").when(fraction, "below one").otherwise("default").alias("evidence"),
    )
