"""Label and name rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations that are spelled out in labels, in the order they apply.
LABEL_EXPANSIONS = [
    (r"[‒-―]", "-"),
    (r"\ba\s*/\s*r\b", "accounts receivable"),
    (r"\ba\s*/\s*p\b", "accounts payable"),
    (r"\bd\s*[&/]\s*a\b", "depreciation and amortization"),
    (r"\bsg\s*[&/]\s*a\b", "selling general administrative"),
    (r"\bpp\s*[&/]\s*e\b", "property plant equipment"),
    (r"\bp\s*[&/]\s*l\b", "profit and loss"),
    (r"&", " and "),
    (r"\((?:unaudited|audited|in thousands?|in millions?|000s?|mm|usd)\)", " "),
    (r"[_./\\-]+", " "),
    (r"[()]", " "),
    (r"[^a-z0-9% ]+", " "),
    (r"\s+", " "),
]
#: Words without meaning of their own in a label.
NOISE_WORDS = [
    "and", "for", "from", "the", "this", "that", "with", "without", "ended", "ending", "period", "months", "month", "years", "year", "annual", "statement", "schedule",
    "report", "actual", "budget", "forecast", "projected", "estimated", "historical", "consolidated", "unaudited", "audited", "adjusted", "normalized", "usd", "dollars",
]
#: Phrases taken out before a label is compared by its core.
NOISE_PHRASES = [
    r"\b(?:unaudited|audited|actual|budget|forecast|projected|estimated|historical|consolidated|continued)\b",
    r"\b(?:for|the|year|years|month|months|ended|ending|period|as|of|at|in|on)\b",
    r"\b(?:ltm|ttm|fy\d{2,4}|q[1-4]|ytd)\b",
    r"\b(?:total company|company total|schedule|statement|report)\b",
]
#: Legal forms left out of entity names.
LEGAL_FORMS = ["inc", "llc", "corp", "co", "company", "ltd", "lp", "llp", "pllc", "holdings", "group"]


def _apply(c: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, text in steps:
        c = F.regexp_replace(c, pattern, text)
    return c


def normalize_label(c: Column) -> Column:
    """A label in lower case, abbreviations spelled out, letters, digits and ``%`` only, single spaces."""
    return F.trim(_apply(F.lower(F.coalesce(c, F.lit(""))), LABEL_EXPANSIONS))


def strip_noise(c: Column) -> Column:
    """A normalised label without audit marks, period words and sheet words."""
    return F.trim(F.regexp_replace(_apply(c, [(p, " ") for p in NOISE_PHRASES]), r"\s+", " "))


def label_words(c: Column) -> Column:
    """Words of a label that carry meaning, in order, repeats kept."""
    noise = F.array(*map(F.lit, NOISE_WORDS))
    return F.filter(F.split(c, " "), lambda w: (F.length(w) > 1) & ~F.array_contains(noise, w))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether a single-spaced text holds the phrase as whole words."""
    return (phrase != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def keyword_signal(text: Column, keywords: Column, base: float, step: float) -> Column:
    """``base`` for one keyword found in the text plus ``step`` for each further one, 1 at most; repeats count."""
    hits = F.aggregate(keywords, F.lit(0), lambda n, k: n + F.contains(text, k).cast("int"))
    return F.when(hits > 0, F.least(F.lit(base) + (hits - 1) * F.lit(step), F.lit(1.0))).otherwise(F.lit(0.0))


def entity_key(c: Column) -> Column:
    """An organisation's name in lower case words without legal forms."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "&", " and "), r"[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~F.array_contains(F.array(*map(F.lit, LEGAL_FORMS)), w)), " ")


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words of two single-spaced names over the words of the longer one; 1 for equal names."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.when(a == b, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)))


def humanize(c: Column) -> Column:
    """``netChangeInCash`` as ``Net Change In Cash``."""
    return F.initcap(F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2"))


def slug(c: Column) -> Column:
    """Lower-case letters and digits joined by single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def source_key(*parts: Column) -> Column:
    """Parts of a source reference joined by ``::``, missing ones left empty."""
    return F.concat_ws("::", *(F.coalesce(p, F.lit("")) for p in parts))


def first_sentence(c: Column) -> Column:
    """Text up to the first full stop that a capital follows; the whole text if there is none."""
    s = F.regexp_extract(c, r"^(.+?\.)\s+[A-Z]", 1)
    return F.when(s == "", c).otherwise(s)


def review_label(c: Column) -> Column:
    """A label as reviewers' decisions are keyed: lower case, ``%``, commas and apostrophes kept, nothing spelled out."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "&", " and "), r"[_./()\\-]+", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def evidence_label(c: Column) -> Column:
    """A label as evidence is keyed: letters and digits only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "), r"\s+", " "))


def plain_file_name(c: Column) -> Column:
    """A file name with spaces for underscores, dashes and dots."""
    return F.translate(F.lower(c), "_-.", "   ")


def ignorable_label(c: Column) -> Column:
    """Whether a label is only a number, a note or a page mark."""
    s = F.trim(F.lower(c))
    return s.rlike(r"^\d+$") | s.rlike(r"^(?:note |notes|see accompanying|page |continued)")


def shown_amount(c: Column) -> Column:
    """An amount as ``$1,234``, a negative as ``-$1,234``."""
    return F.concat(F.when(c < 0, F.lit("-$")).otherwise(F.lit("$")), F.format_number(F.abs(c), 0))


def shown_percent(c: Column) -> Column:
    """A percentage as ``12.5%``."""
    return F.concat(F.format_number(c, 1), F.lit("%"))
