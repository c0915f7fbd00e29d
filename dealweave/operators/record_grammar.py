"""Rows that fail to parse: an error-recovering recursive-descent reader for delimited records.

Grammar (RFC 4180, one delimiter)::

    text    := record (NEWLINE record)*
    record  := field (DELIM field)*
    field   := quoted | bare
    quoted  := '"' (TEXTDATA | '""' | NEWLINE | DELIM)* '"'
    bare    := (any character but '"', DELIM, NEWLINE)*

A broken quote does not swallow what follows it: the reader notes the error with its offset and goes on at the next
*record-start anchor*, a line start from which a whole record of the expected width with valid values can be read. Only
such validated anchors are used, so a line break inside a well-formed quoted field never splits a record.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTING, COLUMN_COUNT, INVALID_VALUE = "quoting", "column_count", "invalid_value"

_AMOUNT = re.compile(r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?")
_NUMBER = re.compile(r"-?(?:\d+(?:\.\d*)?|\.\d+)")
_ISO = re.compile(r"(\d{4})-(\d{2})-(\d{2})")
_US = re.compile(r"(\d{1,2})/(\d{1,2})/(\d{4})")


def read_name(text: str) -> str | None:
    """A name: anything that is not blank."""
    return text.strip() or None


def read_amount(text: str) -> float | None:
    """``1234``, ``1,234.5``, either with ``$``; parentheses mean a negative."""
    s, sign = text.strip(), 1.0
    if s.startswith("$"):
        s = s[1:].strip()
    if s.startswith("(") and s.endswith(")"):
        s, sign = s[1:-1].strip(), -1.0
        if s.startswith("$"):
            s = s[1:].strip()
    return sign * float(s.replace(",", "")) if _AMOUNT.fullmatch(s) else None


def read_percent(text: str) -> float | None:
    """A number with an optional ``%``."""
    s = text.strip()
    if s.endswith("%"):
        s = s[:-1].rstrip()
    return float(s) if _NUMBER.fullmatch(s) else None


def read_date(text: str) -> dt.date | None:
    """A real day written ``YYYY-MM-DD`` or month/day/year."""
    s = text.strip()
    if m := _ISO.fullmatch(s):
        y, mo, d = map(int, m.groups())
    elif m := _US.fullmatch(s):
        mo, d, y = map(int, m.groups())
    else:
        return None
    try:
        return dt.date(y, mo, d)
    except ValueError:
        return None


_READERS: dict[str, Callable[[str], object]] = {"name": read_name, "amount": read_amount, "percent": read_percent, "date": read_date}
_ARROW = {"name": pa.string(), "amount": pa.float64(), "percent": pa.float64(), "date": pa.date32()}
_SPARK = {"name": "string", "amount": "double", "percent": "double", "date": "date"}


@dataclass(frozen=True)
class FieldSpec:
    """A column of the record: its name, its kind (name, amount, percent, date), and whether it may be empty."""

    name: str
    kind: str
    optional: bool = False


@dataclass(frozen=True)
class RecordSpec:
    """The expected record: header text, fields in order, and the prefixes of lines that hold no data."""

    header: str
    fields: tuple[FieldSpec, ...]
    note_prefixes: tuple[str, ...] = ("Note", "*")
    delimiter: str = ","


@dataclass
class Parsed:
    """One record of a text: typed values, or the first reason it is bad and the offset where that was noticed."""

    start: int
    values: list = field(default_factory=list)
    reason: str | None = None
    offset: int = -1
    field_index: int = -1


class RecordReader:
    """Recursive descent over one text; the methods are the rules of the grammar and return the next position."""

    def __init__(self, spec: RecordSpec):
        self.spec, self.readers = spec, [_READERS[f.kind] for f in spec.fields]
        d = re.escape(spec.delimiter)
        self._bare = re.compile(rf'[^"{d}\r\n]*')
        self._inner = re.compile(r'[^"]*')
        self._newline = re.compile(r"\r\n|\r|\n")

    def quoted(self, s: str, at: int) -> tuple[str, int]:
        """Reads from the opening quote; position -1 if it is never closed."""
        parts, i = [], at + 1
        while True:
            m = self._inner.match(s, i)
            parts.append(m.group())
            i = m.end()
            if i >= len(s):
                return "".join(parts), -1
            if s.startswith('"', i + 1):
                parts.append('"')
                i += 2
            else:
                return "".join(parts), i + 1

    def field(self, s: str, at: int) -> tuple[str, int, int]:
        """Text of the field, the position after it, and the offset of a quoting error or -1."""
        if s.startswith('"', at):
            text, end = self.quoted(s, at)
            if end < 0:
                return text, len(s), at
        else:
            m = self._bare.match(s, at)
            text, end = m.group(), m.end()
        if end < len(s) and s[end] != self.spec.delimiter and s[end] not in "\r\n":
            return text, end, end  # text after a closing quote, or a quote inside a bare field
        return text, end, -1

    def record(self, s: str, at: int) -> tuple[list[str], int, int]:
        """Fields, the position after the record, and the offset of the first quoting error or -1."""
        fields = []
        while True:
            text, at, bad = self.field(s, at)
            fields.append(text)
            if bad >= 0:
                return fields, at, bad
            if at < len(s) and s[at] == self.spec.delimiter:
                at += 1
                continue
            return fields, at, -1

    def typed(self, fields: list[str], out: Parsed) -> Parsed:
        """Checks the width, then each value from left to right."""
        if len(fields) != len(self.readers):
            out.reason = COLUMN_COUNT
            return out
        for i, (text, read, spec) in enumerate(zip(fields, self.readers, self.spec.fields)):
            value = None if spec.optional and not text.strip() else read(text)
            if value is None and not (spec.optional and not text.strip()):
                out.reason, out.field_index, out.values = INVALID_VALUE, i, []
                return out
            out.values.append(value)
        return out

    def anchor(self, s: str, at: int) -> int:
        """The next line start after ``at`` from which a valid record can be read; -1 if there is none."""
        for m in self._newline.finditer(s, at):
            fields, _, bad = self.record(s, m.end())
            if bad < 0 and self.typed(fields, Parsed(m.end())).reason is None:
                return m.end()
        return -1

    def text(self, s: str) -> Iterator[Parsed]:
        """All records of ``s`` in order, bad ones included."""
        at = 0
        while at <= len(s):
            fields, end, bad = self.record(s, at)
            out = Parsed(at)
            if bad >= 0:
                out.reason, out.offset = QUOTING, bad
                yield out
                at = self.anchor(s, bad)
                if at < 0:
                    return
                continue
            out = self.typed(fields, out)
            if out.reason:
                out.offset = at
            yield out
            if end >= len(s):
                return
            m = self._newline.match(s, end)
            at = m.end() if m else end + 1


def _is_header(text: Column, spec: RecordSpec) -> Column:
    """A line that is the header, whatever its case, quotes and the spaces around its fields."""
    squeeze = lambda c: F.regexp_replace(F.lower(c), r'\s*,\s*|"|^\s+|\s+$', ",")
    return F.regexp_replace(squeeze(text), ",+", ",") == F.regexp_replace(squeeze(F.lit(spec.header)), ",+", ",")


def parse_records(df: DataFrame, spec: RecordSpec, *, id_col: str, file_col: str, line_col: str, text_col: str) -> DataFrame:
    """Splits raw lines into typed records and located errors.

    One row per record read from a data line: ``<id_col>, <file_col>, record_no, reason, error_offset, error_field`` and
    one typed column per field (null in bad records). Lines up to the file's first header, repeated headers, lines of
    only delimiters or spaces, and note lines are no data and give no rows.

    Defined results: a null text is a blank line; a file without a header has only data lines; an empty table gives an
    empty result; repeated lines are parsed each on its own; extra columns of ``df`` are ignored, whatever their names;
    a null line number sorts after the header (the line counts as data); null files form one file.

    Plan: the header's place is a partially aggregated minimum per file (a few bytes per file), joined back on the file;
    the lines themselves are parsed where they lie. A file with a third of all lines is split by the adaptive skew join,
    and nothing is gathered per file.
    """
    lines = df.select(F.col(id_col).alias("__id"), F.col(file_col).alias("__file"), F.col(line_col).cast("bigint").alias("__no"), F.col(text_col).alias("__text"))
    header = _is_header(F.col("__text"), spec)
    first = lines.filter(header).groupBy("__file").agg(F.min("__no").alias("__head"))
    notes = F.lit(False)
    for p in spec.note_prefixes:
        notes = notes | F.ltrim("__text").startswith(p)
    data = (
        lines.join(first.withColumnRenamed("__file", "__hfile"), F.col("__file").eqNullSafe(F.col("__hfile")), "left")
        .filter(F.col("__text").isNotNull() & ~F.col("__text").rlike(r"^[,\s]*$") & ~notes & ~header)
        .filter(F.col("__head").isNull() | F.col("__no").isNull() | (F.col("__no") > F.col("__head")))
        .select("__id", "__file", "__text")
    )
    id_type, file_type = df.schema[id_col].dataType.simpleString(), df.schema[file_col].dataType.simpleString()
    schema = f"__id {id_type}, __file {file_type}, record_no int, reason string, error_offset int, error_field string, " + ", ".join(f"`{f.name}` {_SPARK[f.kind]}" for f in spec.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RecordReader(spec)
        for b in batches:
            src, no, reason, off, bad = [], [], [], [], []
            cols: list[list] = [[] for _ in spec.fields]
            for i, s in enumerate(b.column(2).to_pylist()):
                for k, r in enumerate(reader.text(s)):
                    src.append(i)
                    no.append(k)
                    reason.append(r.reason)
                    off.append(r.offset if r.reason else None)
                    bad.append(spec.fields[r.field_index].name if r.field_index >= 0 else None)
                    for c, v in zip(cols, r.values or [None] * len(cols)):
                        c.append(v)
            at = pa.array(src, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(no, pa.int32()), pa.array(reason, pa.string()), pa.array(off, pa.int32()), pa.array(bad, pa.string())]
                + [pa.array(c, _ARROW[f.kind]) for c, f in zip(cols, spec.fields)],
                names=["__id", "__file", "record_no", "reason", "error_offset", "error_field"] + [f.name for f in spec.fields],
            )

    return data.mapInArrow(run, schema).withColumnsRenamed({"__id": id_col, "__file": file_col})


def bad_records(parsed: DataFrame, id_col: str) -> DataFrame:
    """One row per line with a bad record: its id and the reason of its first bad record."""
    return parsed.filter(F.col("reason").isNotNull()).groupBy(id_col).agg(F.min_by("reason", "record_no").alias("reason"))


DEBT_RECORD = RecordSpec(
    "Facility,Outstanding,Rate,Maturity,Annual P&I",
    (FieldSpec("facility", "name"), FieldSpec("outstanding", "amount"), FieldSpec("rate", "percent"), FieldSpec("maturity", "date"), FieldSpec("annual_pi", "amount", optional=True)),
)
REVENUE_RECORD = RecordSpec("Customer / Account,Revenue,% Mix", (FieldSpec("customer", "name"), FieldSpec("revenue", "amount"), FieldSpec("mix", "percent")))
