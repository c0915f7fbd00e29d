"""One form for texts that look the same but differ in their characters, and what the repair is made of."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Letters of other scripts (and IPA) that look like the Latin letter at the same place.
_LIKE_LATIN = [
    ("АВЕЅІЈКМНОРСТХУԚԜҮѴӀ", "ABESIJKMHOPCTXYQWYVI"),  # Cyrillic capitals
    ("аеѕіјорсхуԁһԛԝүѵӏԍ", "aesijopcxydhqwyvlg"),  # Cyrillic small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),  # Greek capitals
    ("αικνορυϲϳ", "aikvopucj"),  # Greek small letters
    ("ՕՏԼՍ", "OSLU"),  # Armenian capitals
    ("օոսհցյզ", "onuhgjq"),  # Armenian small letters
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),  # Cherokee
    ("ɡɑ", "ga"),  # IPA
]
TO_LATIN = {a: b for other, latin in _LIKE_LATIN for a, b in zip(other, latin, strict=True)}
#: Hyphens that look like the one on the keyboard.
HYPHENS = "‐‑⁃˗﹣－−"


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for cp in [*range(0x80, 0x10000), *range(0xE0000, 0xE0200)]:
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Cf" or 0xFE00 <= cp <= 0xFE0F or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xE0100 <= cp < 0xE0200:
            table[cp] = None  # invisible
        elif kind == "Zs":
            table[cp] = " "
        elif 0xFF01 <= cp <= 0xFF5E or 0xFB00 <= cp <= 0xFB06:
            table[cp] = unicodedata.normalize("NFKC", c)  # full width, ligatures
    table |= {ord(c): "-" for c in HYPHENS}
    table |= {0x09: " ", 0x85: "\n", 0x2028: "\n", 0x2029: "\n"}
    return table


FOLD = _fold_table()
TOKEN = re.compile(r"[\w\u0300-\u036f]+")
_ASCII = re.compile(r"[\x00-\x7f]*\Z")


@lru_cache(maxsize=70_000)
def script(c: str) -> str:
    """Script of a letter (IPA extensions count as one), or "" for what belongs to none."""
    if not c.isalpha():
        return ""
    if "ɐ" <= c <= "ʯ":
        return "IPA"
    return unicodedata.name(c, "").split(" ")[0]


def fold(text: str) -> str:
    """Text without invisible characters, with one kind of space and hyphen, no full width, ligatures or split accents."""
    if _ASCII.match(text):
        return text.replace("\r\n", "\n").replace("\t", " ")
    return unicodedata.normalize("NFC", text.translate(FOLD).replace("\r\n", "\n"))


def _swap(token: str, table: dict[str, str], wanted: str) -> str | None:
    """The token in one script; None if a letter of another script has no look-alike in it."""
    out = []
    for c in unicodedata.normalize("NFD", token):
        s = script(c)
        if s and s != wanted:
            c = table.get(c)
            if c is None:
                return None
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


_TABLES = {"LATIN": TO_LATIN}
for _other, _latin in _LIKE_LATIN:
    _table = _TABLES.setdefault(script(_other[0]), {})
    for _a, _b in zip(_other, _latin):
        _table.setdefault(_b, _a)


def readings(token: str, main: str) -> list[str]:
    """Single-script readings of a token whose letters are not all of one script, or of another than the text's ``main``.

    Most frequent script of the token first (of equally frequent ones the text's), then the others, then the script of the
    text; none for a clean token.
    """
    counts = Counter(s for c in unicodedata.normalize("NFD", token) if (s := script(c)))
    if not counts or (len(counts) == 1 and main in counts):
        return []
    out = []
    for s in dict.fromkeys([*(s for s, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0] != main, x[0]))), main]):
        if s in _TABLES and (r := _swap(token, _TABLES[s], s)) is not None and r != token and r not in out:
            out.append(r)
    return out


def home_reading(token: str, main: str) -> str | None:
    """The token in the script of its text, if it can be read so."""
    return _swap(token, _TABLES[main], main) if main in _TABLES else None


_NO_LATIN = dict.fromkeys(map(ord, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def main_script(text: str) -> str:
    """The script that most letters of a text are of; Latin if it has none."""
    if text.isascii():
        return "LATIN"
    rest = text.translate(_NO_LATIN)
    counts = Counter(s for c in rest if c > "\x7f" and (s := script(c)))
    counts["LATIN"] += len(text) - len(rest)
    return max(counts, key=lambda s: (counts[s], s == "LATIN", s))


def _key(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


#: Clean words that a task holds before it passes them on; a word may be passed on more than once.
_WORDS_HELD = 200_000


def _folded(docs: DataFrame, id_type: str, with_text: bool) -> DataFrame:
    """``__id, __row, raw_key, form_key, form, __doubt`` of ``__id, __text``, and rows of ``word`` alone, from one pass.

    ``__doubt`` are the doubtful tokens with their readings in order of preference. Texts without any are finished: they
    have a ``form_key``, and the form itself only if wanted; the others carry their folded text in ``form``. ``word`` are
    the clean words of all texts.
    """
    kind = pa.list_(pa.struct([("token", pa.string()), ("readings", pa.list_(pa.string())), ("home", pa.string())]))
    types = [pa.binary(), pa.binary(), pa.binary(), pa.string(), kind, pa.string()]
    names = ["__id", "__row", "raw_key", "form_key", "form", "__doubt", "word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: set[str] = set()
        id_kind = None

        def listed() -> pa.RecordBatch:
            n = len(words)
            return pa.RecordBatch.from_arrays([pa.nulls(n, id_kind), *(pa.nulls(n, t) for t in types[:-1]), pa.array(list(words), pa.string())], names=names)

        for b in batches:
            id_kind = b.column(0).type
            rows, raws, keys, forms, doubts = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = fold(t)
                raw = _key(t)
                tokens = set(TOKEN.findall(f))
                found = []
                if f.isascii():
                    words |= tokens
                else:
                    main = main_script(f)
                    words.update(w for w in tokens if (w.isascii() and main == "LATIN") or all(s in ("", main) for s in map(script, w)))
                    found = [{"token": w, "readings": r, "home": home_reading(w, main)} for w in sorted(tokens) if not w.isascii() and (r := readings(w, main))]
                rows.append(hashlib.sha256(repr(i).encode() + raw).digest()[:16])
                raws.append(raw)
                keys.append(None if found else (raw if f is t else _key(f)))
                forms.append(f if found or with_text else None)
                doubts.append(found or None)
            columns = [pa.array(c, t) for c, t in zip((rows, raws, keys, forms, doubts), types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.nulls(len(rows), pa.string())], names=names)
            if len(words) > _WORDS_HELD:
                yield listed()
                words.clear()
        if words:
            yield listed()

    return docs.mapInArrow(run, f"__id {id_type}, __row binary, raw_key binary, form_key binary, form string, __doubt array<struct<token:string,readings:array<string>,home:string>>, word string")


def _mended(df: DataFrame, id_type: str) -> DataFrame:
    """Doubtful texts with their accepted readings put in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = []
            for text, fixes in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if fixes:
                    table = dict(fixes)
                    text = unicodedata.normalize("NFC", TOKEN.sub(lambda m: table.get(m.group(), m.group()), text))
                forms.append(text)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([_key(f) for f in forms], pa.binary()), pa.array(forms, pa.string())], names=["__id", "raw_key", "form_key", "form"]
            )

    return df.select("__id", "raw_key", "form", "__fixes").mapInArrow(run, f"__id {id_type}, raw_key binary, form_key binary, form string")


def one_form(df: DataFrame, *, id_col: str, text_col: str, with_text: bool = True) -> DataFrame:
    """``<id_col>, raw_key, form_key, form``: digests of every text that is not null and of its one form, and that form.

    Spaces, widths, ligatures, accents and invisible characters are folded everywhere. Look-alike letters are substituted
    only in tokens of mixed script (or of another script than the rest of their text), towards the token's dominant
    script first, and only if the result is a word of the corpus: it stands in a text of its own script, or tokens of two texts
    of that script read so. What is visible stays as it is: case, accents, words, digits, line breaks, the number of spaces.
    Without ``with_text`` only texts that had doubtful tokens carry their form.

    Defined results: null texts give no row; an empty text is its own form; repeated ids are kept, each with its text;
    texts of any length are processed whole; a token that no reading makes a word stays as it is; an empty table gives an
    empty result; other columns are ignored, whatever their names.

    Plan: texts are read, folded and digested once, where they lie; digests, doubtful tokens and clean words go to a shared
    checkpoint. The
    distinct readings meet the distinct words of the corpus in one join, and the accepted ones go back to their texts by
    row. No text without doubtful tokens is shuffled, and nothing is collected.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).filter("__text is not null")
    both = checkpointed(_folded(docs, id_type, with_text))
    folded, words = both.filter("word is null"), both.filter("word is not null").select("word")
    doubtful = folded.filter("__doubt is not null")
    doubt = doubtful.select("__row", F.explode("__doubt").alias("d")).select("__row", "d.token", "d.home", F.posexplode("d.readings").alias("rank", "reading"))
    home = F.when(F.col("reading") == F.col("home"), F.col("__row"))
    seen = doubt.groupBy("reading").agg(F.coalesce(F.min(home) != F.max(home), F.lit(False)).alias("twice"))
    accepted = seen.hint("merge").join(words.distinct(), F.col("reading") == F.col("word"), "left").filter("word is not null or twice").select("reading")
    fixed = doubt.hint("merge").join(accepted, "reading").groupBy("__row", "token").agg(F.min_by("reading", "rank").alias("reading"))
    fixes = fixed.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("token", "reading"))).alias("__fixes"))
    mended = _mended(doubtful.hint("merge").join(fixes, "__row", "left"), id_type)
    out = folded.filter("__doubt is null").select("__id", "raw_key", "form_key", "form").unionByName(mended)
    return out.withColumnRenamed("__id", id_col)


def same_look_pairs(forms: DataFrame, id_col: str) -> DataFrame:
    """``<id_col>_a, <id_col>_b``: rows of ``one_form`` whose texts differ while their forms are equal, a < b.

    The digests are checkpointed once for the three times they are read. Forms that only one text has are dropped before
    the join, whose skewed keys the adaptive join splits.
    """
    rows = checkpointed(forms.select(F.col(id_col).alias("id"), "raw_key", "form_key").filter("id is not null"))
    several = rows.groupBy("form_key").agg(F.min("raw_key").alias("lo"), F.max("raw_key").alias("hi")).filter("lo != hi").select("form_key")
    left = rows.hint("merge").join(several, "form_key")
    a, b = left.select("form_key", F.col("id").alias(f"{id_col}_a"), F.col("raw_key").alias("ra")), left.select("form_key", F.col("id").alias(f"{id_col}_b"), F.col("raw_key").alias("rb"))
    return a.hint("merge").join(b.hint("merge"), "form_key").filter((F.col(f"{id_col}_a") < F.col(f"{id_col}_b")) & (F.col("ra") != F.col("rb"))).select(f"{id_col}_a", f"{id_col}_b")


def same_look_classes(forms: DataFrame, id_col: str) -> DataFrame:
    """``<id_col>, class_id, n_links``: every row of ``one_form`` with the least id of its form and how many rows look the
    same in other characters; what ``same_look_pairs`` says without writing out pairs. Null ids have none."""
    rows = checkpointed(forms.select(F.col(id_col).alias("id"), "raw_key", "form_key").filter("id is not null"))
    exact = rows.groupBy("form_key", "raw_key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    classes = exact.groupBy("form_key").agg(F.sum("n").alias("all"), F.min("least").alias("class_id"))
    out = rows.hint("merge").join(exact.select("form_key", "raw_key", "n"), ["form_key", "raw_key"]).hint("merge").join(classes, "form_key")
    return out.select(F.col("id").alias(id_col), "class_id", (F.col("all") - F.col("n")).alias("n_links"))
