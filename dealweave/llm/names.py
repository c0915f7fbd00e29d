"""Variant spellings of names typed by people, linked by a pigeonhole segment join.

A name is read into a key (its words in full and in order, without decoration), a guard (what tells relatives apart:
unit, region, tranche, series) and a style. Keys within a few edits of each other are found by cutting a key into k+1
segments, of which at least one must stand unchanged, a little shifted at most, in the other spelling: segments of one side
are the inverted index, position-shifted substrings of the other side are looked up in it, and what meets is verified with
banded edit distance, word by word. Shortened names (initials, acronyms, abbreviated, cut off or skipped words) are looked
up in the same index among the forms that full names can shrink to, and count only if they can mean one name of their group.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import checkpointed
from .edit import within

#: Segments of a text. One edit or swap touches two neighbours at most, so with three one stays whole; two edits leave one.
SEGMENTS = 3
#: Keys and words from this length on may differ by two edits, shorter ones by one edit or swap; keys and words of
#: one or two letters by none.
TWO_EDITS_FROM = 12

#: Names of a group that are compared in one task, in memory; a group with more is joined on its codes by the cluster.
GROUP_IN_MEMORY = 4096

#: Lengths of prefixes under which names are listed, so that only names alike that far are compared.
PREFIXES = (3, 6, 9, 13, 18, 25, 35, 50, 70, 100, 150, 250)

LEGAL = frozenset("inc llc corp corporation co company ltd limited lp llp plc gmbh incorporated".split())
REGIONS = frozenset("east west south north coastal midland inland upper lower northern southern eastern".split())
#: Words of firm names and how they are shortened.
SHORT = {
    "dist": "district", "svcs": "services", "refrig": "refrigeration", "constr": "construction", "distr": "distribution", "sply": "supply", "mfg": "manufacturing",
    "pkg": "packaging", "ptnrs": "partners", "engg": "engineering", "eng": "engineering", "logist": "logistics", "fab": "fabrication", "facs": "facilities",
    "mgmt": "management", "sys": "system", "w": "western", "labs": "laboratories", "ntwk": "network", "auth": "authority", "indl": "industrial", "contr": "contractors",
    "sr": "senior", "prec": "precision", "intl": "international", "ctr": "center", "comm": "community", "vet": "veterinary", "hlth": "health", "n": "north", "vly": "valley",
    "transp": "transportation", "mech": "mechanical", "prop": "property", "med": "medical", "univ": "university", "ctrl": "central", "hosp": "hospital", "env": "environmental",
    "cnty": "county", "e": "east", "s": "south",
}
#: Short forms of given names.
NICKNAMES = {
    "ted": "theodore", "bob": "robert", "dot": "dorothy", "tony": "anthony", "kate": "katherine", "jen": "jennifer", "jim": "james", "peggy": "margaret", "sue": "susannah",
    "dick": "richard", "trish": "patricia", "mike": "michael", "ned": "edward", "sasha": "alexander", "nell": "eleanor", "bill": "william", "liz": "elizabeth", "chuck": "charles",
}

_NOISE = re.compile(r"\(main acct\)|#\s*\d+|-\s*ap dept\b|\blegacy contract\b|\(cont\.?\)")
_ACRONYM = re.compile(r"[A-Z]{2,6}")


_BREAKS, _MARKS = re.compile(r"[\s,;/()\[\]\"]+|(?<=\s)-+(?=\s)"), str.maketrans("", "", "'’.")
_DECORATION = re.compile(r"(?i)\blegacy contract\b|\(main acct\)|#\s*\d+|-\s*ap dept\b")


def _words(text: str) -> list[str]:
    if "." in text or "'" in text or "’" in text:
        text = text.translate(_MARKS)
    return [w for w in _BREAKS.split(text) if w and w != "-"]


def _one_line(raw: str) -> str:
    return " ".join((raw if raw.isascii() else unicodedata.normalize("NFKC", raw)).split())


def read_firm_or_person(raw: str) -> tuple[str, str, str]:
    """Key, guard and style (full, initial, acronym) of a firm's or person's name."""
    plain = _one_line(raw)
    s = " ".join(_NOISE.sub(" ", plain.lower()).split()).strip(" -,")
    if _ACRONYM.match(plain) and _ACRONYM.fullmatch(short := _DECORATION.sub("", plain).strip(" -,.")):
        return short.lower(), "", "acronym"
    parts = [w for w in (_words(p) for p in s.split(",")) if w]
    strip = lambda ws: ws[: next((i for i in range(len(ws), 0, -1) if ws[i - 1] not in LEGAL and not (ws[i - 1] == "c" and i > 2)), 0)]
    parts = [p for p in (strip(p) for p in parts) if p]
    if not parts:
        return "", "", "full"
    words = parts[0] if len(parts) == 1 else parts[1][:1] + parts[0] + parts[1][1:] + [w for p in parts[2:] for w in p]
    if words[0] == "the" and len(words) > 1:
        words = words[1:]
    words = strip([NICKNAMES.get(w, w) for w in words]) or words
    guard = []
    for i in range(len(words) - 1, 0, -1):
        if words[i].isdigit() and words[i - 1] == "unit":
            guard.append(f"unit {int(words[i])}")
            words = strip(words[: i - 1] + words[i + 1 :])
            break
    initial = len(words) > 1 and len(words[0]) == 1
    if len(words) > 2 and SHORT.get(words[-1], words[-1]) in REGIONS:
        guard.append(SHORT.get(words[-1], words[-1]))
        words = words[:-1]
    words = words[:1] + [SHORT.get(w, w) for w in words[1:]]
    return " ".join(words), " ".join(guard), "initial" if initial else "full"


#: Words of instrument names and how they are shortened or said otherwise.
DEBT_SHORT = {
    "sr": "senior", "snr": "senior", "ln": "loan", "tl": "term loan", "nt": "note", "nts": "note", "notes": "note", "debt": "note", "mtg": "mortgage", "mtge": "mortgage",
    "re": "real estate", "est": "estate", "rev": "revolving", "fac": "facility", "rcf": "revolving facility", "revolver": "revolving facility", "ddtl": "delayed draw term loan",
    "del": "delayed", "sub": "subordinated", "subord": "subordinated", "prom": "promissory", "pnote": "promissory note", "acq": "acquisition", "acquis": "acquisition", "veh": "vehicle",
    "fin": "finance", "equip": "equipment", "eqpt": "equipment", "mezz": "mezzanine", "sharehldr": "shareholder", "sh": "shareholder", "loc": "line", "sellers": "seller", "vendor": "seller",
}
#: Words that say what kind of loan it is; all others that are no fillers name the lender.
DEBT_WORDS = frozenset(
    "senior junior subordinated mezzanine unsecured term loan note bond promissory shareholder seller convertible acquisition bridge construction real estate mortgage"
    " equipment vehicle lease line revolving facility delayed draw working overdraft".split()
)
BANK_WORDS = frozenset("bank capital finance financial lending partners trust".split())
#: Words that tell no kinds of loans and no lenders apart.
DEBT_FILLERS = BANK_WORDS | frozenset("credit union from of to for and carry secured fleet the".split())


class SegmentIndex:
    """Pigeonhole inverted index of a few reference strings: what is within one edit or swap of a string."""

    def __init__(self, strings: list[str]):
        self.index: dict[tuple[int, int, str], list[str]] = defaultdict(list)
        for s in strings:
            for i, (a, b) in enumerate(cuts(len(s))):
                self.index[len(s), i, s[a:b]].append(s)

    def near(self, s: str) -> list[str]:
        found = set()
        for n in (len(s) - 1, len(s), len(s) + 1):
            if n < SEGMENTS:
                continue
            for i, (a, b) in enumerate(cuts(n)):
                for shift in sorted({0, len(s) - n}):
                    if a + shift >= 0:
                        found.update(self.index.get((n, i, s[a + shift : b + shift]), ()))
        return sorted(x for x in found if within(s, x, 1) <= 1)


@lru_cache(maxsize=4096)
def cuts(n: int, segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """Where a text of ``n`` characters is cut into even segments."""
    at = [n * i // segments for i in range(segments + 1)]
    return list(zip(at, at[1:]))


_DEBT_NEAR = SegmentIndex(sorted(DEBT_WORDS | DEBT_FILLERS))


@lru_cache(maxsize=65_536)
def _debt_word(w: str) -> str:
    """The word of the vocabulary that ``w`` is or, from five letters on, is mistyped for; else ``w``."""
    if w in DEBT_WORDS or w in DEBT_FILLERS or len(w) < 5:
        return w
    near = _DEBT_NEAR.near(w) if len(w) < 40 else []
    return near[0] if len(near) == 1 else w


def _instrument(raw: str) -> tuple[str, str, str]:
    """Kind (its words in one order), guard and lender of a debt instrument's name."""
    s = _one_line(raw).lower()
    s = s.replace("t/l", "tl").replace("r/e", "re").replace("s/h", "sh").replace("p-note", "pnote")
    words = [x for w in _words(_NOISE.sub(" ", s).replace("-", " ")) for x in DEBT_SHORT.get(w, w).split()]
    guard = sorted(w for w in words if w.isdigit() or (len(w) == 1 and w.isalpha()))
    # what stands before a bank or alone in brackets is a lender's name, however like another word
    union = lambda i: len(words) > i + 1 and _debt_word(words[i]) == "credit" and _debt_word(words[i + 1]) == "union"
    bank = lambda i: len(words) > i and _debt_word(words[i]) in BANK_WORDS and len(words) != i + 2
    named = {w for i, w in enumerate(words) if union(i + 1) or bank(i + 1)} | set(re.findall(r"\(\s*([^\s()]+)\s*\)", s))
    words = [x for w in words if w not in guard for x in (w if w in named else DEBT_SHORT.get(_debt_word(w), _debt_word(w))).split()]
    kind = sorted({w for w in words if w in DEBT_WORDS})
    if "bridge" in kind:  # a bridge loan is one whether or not it is called a loan or an acquisition's
        kind = sorted({*kind, "acquisition", "loan"})
    lender = " ".join(w for w in words if w not in DEBT_WORDS and w not in DEBT_FILLERS)
    return (" ".join(kind), " ".join(guard), lender) if kind else (lender, " ".join(guard), "")


def read_instrument(raw: str) -> tuple[str, str, str]:
    """Key (the kind of loan), guard (tranche, series or number) and style of a debt instrument's name."""
    kind, guard, _ = _instrument(raw)
    return kind, guard, "full"


READERS: dict[str, Callable[[str], tuple[str, str, str]]] = {"firm": read_firm_or_person, "instrument": read_instrument}


def _read(reader: str, raw: str) -> tuple[str, str, str, str]:
    """Key, guard, style and lender of a name; the lender is "" for other names than those of instruments."""
    if reader == "instrument":
        kind, guard, lender = _instrument(raw)
        return kind, guard, "full", lender
    return *READERS[reader](raw), ""


def _hash(*parts: object) -> int:
    """64-bit hash as a signed number."""
    h = xxhash.xxh64_intdigest("\x1f".join(map(str, parts)))
    return h - (1 << 64) if h >> 63 else h


def word_changes(x: str, y: str) -> list[tuple[str, str]] | None:
    """The words in which two keys differ, if few edits tell the keys apart; None if more do.

    One edit or swap, two edits from ``TWO_EDITS_FROM`` letters on, of the key for two words and of the word for one; none in
    a key or word of one or two letters; digits must be the same. Keys that differ only in where words are parted have no such words.
    """
    k = 2 if min(len(x), len(y)) >= TWO_EDITS_FROM else 1
    if abs(len(x) - len(y)) > k or min(len(x), len(y)) < SEGMENTS:
        return None
    p, q = x.split(" "), y.split(" ")
    if len(p) != len(q):
        return [] if x.replace(" ", "") == y.replace(" ", "") and within(x, y, k) <= k else None
    odd = [(u, v) for u, v in zip(p, q) if u != v]
    if len(odd) > k:
        return None
    left = k
    for u, v in odd:
        short = min(len(u), len(v))
        if short < 3 or re.sub(r"\D", "", u) != re.sub(r"\D", "", v):
            return None
        most = left if short >= TWO_EDITS_FROM else min(left, 1)
        d = within(u, v, most)
        if d > most:
            return None
        left -= d
    return odd


def abbreviates(short: str, long: str) -> bool:
    """Whether ``short`` is ``long`` with letters left out, the first kept."""
    if not short or len(short) >= len(long) or short[0] != long[0]:
        return False
    rest = iter(long)
    return all(c in rest for c in short)


def word_shortenings(x: str, y: str) -> list[tuple[str, str]] | None:
    """The words in which two keys of as many words and one first word differ, if each pair is a word and its abbreviation.

    A key that is the other cut off is left to the cut names.
    """
    p, q = x.split(" "), y.split(" ")
    odd = [(u, v) for u, v in zip(p, q) if u != v]
    if len(p) != len(q) or not odd or (len(odd) == 1 and (x.startswith(y) or y.startswith(x))):
        return None
    return odd if all(abbreviates(u, v) or abbreviates(v, u) for u, v in odd) else None


def _typo_codes(key: str, guard: str, offer: bool, picked: int = 1) -> Iterator[tuple]:
    """Codes of the segments of a key, or of the substrings to look up, for two edits.

    ``picked`` segments go into a code: with one, a key is cut into three; with two, into four, of which two edits leave two.
    """
    parts, size = SEGMENTS + picked - 1, len(key)
    for n in (size,) if offer else (size, size - 1, size - 2):
        if n < parts:
            continue
        more = size - n  # how much longer the key is than the one it is looked up for
        slack = (2 - more) // 2
        shifts = (0,) if offer else range(-slack, more + slack + 1)
        at = list(enumerate(cuts(n, parts)))
        for a in range(parts):
            for b in range(a + 1, parts) if picked == 2 else (a,):
                for moved in product(shifts, repeat=picked):
                    texts = tuple(key[x + d : y + d] for (_, (x, y)), d in zip((at[a], at[b]), moved) if x + d >= 0)
                    if len(texts) == picked:
                        yield ("t", guard, n, a, b, *texts)


def _near_segments(nodes: dict[int, tuple[str, str, str]]) -> Iterator[tuple[int, int]]:
    """Pairs of full names of a group and guard that share a segment: ``_typo_codes`` in a dictionary of each length there is."""
    guards: dict[str, dict[int, list[tuple[int, str]]]] = defaultdict(lambda: defaultdict(list))
    for i, (key, guard, style) in nodes.items():
        if style == "full":
            guards[guard][len(key)].append((i, key))
    for sizes in guards.values():
        listed = {n: names for n, names in sizes.items() if n >= SEGMENTS and (len(names) > 1 or n + 1 in sizes or n + 2 in sizes)}
        index: dict[tuple[int, int], dict[str, list[int]]] = {}
        for n, names in listed.items():
            for at, (x, y) in enumerate(cuts(n)):
                texts = index[n, at] = defaultdict(list)
                for i, key in names:
                    texts[key[x:y]].append(i)
        for size, names in sizes.items():
            for n in (size, size - 1, size - 2):
                if n not in listed:
                    continue
                more = size - n
                slack = (2 - more) // 2
                for at, (x, y) in enumerate(cuts(n)):
                    texts = index[n, at]
                    for d in range(max(-slack, -x), more + slack + 1):
                        for i, key in names:
                            for j in texts.get(key[x + d : y + d], ()):
                                if i != j:
                                    yield i, j


def _codes(key: str, guard: str, style: str, offer: bool, picked: int = 0) -> Iterator[tuple]:
    """Codes under which a name is listed (``offer``) or looked up: its segments, ``picked`` to a code, and the forms it has
    shrunk from or to."""
    words = key.split(" ")
    n = len(words)
    if style == "full":
        if picked:
            yield from _typo_codes(key, guard, offer, picked)
        if n > 1:
            initials = "".join(w[:1] for w in words)
            yield "b", guard, initials, words[0]
        if offer and n > 1:
            yield "s", guard, " ".join([words[1], words[0], *words[2:]])
            yield "i", " ".join([words[0][:1], *words[1:]])
            yield "a", initials
            if guard.isalpha():
                yield "a", initials + guard[0]
            if n > 2:
                yield "h", f"{words[0]} {words[-1]}"
            for k in PREFIXES:
                if k < len(key):
                    yield "c", k, key[:k]
        elif not offer:
            yield "s", guard, key
            if n == 2:
                yield "h", key
            if n > 1:
                k = max(k for k in PREFIXES if k <= len(key))
                yield "c", k, key[:k]
    elif not offer:
        yield style[0], key


def _verified(kind: str, x: tuple[str, str], y: tuple[str, str]) -> tuple[bool, list[tuple[str, str]]] | None:
    """Whether key and guard ``x``, looked up, and ``y``, listed under one code of this kind, belong together: whether
    guards agree, and the words that would have to be the same."""
    (kx, gx), (ky, gy) = x, y
    if kind in "tb":
        words = word_changes(kx, ky) if kind == "t" else word_shortenings(kx, ky)
        return None if words is None else (True, words)
    if kind == "c" and not (len(ky) > len(kx) and ky.startswith(kx)):
        return None
    return (gx == gy, []) if gx in (gy, "") else None


#: Which kinds of codes link equals, and which link a shortened name to a full one.
_EQUALS = "tbs"
_FOUND = "kind string, a bigint, b bigint, same boolean, words array<struct<x:string,y:string>>, word string, n bigint"
_FOUND_ARROW = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("x", pa.string()), ("y", pa.string())])), pa.string(), pa.int64()]


def meet(nodes: dict[int, tuple[str, str, str]]) -> Iterator[tuple[str, int, int, bool, list[tuple[str, str]]]]:
    """``(kind, a, b, same, words)`` of all nodes (key, guard, style) of one group that may belong together; for shortened
    names ``a`` is the short one."""
    if len(nodes) < 2:
        return
    typed = set()
    for i, j in _near_segments(nodes):
        pair = (i, j) if i < j else (j, i)
        if pair not in typed:
            typed.add(pair)
            if (words := word_changes(nodes[i][0], nodes[j][0])) is not None:
                yield "t", *pair, True, words
    index: dict[tuple, list[int]] = defaultdict(list)
    for i, (key, guard, style) in nodes.items():
        for code in _codes(key, guard, style, True):
            index[code].append(i)
    for i, (key, guard, style) in nodes.items():
        seen = set()
        for code in _codes(key, guard, style, False):
            for j in index.get(code, ()):
                kind = code[0]
                if i == j or (kind, j) in seen:
                    continue
                seen.add((kind, j))
                if (found := _verified(kind, (key, guard), nodes[j][:2])) is not None:
                    yield kind, i, j, *found


def _found_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_FOUND_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FOUND_ARROW)], names=[f.split(" ")[0] for f in _FOUND.split(", ")])


def _found_in_memory(nodes: DataFrame) -> DataFrame:
    """What meets in each group, with the words of the nodes counted; a group is compared in one task, which holds it alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        words: Counter[str] = Counter()
        now, group = None, {}

        def close() -> None:
            rows.extend((kind, a, b, same, [{"x": x, "y": y} for x, y in w], None, None) for kind, a, b, same, w in meet(group))
            for key, _, style in group.values():
                if style == "full":
                    words.update(set(key.split(" ")))

        for batch in batches:
            for grp, node, *reading in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if grp != now:
                    close()
                    now, group = grp, {}
                group[node] = tuple(reading)
            if len(rows) > 20_000:
                yield _found_batch(rows)
                rows.clear()
            if len(words) > 200_000:
                rows.extend(("w", None, None, None, None, w, n) for w, n in words.items())
                words.clear()
        close()
        rows.extend(("w", None, None, None, None, w, n) for w, n in words.items())
        yield _found_batch(rows)

    placed = nodes.repartition("grp").sortWithinPartitions("grp")
    return placed.select("grp", "node", "key", "guard", "style").mapInArrow(run, _FOUND)


def _found_by_join(nodes: DataFrame) -> DataFrame:
    """The same for groups of any size: codes are joined by the cluster, with two segments to a code, and pairs verified."""
    nodes = nodes.groupBy("node").agg(*(F.first(c).alias(c) for c in ("grp", "key", "guard", "style")))

    def listed(offer: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                code, kinds, at = [], [], []
                for i, (grp, key, guard, style) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 5)))):
                    for c in set(_codes(key, guard, style, offer, 2)):
                        code.append(_hash(grp, *c))
                        kinds.append(c[0])
                        at.append(i)
                where = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(kinds, pa.string()), *(batch.column(k).take(where) for k in (0, 2, 3))], names=["code", "kind", "node", "key", "guard"])

        return nodes.select("node", "grp", "key", "guard", "style").mapInArrow(run, "code bigint, kind string, node bigint, key string, guard string")

    asked, offered = listed(False), listed(True)
    met = asked.hint("merge").join(offered.toDF("code", "kind", "node_b", "key_b", "guard_b"), ["code", "kind"]).filter("node != node_b").dropDuplicates(["kind", "node", "node_b"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, a, kx, gx, b, ky, gy in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if (found := _verified(kind, (kx, gx), (ky, gy))) is not None:
                    rows.append((kind, a, b, found[0], [{"x": x, "y": y} for x, y in found[1]], None, None))
            yield _found_batch(rows)

    found = met.select("kind", "node", "key", "guard", "node_b", "key_b", "guard_b").mapInArrow(check, _FOUND)
    words = nodes.filter("style = 'full'").select(F.explode(F.array_distinct(F.split("key", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("a", "bigint"), ("b", "bigint"), ("same", "boolean"), ("words", "array<struct<x:string,y:string>>"))]
    return found.unionByName(words.select(F.lit("w").alias("kind"), *empty, "word", "n"))


def _parsed(names: DataFrame) -> DataFrame:
    """Adds key, guard, style and lender to distinct names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_read(r, s) for r, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([g[i] for g in got], pa.string()) for i in range(4))], names=["name", "grp", "key", "guard", "style", "lender"])

    return names.select("name", "grp", "reader", "raw").mapInArrow(run, "name bigint, grp bigint, key string, guard string, style string, lender string")


#: Share of two like words that the rarer has at most if it is the other mistyped, and the deviations of proof otherwise.
TYPO_SHARE, PROOF = 1 / 6, 2.0


def _may_be_mistyped(na: Column, nb: Column) -> Column:
    """Whether the rarer of two words may be the other mistyped: the lower bound (Wilson) of its share of both is small.

    So two words are only told apart by proof that both are established, at any size of the corpus.
    """
    n, p = na + nb, F.least(na, nb) / (na + nb)
    z2 = PROOF * PROOF
    low = (p + z2 / (2 * n) - PROOF * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    return low < TYPO_SHARE


def _accepted(found: DataFrame) -> DataFrame:
    """``a, b``: links between equals whose differing words may all be one word mistyped or abbreviated."""
    links = found.filter(F.col("kind").isin(*_EQUALS)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "words", F.col("kind") == "t")
    links = links.toDF("a", "b", "words", "typed")
    plain = links.filter(~F.col("typed") | (F.size("words") == 0)).select("a", "b")
    odd = links.filter(F.col("typed")).select("a", "b", F.explode("words").alias("w")).select("a", "b", F.least("w.x", "w.y").alias("x"), F.greatest("w.x", "w.y").alias("y"))
    n = found.filter("kind = 'w'").groupBy("word").agg(F.sum("n").alias("n"))
    pairs = odd.select("x", "y").distinct().hint("merge").join(n.toDF("x", "nx"), "x").hint("merge").join(n.toDF("y", "ny"), "y")
    good = pairs.filter(_may_be_mistyped(F.col("nx"), F.col("ny"))).select("x", "y", F.lit(1).alias("good"))
    judged = odd.hint("merge").join(good, ["x", "y"], "left").groupBy("a", "b").agg(F.count_if(F.col("good").isNull()).alias("bad")).filter("bad = 0")
    return plain.unionByName(judged.select("a", "b")).distinct()


def link_names(df: DataFrame, *, id_col: str, group_col: str, name_col: str, reader: str | Column = "firm", nobody: Column | None = None, in_memory: int = GROUP_IN_MEMORY) -> DataFrame:
    """``<id_col>, name, entity``: every row that names somebody, with hashes of its name and of the entity that the name
    means in its group.

    ``reader`` says how names are read: ``firm`` (firms and persons), ``instrument``, or a column of these.

    Defined results: rows with a null or blank name or a null group, and rows that ``nobody`` marks, name nobody and give
    no row; equal names of a group are one entity; a shortened name that could mean several is an entity of its own, and so
    is a loan without a lender beside loans of one kind from several lenders; repeated rows are kept each; very long names
    are compared whole; an empty table gives an empty result; other columns are ignored, whatever their names.

    Plan: rows are reduced to distinct names per group before anything else (partial aggregation, so a group or name with
    a third of all rows arrives small). Groups of at most ``in_memory`` names are compared in one task each, which gives
    only verified links; the codes of larger groups are joined by the cluster, with the same result. What follows works
    on links, which are few, and all joins whose two sides grow are sort-merge joins.
    """
    kind = reader if isinstance(reader, Column) else F.lit(reader)
    rows = df.select(F.col(id_col).alias("__id"), F.xxhash64(kind, F.col(group_col)).alias("grp"), kind.alias("reader"), F.col(name_col).alias("raw"), F.coalesce(nobody if nobody is not None else F.lit(False), F.lit(False)).alias("nobody"), F.col(group_col).isNotNull().alias("grouped"))
    rows = rows.filter(F.col("grouped") & F.col("raw").rlike(r"\S") & ~F.col("nobody")).select("__id", "grp", "reader", "raw", F.xxhash64("grp", "raw").alias("name"))
    node = F.when(F.col("key") != "", F.xxhash64("grp", "guard", "style", "key")).otherwise(F.col("name"))
    lent = F.when(F.col("lender") != "", F.xxhash64("grp", "guard", "key", F.lit("lender"), "lender"))
    parsed = _parsed(rows.groupBy("name").agg(F.first("grp").alias("grp"), F.first("reader").alias("reader"), F.first("raw").alias("raw")))
    names = checkpointed(parsed.withColumn("node", node).withColumn("lent", lent))
    # lenders are names too, in groups of their own: one group, guard and kind of loan
    both = F.array(F.struct("node", "key", "guard", "style"), F.struct(F.col("lent").alias("node"), F.col("lender").alias("key"), F.concat_ws("|", F.lit("lender"), "guard", "key").alias("guard"), F.lit("full").alias("style")))
    nodes = names.filter("key != ''").select("grp", F.explode(both).alias("x")).select("grp", "x.*").filter("node is not null")
    large = names.groupBy("grp").agg(F.count("*").alias("size")).filter(F.col("size") > in_memory).select("grp")
    if large.limit(1).count():
        large = checkpointed(large)
        found = _found_in_memory(nodes.hint("merge").join(large, "grp", "left_anti")).unionByName(_found_by_join(nodes.hint("merge").join(large, "grp", "left_semi")))
    else:
        found = _found_in_memory(nodes)
    found = checkpointed(found)
    labels = components(_accepted(found))
    meant = found.filter(~F.col("kind").isin(*_EQUALS, "w")).select(F.col("a").alias("part"), F.col("b").alias("full"), "same").groupBy("part", "full").agg(F.max("same").alias("same"))
    # a shortened name joins the one entity it can mean: guards that agree go first, then names that are no shorter form themselves
    comp_of = labels.hint("merge")
    meant = meant.join(comp_of.toDF("full", "comp"), "full", "left").select("part", "full", "same", F.coalesce("comp", "full").alias("comp"))
    short = meant.select(F.col("part").alias("full")).distinct().withColumn("short", F.lit(1))
    level = F.when(F.col("same"), 0).otherwise(2) + F.coalesce("short", F.lit(0))
    best = meant.hint("merge").join(short, "full", "left").groupBy("part", level.alias("level")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    best = best.groupBy("part").agg(F.min_by(F.struct("lo", "hi"), "level").alias("c")).filter("c.lo = c.hi").select(F.col("part").alias("node"), F.col("c.lo").alias("to"))
    # what is a spelling of a shortened name goes where it goes, if all shortened spellings go to one place
    moved = best.hint("merge").join(labels, "node", "left").groupBy(F.coalesce("comp", "node").alias("entity")).agg(F.min("to").alias("to"), F.max("to").alias("hi"))
    moved = checkpointed(moved.filter("to = hi and to != entity").select("entity", "to"))
    entity = names.select("name", "node", "lent").hint("merge").join(labels, "node", "left").select("name", "lent", F.coalesce("comp", "node").alias("entity"))
    for step in ("to", "next"):  # what a shortened name joins may have joined something itself
        entity = entity.hint("merge").join(moved.toDF("entity", step), "entity", "left").select("name", "lent", F.coalesce(step, "entity").alias("entity"))
    entity = _told_apart(entity, labels)
    return rows.select("__id", "name").hint("merge").join(entity, "name").select(F.col("__id").alias(id_col), "name", "entity")


def _told_apart(entity: DataFrame, labels: DataFrame) -> DataFrame:
    """Entities whose names come from several lenders, one for each lender and one for the names without."""
    lent = entity.filter("lent is not null").hint("merge").join(labels.toDF("lent", "comp"), "lent", "left").select("name", "entity", F.coalesce("comp", "lent").alias("lender"))
    several = lent.groupBy("entity").agg(F.min("lender").alias("lo"), F.max("lender").alias("hi")).filter("lo != hi").select("entity", F.lit(1).alias("several"))
    lenders = lent.hint("merge").join(several, "entity").select("name", F.xxhash64("entity", "lender").alias("own"))
    out = entity.hint("merge").join(several, "entity", "left").hint("merge").join(lenders, "name", "left")
    return out.select("name", F.when(F.col("several") == 1, F.coalesce("own", F.xxhash64("entity", F.lit("no lender")))).otherwise(F.col("entity")).alias("entity"))


def variant_pairs(linked: DataFrame, id_col: str, keep: list[str] | None = None) -> DataFrame:
    """``<id_col>_a, <id_col>_b``: rows that name one entity in strings that are not equal, a < b; ``keep`` goes along."""
    keep = keep or []
    linked = checkpointed(linked)
    several = linked.groupBy("entity").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).filter("lo != hi").select("entity")
    rows = linked.hint("merge").join(several, "entity")
    a = rows.select("entity", *keep, F.col(id_col).alias(f"{id_col}_a"), F.col("name").alias("na"))
    b = rows.select("entity", F.col(id_col).alias(f"{id_col}_b"), F.col("name").alias("nb"))
    return a.hint("merge").join(b.hint("merge"), "entity").filter((F.col(f"{id_col}_a") < F.col(f"{id_col}_b")) & (F.col("na") != F.col("nb"))).select(*keep, f"{id_col}_a", f"{id_col}_b")
