"""Passages of held-out evaluation items that stand in corpus documents."""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalikes import TO_LATIN

#: Words of one pattern of the automaton. Short, so that a passage with every third word changed still holds some.
SEED_WORDS = 2
#: Equal words in a row that a run needs to be chained with another: common pairs of words stand everywhere.
ANCHOR_WORDS = 3


def _plain_table() -> dict[int, str | None]:
    """For every character what it is in plain text: lower-case letters and digits without accents, else a space or nothing."""
    table: dict[int, str | None] = {}
    for cp in [*range(0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE0200)]:
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind in ("Cf", "Mn", "Me", "Cs") or 0xFE00 <= cp <= 0xFE0F:
            table[cp] = None
            continue
        s = unicodedata.normalize("NFKD", TO_LATIN.get(c, c))
        s = "".join(TO_LATIN.get(x, x) for x in s if not unicodedata.combining(x)).lower()
        if not s.isalnum():
            s = " "
        if s != c:
            table[cp] = s
    return table


_PLAIN: dict[int, str | None] = {}


def plain_words(text: str) -> list[str]:
    """Words of a text without case, accents, punctuation, layout and look-alike characters."""
    if not _PLAIN:
        _PLAIN.update(_plain_table())
    return text.translate(_PLAIN).split()


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Where each of ``plain_words(text)`` starts and ends in ``text``."""
    plain_words("")
    out, start, last = [], -1, 0
    for i, c in enumerate(text):
        for x in _PLAIN.get(ord(c), c) or "":
            if x.isspace():
                if start >= 0:
                    out.append((start, last + 1))
                start = -1
            else:
                if start < 0:
                    start = i
                last = i
    if start >= 0:
        out.append((start, last + 1))
    return out


@dataclass(frozen=True)
class LeakRule:
    """When words in common are a leak: enough of an item's words in their order, however they are interrupted."""

    min_words: int = 18
    #: Most words of the item that may be changed or missing between two runs.
    item_gap: int = 6
    #: Most words of the text that may stand between two runs.
    text_gap: int = 30
    #: Most words of the item between two runs that neither stand in the text nor are single changed words.
    lost_words: int = 2


def held_between(item: list[str], text: list[str]) -> tuple[int, int]:
    """For the words between two runs: how many are the same in their order, and how many are single changed words.

    A changed word is single if the words on both its sides are unchanged and one word of the text stands for it.
    """
    if len(item) == 1 == len(text):
        return 0, 1
    if len(item) == len(text):
        flags = [x == y for x, y in zip(item, text)]
        single = sum(1 for i, f in enumerate(flags) if not f and (i == 0 or flags[i - 1]) and (i + 1 == len(flags) or flags[i + 1]))
        if sum(flags) + single == len(flags):
            return sum(flags), single
    row = [0] * (len(text) + 1)
    for x in item:
        last = 0
        for j, y in enumerate(text, 1):
            here = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = here
    return row[-1], 0


class LeakFinder:
    """One Aho-Corasick automaton over all runs of ``SEED_WORDS`` words of all items."""

    def __init__(self, items: list[tuple[int, str]], rule: LeakRule = LeakRule()):
        self.rule, self.words, self.auto = rule, {i: plain_words(t) for i, t in items}, ahocorasick.Automaton()
        # words are counted as they are written: "$5,285" is one, though it is compared in two parts
        self.written = {i: self._written(t, len(self.words[i])) for i, t in items}
        self.need = {i: min(rule.min_words, len(set(w))) for i, w in self.written.items()}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, w in self.words.items():
            n = min(SEED_WORDS, len(w))
            for k in range(len(w) - n + 1 if n else 0):
                places[" " + " ".join(w[k : k + n]) + " "].append((i, k))
        for pattern, at in places.items():
            self.auto.add_word(pattern, at)
        if places:
            self.auto.make_automaton()
        self.empty = not places

    @staticmethod
    def _written(text: str, n: int) -> list[int]:
        """For every compared word the number of the written word that it is part of."""
        parts = [len(plain_words(w)) for w in text.split()]
        out = [i for i, k in enumerate(parts) for _ in range(k)]
        return out if len(out) == n else list(range(n))

    def _whole(self, item: int, first: int, last: int) -> int:
        """Written words of an item that lie wholly between two compared words of it."""
        w = self.written[item]
        a, b = w[first], w[last]
        return b - a + 1 - (first > 0 and w[first - 1] == a) - (last + 1 < len(w) and w[last + 1] == b and a != b)

    def seeds(self, words: list[str]) -> dict[int, list[tuple[int, int]]]:
        """By item: (place in the text, place in the item) of every seed, in words, in the order of the text."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if self.empty or not words:
            return out
        hits = list(self.auto.iter(" " + " ".join(words) + " "))
        if not hits:
            return out
        starts, at = [], 1
        for w in words:
            starts.append(at)
            at += len(w) + 1
        for end, places in hits:
            last = bisect_right(starts, end) - 1  # the pattern's closing space follows its last word
            if starts[last] > end - 1 and last:
                last -= 1
            for item, k in places:
                n = min(SEED_WORDS, len(self.words[item]))
                out[item].append((last - n + 1, k))
        return out

    def runs(self, seeds: list[tuple[int, int]], words: list[str], item: list[str]) -> list[tuple[int, int, int, int, bool]]:
        """``(t, k, length, same, anchored)``: stretches of the text that go along the item word by word, single changed words
        in between included, with two equal words at least from one to the next; they begin and end with equal words. In the
        order of the text."""
        n, m = len(words), len(item)
        out, done = [], set()
        for t, k in seeds:
            if (t, k) in done:
                continue
            d, ends = t - k, []
            first, last = max(0, -d), min(m, n - d)  # places of the item that the text has
            for step, at in ((1, k), (-1, k)):
                row = 1 if step > 0 else 2  # equal words since the last changed one
                while True:
                    if first <= at + step < last and item[at + step] == words[at + step + d]:
                        at, row = at + step, row + 1
                    elif row > 1 and first <= at + 2 * step < last and item[at + 2 * step] == words[at + 2 * step + d]:
                        at, row = at + 2 * step, 1
                    else:
                        break
                ends.append(at)
            hi, lo = ends
            flags = [item[i] == words[i + d] for i in range(lo, hi + 1)]
            done.update((i + d, i) for i in range(lo, hi + 1))
            row = best = 0
            for f in flags:
                row = row + 1 if f else 0
                best = max(best, row)
            out.append((lo + d, lo, hi - lo + 1, sum(flags), best >= min(ANCHOR_WORDS, m)))
        return sorted(out)

    def chains(self, runs: list[tuple[int, int, int, int, bool]], words: list[str], item: list[str]) -> tuple[int, int, int, int, int, int]:
        """Best chain of an item's runs: (words held, of them unchanged, item span, first and last word in the text, last in the item)."""
        best = (0, 0, 0, 0, 0, 0)
        state: list[tuple[int, int, int, int]] = []  # words held, unchanged, first item word, first text word
        longest = max(r[2] for r in runs)
        lo = 0
        for b, (t, k, size, same, anchored) in enumerate(runs):
            top = (size, same, k, t)
            while runs[lo][0] + longest + self.rule.text_gap < t:
                lo += 1
            for a in range(b - 1, lo - 1, -1) if anchored else ():
                t0, k0, size0, _, anchored0 = runs[a]
                over = max(t0 + size0 - t, k0 + size0 - k, 0)  # words of this run that the one before has used
                if not anchored0 or over >= size:
                    continue
                dt, dk = t + over - t0 - size0, k + over - k0 - size0
                if dk > self.rule.item_gap or dt > self.rule.text_gap:
                    continue
                s = state[a]
                between, single = held_between(item[k0 + size0 : k + over], words[t0 + size0 : t + over]) if dk and dt else (0, 0)
                if dk - between - single > self.rule.lost_words:
                    continue
                cand = (s[0] + size - over + between + single, s[1] + max(same - over, 0) + between, s[2], s[3])
                if cand > top:
                    top = cand
            state.append(top)
            found = (top[0], top[1], k + size - top[2], top[3], t + size - 1, k + size - 1)
            if found > best:
                best = found
        return best

    def _may_reach(self, seeds: list[tuple[int, int]], n: int, need: int) -> bool:
        """Whether the seeds of an item can come to so many words. A seed brings its own words and a single changed one, a run
        two more at its ends; runs that are chained have seeds in a row, and what stands between them is bounded."""
        size = len(seeds)
        if size * (n + 1) + max(4, (size // 2) * (4 + self.rule.item_gap)) < need:
            return False
        along = Counter(t - k for t, k in seeds)
        if max(along.values()) * (n + 1) + 4 >= need:
            return True
        held = set(seeds)
        rows = sum((t + 1, k + 1) in held or (t - 1, k - 1) in held for t, k in seeds)
        return rows * (n + 1) + (rows // 2) * (4 + self.rule.item_gap) >= need

    def find(self, text: str, floor: int | None = None) -> list[tuple[int, int, int, int, int, int]]:
        """``(item, words, covered, span, first, last)`` of every item that leaks into ``text``, first and last in words."""
        out = []
        words = plain_words(text)
        for item, seeds in self.seeds(words).items():
            need = self.need[item] if floor is None else floor
            n = min(SEED_WORDS, len(self.words[item]))
            if not self._may_reach(seeds, n, need):
                continue
            runs = self.runs(seeds, words, self.words[item])
            held, same, span, first, last, end = self.chains(runs, words, self.words[item])
            count = self._whole(item, end - span + 1, end) - (span - held) if held else 0
            if held and count >= need:
                out.append((item, count, same, span, first, last))
        return out


@lru_cache(maxsize=4)
def _finder(items: tuple[tuple[int, str], ...], rule: LeakRule) -> LeakFinder:
    """The automaton of a list of items, built once per process."""
    return LeakFinder(list(items), rule)


def leaked_items(df: DataFrame, items: list[tuple[int, str]], *, id_col: str, text_col: str, rule: LeakRule = LeakRule()) -> DataFrame:
    """``<id_col>, item_id, n_words, start, end``: every item that leaks into a text, and where in the original text.

    A text holds an item wholly or a passage of at least ``rule.min_words`` of its words in their order; single changed
    words count as held and short interruptions do not break a passage. Items are a small fixed list.

    Defined results: null and empty texts leak nothing; null and wordless items neither; an item shorter than the rule
    must stand whole; repeated rows are reported each; texts are scanned whole, whatever their length; an empty table or
    list gives an empty result; other columns are ignored, whatever their names.

    Plan: one pass over two columns, no shuffle. The automaton is built once per Python process from the items, which the
    caller has checked to be few; a text costs one scan, and alignment only looks at the seeds found.
    """
    given = tuple((i, t) for i, t in items if t)
    docs = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).filter("__text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(given, rule)
        for b in batches:
            src, item, words, start, end = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = finder.find(t)
                if found:
                    at = word_offsets(t)
                    for f in found:
                        src.append(i)
                        item.append(f[0])
                        words.append(f[1])
                        start.append(at[f[4]][0])
                        end.append(at[f[5]][1])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(src, pa.int64())), pa.array(item, pa.int64()), pa.array(words, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                names=["__id", "item_id", "n_words", "start", "end"],
            )

    schema = f"__id {df.schema[id_col].dataType.simpleString()}, item_id bigint, n_words int, start bigint, end bigint"
    return docs.mapInArrow(run, schema).withColumnRenamed("__id", id_col)
