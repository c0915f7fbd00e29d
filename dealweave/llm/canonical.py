"""Free-entered labels mapped to the entry of a reference list that they mean, or reported as unmatched."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edit import Trie, within

#: Other wordings of balance sheet lines that their labels do not give away, by the label they mean: a table of the caller,
#: here the usual synonyms of accounting.
ALIASES: dict[str, tuple[str, ...]] = {
    "Cash": ("cash & equiv", "cash in bank", "cash and cash equivalents", "bank balances", "csh & equivs", "operating acct + petty cash"),
    "Short-Term Investments": ("st investments", "marketable securities", "s/t invstmts", "s/t investments"),
    "Accounts Receivable": ("a/r trade", "ar - net", "trade debtors", "customer receivables", "trade receivables"),
    "Allowance for Doubtful Accounts": ("afda", "bad debt reserve", "reserve for doubtful accts", "allow. for uncollectibles"),
    "Inventory": ("invty - net", "inv. (fifo)", "stock on hand", "parts & materials on hand", "inventories", "invent."),
    "Prepaid Expenses": ("pre-paid exp.", "prepaids", "expenses paid in advance", "prepaid ins & rent"),
    "Contract Assets": ("costs in excess of billings", "unbilled revenue", "contract asset (wip)", "underbillings"),
    "Notes Receivable": ("promissory notes receivable",),
    "Total Current Assets": ("sum of current assets",),
    "Property, Plant and Equipment": ("pp and e net", "pp&e", "net pp&e", "plant, property & equip", "fixed assets (net)"),
    "Accumulated Depreciation": ("depreciation to date", "less: accumulated depn"),
    "Goodwill": ("gw (acquisitions)", "goodwill - net of impairment", "purchased goodwill"),
    "Intangible Assets": ("customer lists & trademarks", "intang. assets net", "other intangibles", "intangibles"),
    "Right-of-Use Assets": ("right of use (asc 842)", "lease rou - net", "rou assets", "operating lease asset"),
    "Deferred Tax Assets": ("deferred income taxes (asset)",),
    "Total Assets": ("sum total of assets",),
    "Accounts Payable": ("a/p trade", "trade payables", "vendor payables", "trade creditors", "a/p"),
    "Accrued Expenses": ("accrued exp. - other", "accruals", "accrued liabs"),
    "Accrued Payroll": ("salaries accrued", "accrued wages & pto", "wages payable", "payroll liabs"),
    "Deferred Revenue": ("unearned revenue", "billings in excess of costs", "contract liabilities"),
    "Customer Deposits": ("retainers held", "client prepayments", "deposits from customers"),
    "Sales Tax Payable": ("state sales tax owed", "sales taxes due", "s/t payable (sales tax)", "sales tax liability"),
    "Income Taxes Payable": ("income tax due", "taxes on income, payable", "federal & state income tax payable"),
    "Line of Credit": ("bank line drawn", "loc - bank", "revolving credit line", "revolver balance"),
    "Current Portion of Long Term Debt": ("ltd due within 1 yr", "current ptn - term loans", "curr. portion lt debt", "current maturities of ltd"),
    "Total Current Liabilities": ("sum of current liabilities",),
    "Long Term Debt": ("term loans, non-current", "lt debt", "long-trm borrowings", "ltd net of current", "long term borrowings"),
    "Lease Liabilities": ("lease liab. (842)", "obligations under leases", "operating lease obligations", "lease obligations"),
    "Deferred Tax Liabilities": ("def. tax liability", "deferred income taxes (liab)", "deferred tax liability"),
    "Due to Shareholders": ("owner loans to company", "s/h loans payable", "owed to stockholders", "shareholder loans payable"),
    "Total Liabilities": ("sum of all liabilities",),
    "Common Stock": ("c/s at par", "capital stock - common", "common shares"),
    "Additional Paid-In Capital": ("apic", "capital in excess of par"),
    "Retained Earnings": ("re (accumulated)", "accumulated earnings", "ret. earnings b/f"),
    "Treasury Stock": ("stock in treasury, at cost", "repurchased shares"),
    "Noncontrolling Interest": ("nci", "non-controlling int.", "minority interest"),
    "Owner Distributions": ("draws - owners", "partner draws ytd", "distributions to members"),
    "Equity": ("net worth (book)", "stockholders equity", "total equity", "shareholders' equity", "members' equity", "owners' equity"),
    "Total Liabilities and Equity": ("total l&e", "total liab. & stockholders' equity", "liabs + equity"),
}

#: What stands before and after a label without belonging to it.
BEFORE = r"^\s*(?:gl\s*#?\s*\d+\s*[:.\-]\s*|\d{3,6}\s+|\d{1,3}\s*[.)]\s+|[-–—>*•·+]+\s+)"
AFTER = r"(?:\s*[(\[](?:see )?notes? \d+[)\]]|\s*\[\d+\]|\s*\*+|\s*:|\s*\.{3,}|\s+-\s+unaudited|\s+per tb|,\s*net|\s*=)\s*$"
_BEFORE, _AFTER, _RUNS = re.compile(BEFORE), re.compile(AFTER), re.compile(r"([.:*=\-–—>•·+])\1{3,}")


def plain_label(text: str) -> str:
    """Letters, digits and single spaces of a label without what was put around it (account numbers, bullets, notes)."""
    s = " ".join(unicodedata.normalize("NFKC", text).lower().replace("_", " ").split())
    s = _RUNS.sub(lambda m: m.group()[:3], s)  # long runs of signs would be tried from every place in them
    s = _BEFORE.sub("", s, count=1)
    while (t := _AFTER.sub("", s)) != s and t.strip():
        s = t
    s = s.replace("&", " and ").replace("+", " and ").replace("'", "").replace("’", "")
    return " ".join(re.sub(r"[^\w]+", " ", s).split())


#: Words that a label may have or lack.
LINK_WORDS = frozenset("and of for the to in on at by".split())


def derived_paths(label: str) -> list[str]:
    """Wordings that follow from a label itself: its initials (of three words on together, of two apart, as in ``a/r``), and
    its words in another order (any part of it first, as in ``assets, total``)."""
    words = plain_label(label).split()
    main = [w for w in words if w not in LINK_WORDS]
    out = [" ".join(words[i:] + words[:i]) for i in range(1, len(words))]
    out += [" ".join(main)] if main != words else []
    out += ["".join(w[0] for w in ws) for ws in (words, main) if len(main) > 2]
    if len(main) > 1:
        out.append(" ".join(w[0] for w in main))
    return out


def label_paths(labels: dict[object, str], aliases: dict[str, tuple[str, ...]] = ALIASES, short: dict[str, tuple[str, ...]] | None = None) -> list[tuple[str, object]]:
    """Trie paths of every entry: its label with every mix of the short words given, what can be derived from it, and its aliases.

    What can be derived from several entries stands for none of them.
    """
    out = []
    for entry, label in labels.items():
        words = plain_label(label).split()
        out += [(" ".join(mix), entry) for mix in product(*((w, *(short or {}).get(w, ())) for w in words))]
        out += [(plain_label(a), entry) for a in aliases.get(label, ())]
    given = {p for p, _ in out}
    derived = Counter((p, entry) for entry, label in labels.items() for p in set(derived_paths(label)))
    entries = Counter(p for p, _ in derived)
    return out + [(p, entry) for p, entry in derived if entries[p] == 1 and p not in given]


def abbreviates(short: str, long: str) -> bool:
    """Whether ``short`` is ``long`` cut off or with letters left out, the first kept."""
    if len(short) < 2 or len(short) >= len(long) or short[0] != long[0]:
        return False
    rest = iter(long)
    return all(c in rest for c in short)


class WordMatcher:
    """Labels read word by word: each word in full, mistyped or abbreviated.

    Paths are listed under the initials of their words (without link words), so a label only meets those it can be.
    """

    def __init__(self, paths: list[tuple[str, object]]):
        self.index: dict[str, list[tuple[list[str], object]]] = {}
        for path, entry in paths:
            words = [w for w in path.split() if w not in LINK_WORDS]
            if len(words) > 1:
                self.index.setdefault("".join(w[0] for w in words), []).append((words, entry))

    def match(self, plain: str) -> object | None:
        """The one entry of which every word is meant; at least two words, and one letter of three."""
        words = [w for w in plain.split() if w not in LINK_WORDS]
        if len(words) < 2:
            return None
        found = set()
        for label, entry in self.index.get("".join(w[0] for w in words), ()):
            if all(w == x or abbreviates(w, x) or (len(x) > 4 and within(w, x, 1) <= 1) for w, x in zip(words, label)) and 3 * sum(map(len, words)) >= sum(map(len, label)):
                found.add(entry)
        return found.pop() if len(found) == 1 else None


def default_tolerance(length: int) -> int:
    """Edits allowed in a plain label of this length: none up to 4 characters, one up to 11, two beyond."""
    return 0 if length <= 4 else 1 if length <= 11 else 2


class LabelMatcher:
    """The entry that a label means, by the trie; the nearest wins, and a tie between different entries is no match."""

    def __init__(self, paths: list[tuple[str, object]], tolerance: Callable[[int], int] = default_tolerance, memo: int = 200_000):
        self.trie, self.tolerance, self.memo, self.seen = Trie(paths), tolerance, memo, {}
        self.by_words = WordMatcher(paths)

    def candidates(self, text: str) -> list[tuple[int, object]]:
        """All entries within the length-dependent distance, nearest first."""
        s = plain_label(text)
        return self.trie.search(s, self.tolerance(len(s))) if s else []

    def match(self, text: str) -> tuple[object | None, int | None]:
        if (hit := self.seen.get(text)) is not None:
            return hit
        found = self.candidates(text)
        out = (None, None)
        if found and not (len(found) > 1 and found[1][0] == found[0][0]):
            out = (found[0][1], found[0][0])
        elif not found and (entry := self.by_words.match(plain_label(text))) is not None:
            out = (entry, 0)
        if len(self.seen) >= self.memo:
            self.seen.clear()
        self.seen[text] = out
        return out


@lru_cache(maxsize=4)
def _matcher(paths: tuple[tuple[str, object], ...]) -> LabelMatcher:
    """The trie of a reference list, built once per process."""
    return LabelMatcher(list(paths))


def map_labels(df: DataFrame, reference: list[tuple[int, str]], *, id_col: str, text_col: str, aliases: dict[str, tuple[str, ...]] = ALIASES, short: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``<id_col>, <text_col>, item_id, distance`` for every row whose text is not blank; both are null if unmatched.

    ``reference`` are the (id, label) entries, a small fixed list; ``aliases`` their other wordings and ``short`` the
    shortened forms of words, both tables of the caller. A label that no path comes near is read word by word.

    Defined results: null and blank texts give no row; a tie between different entries is unmatched; repeated rows are
    mapped each; very long texts end unmatched after a few steps, as no path is that long; an empty table or an empty
    reference gives no rows or only unmatched ones; other columns are ignored, whatever their names.

    Plan: one pass over two columns, no shuffle. Each Python process builds the trie of the reference once and remembers
    the labels it has seen (a bounded memo), so a label with a third of all rows costs one search per process.
    """
    paths = tuple(label_paths({i: label for i, label in reference}, aliases, short))
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).filter(F.col("__text").rlike(r"\S"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(paths)
        for b in batches:
            found = [matcher.match(s) for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32())],
                names=["__id", "__text", "item_id", "distance"],
            )

    schema = f"__id {df.schema[id_col].dataType.simpleString()}, __text string, item_id bigint, distance int"
    return rows.mapInArrow(run, schema).withColumnsRenamed({"__id": id_col, "__text": text_col})
