"""Edit distance with neighbouring swaps (optimal string alignment), banded, and its automaton over a trie."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field


def within(a: str, b: str, k: int) -> int:
    """Distance of ``a`` and ``b`` if it is at most ``k``, else ``k + 1``; only a band of 2k+1 diagonals is computed."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return k + 1
    far = k + 1
    before: list[int] = []
    row, least = [j if j <= k else far for j in range(m + 1)], 0
    for i in range(1, n + 1):
        lo, hi = max(1, i - k), min(m, i + k)
        now = [far] * (m + 1)
        if i <= k:
            now[0] = i
        for j in range(lo, hi + 1):
            d = row[j - 1] + (a[i - 1] != b[j - 1])
            if row[j] + 1 < d:
                d = row[j] + 1
            if now[j - 1] + 1 < d:
                d = now[j - 1] + 1
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and before[j - 2] + 1 < d:
                d = before[j - 2] + 1
            now[j] = min(d, far)
        # a swap may still come from the row before this one
        best = min(now[lo - 1 : hi + 1], default=far)
        if best > k and least >= k:
            return far
        before, row, least = row, now, best
    return row[m]


@dataclass
class _Node:
    edges: dict[str, "_Node"] = field(default_factory=dict)
    entries: list = field(default_factory=list)
    shortest: int = 1 << 30  # characters still to come on the shortest and longest way to an entry
    longest: int = 0


class Trie:
    """Reference entries, reachable by any of their paths (labels and aliases), searched with a Levenshtein automaton.

    The automaton's state after reading a path is the row of distances between the path and all prefixes of the query
    (with the row before it, for swaps); only states that can still come within the allowed distance are followed.
    """

    def __init__(self, paths: Iterable[tuple[str, object]]):
        self.root = _Node()
        for path, entry in paths:
            node, left = self.root, len(path)
            node.shortest, node.longest = min(node.shortest, left), max(node.longest, left)
            for c in path:
                node = node.edges.setdefault(c, _Node())
                left -= 1
                node.shortest, node.longest = min(node.shortest, left), max(node.longest, left)
            if entry not in node.entries:
                node.entries.append(entry)

    def exact(self, query: str) -> list:
        node = self.root
        for c in query:
            node = node.edges.get(c)
            if node is None:
                return []
        return node.entries

    def search(self, query: str, k: int) -> list[tuple[int, object]]:
        """All ``(distance, entry)`` with a path within ``k`` of the query, the least distance of each entry first."""
        if hit := self.exact(query):
            if k == 0:
                return [(0, e) for e in hit]
        elif k == 0:
            return []
        m, far, best = len(query), k + 1, {}
        start = [min(j, far) for j in range(m + 1)]
        stack = [(self.root, 0, start, None, "", 0)]
        while stack:
            node, depth, row, before, last, lowest = stack.pop()
            if node.entries and row[m] <= k:
                for e in node.entries:
                    if row[m] < best.get(e, far):
                        best[e] = row[m]
            i = depth + 1
            lo, hi = max(1, i - k), min(m, i + k)
            for c, child in node.edges.items():
                # the rest of the query must fit what is left of the paths
                if m - i - k > child.longest or m - i + k < child.shortest:
                    continue
                now = [far] * (m + 1)
                if i <= k:
                    now[0] = i
                least = now[0]
                for j in range(lo, hi + 1):
                    q = query[j - 1]
                    d = row[j - 1] + (q != c)
                    if row[j] + 1 < d:
                        d = row[j] + 1
                    if now[j - 1] + 1 < d:
                        d = now[j - 1] + 1
                    if before is not None and j > 1 and q == last and query[j - 2] == c and before[j - 2] + 1 < d:
                        d = before[j - 2] + 1
                    now[j] = d
                    if d < least:
                        least = d
                # a swap may still come from the row before this one
                if least <= k or lowest < k:
                    stack.append((child, i, now, row, c, least))
        return sorted(((d, e) for e, d in best.items()), key=lambda x: (x[0], str(x[1])))
