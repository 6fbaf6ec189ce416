"""Deep-shallow suffix sorting: multikey quicksort to a shallow depth, blind tries below it."""

from __future__ import annotations

#: Depth to which quicksort goes, and the bytes that it compares at once.
SHALLOW, STRIDE = 64, 8


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the longest common prefix, known to be at least ``start``."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    lo, hi = start, n - 1
    while lo < hi:
        middle = (lo + hi) // 2
        if a[lo : middle + 1] == b[lo : middle + 1]:
            lo = middle + 1
        else:
            hi = middle
    return lo


class BlindTrie:
    """A compacted trie whose inner nodes keep only a depth and one symbol for each branch.

    A node is [depth, {symbol: child}] and a leaf the index of a string; symbol -1 stands for the end.
    Insertion goes down by the symbols alone, compares with the leaf it meets, and then branches at the
    first difference. Equal strings share a leaf.
    """

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: list | int | None = None
        self.same: dict[int, list[int]] = {}

    def _symbol(self, s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def insert(self, i: int, start: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root, self.same[i] = i, [i]
            return
        node = self.root
        while not isinstance(node, int):
            child = node[1].get(self._symbol(s, node[0]))
            node = next(iter(node[1].values())) if child is None else child
        other = self.strings[node]
        depth = common(s, other, start)
        if depth == len(s) == len(other):
            self.same[node].append(i)
            return
        self.same[i] = [i]
        above, at = None, self.root
        while not isinstance(at, int) and at[0] < depth:
            above, at = at, at[1][self._symbol(s, at[0])]
        if not isinstance(at, int) and at[0] == depth:
            at[1][self._symbol(s, depth)] = i
            return
        new = [depth, {self._symbol(other, depth): at, self._symbol(s, depth): i}]
        if above is None:
            self.root = new
        else:
            above[1][self._symbol(s, above[0])] = new

    def ordered(self, first: int) -> tuple[list[int], list[int]]:
        """Indices in order, and of each the common prefix with the one before (``first`` for the first)."""
        order: list[int] = []
        lcp: list[int] = []
        stack: list[tuple[list | int, int]] = [(self.root, first)]
        while stack:
            node, before = stack.pop()
            if isinstance(node, int):
                for k, i in enumerate(self.same[node]):
                    order.append(i)
                    lcp.append(len(self.strings[i]) if k else before)
                continue
            children = sorted(node[1].items())
            stack += [(child, node[0] if k else before) for k, (_, child) in reversed(list(enumerate(children)))]
        return order, lcp


def sort_strings(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """(order, lcp): the strings' order and the common prefix of each with its predecessor (0 for the first)."""
    order: list[int] = []
    lcp: list[int] = []
    stack: list[tuple[list[int], int, int]] = [(list(range(len(strings))), 0, 0)]
    while stack:
        group, depth, before = stack.pop()
        if not group:
            continue
        if len(group) == 1:
            order.append(group[0])
            lcp.append(before)
            continue
        if depth >= shallow:
            trie = BlindTrie(strings)
            for i in group:
                trie.insert(i, depth)
            ranked, prefixes = trie.ordered(before)
            order += ranked
            lcp += prefixes
            continue
        keys = [strings[i][depth : depth + STRIDE] for i in group]
        pivot = keys[len(keys) // 2]
        less = [i for i, k in zip(group, keys, strict=True) if k < pivot]
        more = [i for i, k in zip(group, keys, strict=True) if k > pivot]
        same = [i for i, k in zip(group, keys, strict=True) if k == pivot]
        # What precedes a part is the largest key below it; its common prefix is within the stride.
        below = max((k for k in keys if k < pivot), default=None)
        above = min((k for k in keys if k > pivot), default=None)
        if more:
            stack.append((more, depth, depth + common(pivot, above)))
        into = before if below is None else depth + common(below, pivot)
        if len(pivot) < STRIDE:  # all of these strings end here, so they are equal
            stack += [([i], depth, len(strings[i])) for i in reversed(same[1:])]
            stack.append((same[:1], depth, into))
        else:
            stack.append((same, depth + STRIDE, into))
        if less:
            stack.append((less, depth, before))
    return order, lcp
