"""Deep-shallow ordering of strings with their common-prefix lengths (after Manzini & Ferragina, 2004).

Multikey quicksort (Bentley & Sedgewick, 1997) with eight bytes to a character splits
the strings into those below, equal to and above a pivot, and goes on eight bytes deeper
with the equal ones, to a shallow depth. Strings that still share that prefix, and few
strings at any depth, are ordered by blind tries, which look at branching positions
only and compare a string in full with a single leaf.
"""

from __future__ import annotations

import numpy as np

#: Bytes ordered by multikey quicksort, in words of eight; so few strings go to a blind trie at once.
SHALLOW, WORD, FEW = 64, 8, 12
#: The depth of strings that are equal to their end.
ENDED = -1


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, of which ``start`` bytes are known."""
    most = min(len(a), len(b))
    step = 16
    while start < most:
        end = min(most, start + step)
        if a[start:end] == b[start:end]:
            start, step = end, step * 4
        elif end - start == 1:
            return start
        else:
            step = max(1, (end - start) // 2)
            if a[start : start + step] == b[start : start + step]:
                start += step
            most = min(most, end)
    return start


class _Node:
    __slots__ = ("at", "children", "leaf")

    def __init__(self, at: int, children: dict, leaf: int):
        self.at, self.children, self.leaf = at, children, leaf


class BlindTrie:
    """Orders strings; a node has the position at which its strings first differ, a leaf the equal strings."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.same: dict[int, list[int]] = {}
        self.root: _Node | int | None = None

    def _branch(self, k: int, at: int) -> int:
        s = self.strings[k]
        return s[at] if at < len(s) else -1

    def insert(self, k: int, known: int = 0) -> None:
        if self.root is None:
            self.root, self.same[k] = k, [k]
            return
        node = self.root
        while isinstance(node, _Node):  # blind descent to any leaf
            node = node.children.get(self._branch(k, node.at), node.leaf)
        s, t = self.strings[k], self.strings[node]
        at = common_prefix(s, t, known)
        if at == len(s) == len(t):
            self.same[node].append(k)
            return
        self.same[k] = [k]
        above, node = None, self.root
        while isinstance(node, _Node) and node.at < at:
            above, node = node, node.children[self._branch(k, node.at)]
        if isinstance(node, _Node) and node.at == at:
            node.children[self._branch(k, at)] = k
            return
        leaf = node.leaf if isinstance(node, _Node) else node
        new = _Node(at, {self._branch(leaf, at): node, self._branch(k, at): k}, leaf)
        if above is None:
            self.root = new
        else:
            above.children[self._branch(k, above.at)] = new

    def ordered(self) -> tuple[list[int], list[int]]:
        """The strings in order, and of each but the first the prefix it shares with the one before."""
        order, shared, pending = [], [], 0
        stack: list = [(self.root, 0)]
        while stack:
            node, pending = stack.pop()
            if isinstance(node, _Node):
                branches = sorted(node.children)
                stack += [(node.children[b], node.at) for b in reversed(branches[1:])]
                stack.append((node.children[branches[0]], pending))
                continue
            if node is None:
                break
            same = self.same[node]
            shared += [pending] + [len(self.strings[node])] * (len(same) - 1)
            order += same
        return order, shared[1:]


def _median(a: bytes, b: bytes, c: bytes) -> bytes:
    return max(min(a, b), min(max(a, b), c))


def multikey_quicksort(strings: list[bytes], own: list[int]) -> tuple[list[int], list[int]]:
    """The positions ``own`` in the order of their strings, and of each but the first the prefix it shares with the one before."""
    order: list[int] = []
    lcp: list[int] = []
    # a part, the bytes that its strings share, and those they are known to share with the string that comes before them
    stack = [(own, 0, 0)]
    while stack:
        part, depth, known = stack.pop()
        if depth == ENDED:
            ranked, shared = part, [len(strings[part[0]])] * (len(part) - 1)
        elif len(part) <= FEW or depth >= SHALLOW:
            trie = BlindTrie(strings)
            for k in part:
                trie.insert(k, depth)
            ranked, shared = trie.ordered()
        else:
            words = [strings[k][depth : depth + WORD] for k in part]
            pivot = _median(words[0], words[len(words) // 2], words[-1])
            less = [k for k, w in zip(part, words) if w < pivot]
            equal = [k for k, w in zip(part, words) if w == pivot]
            more = [k for k, w in zip(part, words) if w > pivot]
            if more:
                stack.append((more, depth, depth))
            stack.append((equal, depth + WORD if len(pivot) == WORD else ENDED, depth if less else known))
            if less:
                stack.append((less, depth, known))
            continue
        if order:
            lcp.append(common_prefix(strings[order[-1]], strings[ranked[0]], known))
        order += ranked
        lcp += shared
    return order, lcp


def deep_shallow(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, string), and each one's common prefix with the one before (-1 where the group changes)."""
    order = np.argsort(group, kind="stable")
    lcp = np.full(len(strings), -1, np.int64)
    cuts = np.flatnonzero(np.diff(group[order], prepend=group[order[:1]] - 1, append=group[order[-1:]] + 1)) if len(strings) else ()
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a > 1:
            order[a:b], lcp[a + 1 : b] = multikey_quicksort(strings, order[a:b].tolist())
    return order, lcp
