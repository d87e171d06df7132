"""Signature trees over sets, and their dual traversal.

A tree is packed from sets in the order of their smallest elements, so that alike sets stand close.  Each node has the
range of its sets' sizes, the OR of their bitmaps (an element sets the bit it hashes to), and for every bit the most elements
that one of its sets has there.  For two nodes, the elements of one under the bits of the other, taken either way, bound the
overlap that any two of their sets can have; a pair of nodes whose bound is below what their sizes require is left out with all
that hangs from it.  What is left at the leaves is compared exactly.  Sets that are known to be connected aren't compared
again.
"""

from __future__ import annotations

import numpy as np

LEAF, FAN = 16, 8


class Groups:
    """Union-find over 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * |x & y| >= percent * |x | y|, for sorted arrays of distinct elements."""
    n, m = len(x), len(y)
    if not n or not m or 100 * min(n, m) < percent * max(n, m):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (n + m - shared)


class Node:
    __slots__ = ("low", "high", "bits", "most", "kids", "items")

    def __init__(self, low, high, bits, most, kids=None, items=None):
        self.low, self.high, self.bits, self.most, self.kids, self.items = low, high, bits, most, kids, items


def _width(size: int) -> int:
    """Bits of a bitmap for sets up to a size: at least four for each element, up to 2**15."""
    return 1 << min(15, max(8, int(4 * size - 1).bit_length()))


def _counts(sets: list[np.ndarray], items: list[int], width: int) -> np.ndarray:
    counts = np.zeros((len(items), width), np.float32)
    for row, i in enumerate(items):
        counts[row] = np.bincount(sets[i] & (width - 1), minlength=width)
    return counts


def _folded(most: np.ndarray, width: int) -> np.ndarray:
    """Counts for a smaller width: bits that fall together add up, which no set of the node can exceed."""
    return most if len(most) == width else most.reshape(-1, width).sum(axis=0)


def build(sets: list[np.ndarray], items: list[int]) -> Node | None:
    """The tree of the given items of sets; empty sets are left out.  Sets stand by bands of size, then by their smallest
    element, and a node's bitmap is as wide as its sets need."""
    band = lambda i: int(np.log(len(sets[i])) / np.log(4 / 3))
    items = sorted((i for i in items if len(sets[i])), key=lambda i: (band(i), int(sets[i][0]), len(sets[i])))
    if not items:
        return None
    nodes, at = [], 0
    while at < len(items):
        own = [i for i in items[at : at + LEAF] if band(i) == band(items[at])]
        at += len(own)
        sizes = [len(sets[i]) for i in own]
        most = _counts(sets, own, _width(max(sizes))).max(axis=0)
        nodes.append(Node(min(sizes), max(sizes), (most > 0).astype(np.float32), most, items=own))
    while len(nodes) > 1:
        packed = []
        for at in range(0, len(nodes), FAN):
            kids = nodes[at : at + FAN]
            width = min(len(k.most) for k in kids)
            most = np.maximum.reduce([_folded(k.most, width) for k in kids])
            packed.append(Node(min(k.low for k in kids), max(k.high for k in kids), (most > 0).astype(np.float32), most, kids=kids))
        nodes = packed
    return nodes[0]


def _need(a: int, b: int, percent: int) -> int:
    """The least overlap of linked sets of at least these sizes."""
    return max(-(-percent * (a + b) // (100 + percent)), -(-percent * max(a, b) // 100))


def _possible(a: Node, b: Node, percent: int) -> bool:
    if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
        return False
    if a is b:
        return True
    need = _need(a.low, b.low, percent)
    if len(a.most) == len(b.most):
        return float(a.most @ b.bits) >= need and float(b.most @ a.bits) >= need
    width = min(len(a.most), len(b.most))
    p, q = _folded(a.most, width), _folded(b.most, width)
    return float(p @ (q > 0)) >= need and float(q @ (p > 0)) >= need


def traverse(sets: list[np.ndarray], a: Node | None, b: Node | None, groups: Groups, percent: int) -> None:
    """Joins in groups all linked pairs of a set below a and a set below b."""
    if a is None or b is None:
        return
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if not _possible(x, y, percent):
            continue
        if x.items is not None and y.items is not None:
            _leaves(sets, x, y, groups, percent)
        elif x is y:
            stack += [(p, q) for i, p in enumerate(x.kids) for q in x.kids[i:]]
        elif y.items is not None or (x.items is None and x.high - x.low >= y.high - y.low):
            stack += [(p, y) for p in x.kids]
        else:
            stack += [(x, q) for q in y.kids]


def _leaves(sets, x: Node, y: Node, groups: Groups, percent: int) -> None:
    open_pairs = [(i, j) for i in range(len(x.items)) for j in (range(i + 1, len(y.items)) if x is y else range(len(y.items))) if groups.find(x.items[i]) != groups.find(y.items[j])]
    if not open_pairs:
        return
    bound = None
    if len(open_pairs) > 8:
        width = min(len(x.most), len(y.most))
        a, b = (_counts(sets, n.items, width) for n in (x, y))
        bound = np.minimum(a @ (b > 0).astype(np.float32).T, (a > 0).astype(np.float32) @ b.T)
    for i, j in open_pairs:
        p, q = x.items[i], y.items[j]
        if groups.find(p) == groups.find(q) or bound is not None and bound[i, j] < _need(len(sets[p]), len(sets[q]), percent):
            continue
        if linked(sets[p], sets[q], percent):
            groups.join(p, q)


def self_join(sets: list[np.ndarray], groups: Groups, percent: int) -> None:
    tree = build(sets, list(range(len(sets))))
    traverse(sets, tree, tree, groups, percent)


def cross_join(sets: list[np.ndarray], left: list[int], right: list[int], groups: Groups, percent: int) -> None:
    traverse(sets, build(sets, left), build(sets, right), groups, percent)
