"""Order of suffixes and their common prefixes by deep-shallow sorting.

Multikey quicksort splits suffixes by eight bytes at a time, down to a shallow depth. Groups that are still equal there have long common
prefixes, and comparing them byte by byte again and again would cost their whole length each time. They are ordered by a blind trie: its
branches know only the depth at which suffixes part and the byte they part by. To insert a suffix, one goes down by those bytes alone, compares once
with any leaf reached, and adds a branch at the depth found.
"""

from __future__ import annotations

#: Bytes that quicksort looks at in one step, and the depth below which blind tries take over.
STEP, SHALLOW = 8, 32


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix: halving, on slices that the machine compares at once."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] doesn't
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class _Branch:
    """Suffixes below agree up to depth; each way leads on by the byte there (-1: the suffix ends)."""

    __slots__ = ("depth", "leaf", "ways")

    def __init__(self, depth: int, leaf: int, ways: dict):
        self.depth, self.leaf, self.ways = depth, leaf, ways


def _byte(s: bytes, at: int) -> int:
    return s[at] if at < len(s) else -1


def blind_trie(strings: list[bytes], of: list[int]) -> list[int]:
    """The numbers in `of`, ordered by their strings; equal strings in the order given."""
    root = _Branch(0, of[0], {})
    same: dict[int, list[int]] = {}
    first = True
    for i in of:
        s = strings[i]
        if first:
            root.ways[_byte(s, 0)] = i
            first = False
            continue
        node: _Branch | int = root
        while isinstance(node, _Branch):  # blindly down to any leaf
            node = node.ways.get(_byte(s, node.depth), node.leaf)
        other = strings[node]
        depth = common(s, other)
        if depth == len(s) == len(other):
            same.setdefault(node, []).append(i)
            continue
        # the way to the leaf again, down to where the suffix parts from it
        parent, key, node = None, 0, root
        while isinstance(node, _Branch) and node.depth < depth:
            parent, key = node, _byte(other, node.depth)
            node = node.ways[key]
        if isinstance(node, _Branch) and node.depth == depth:
            node.ways[_byte(s, depth)] = i
        else:
            leaf = node.leaf if isinstance(node, _Branch) else node
            made = _Branch(depth, leaf, {_byte(other, depth): node, _byte(s, depth): i})
            if parent is None:
                root = made
            else:
                parent.ways[key] = made
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Branch):
            stack.extend(way for _, way in sorted(node.ways.items(), key=lambda x: -x[0]))
        else:
            order.append(node)
            order.extend(same.get(node, ()))
    return order


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of the strings, and how long a prefix each shares with the one before it in that order (0 for the first)."""
    order: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        of, depth = stack.pop()
        if len(of) == 1:
            order.extend(of)
            continue
        if depth >= SHALLOW or len(of) == 2:
            order.extend(blind_trie(strings, of))
            continue
        pivot = strings[of[len(of) // 2]][depth : depth + STEP]
        less, equal, more = [], [], []
        for i in of:
            symbol = strings[i][depth : depth + STEP]
            (equal if symbol == pivot else less if symbol < pivot else more).append(i)
        if more:
            stack.append((more, depth))
        if len(pivot) < STEP:  # all of these end here, alike
            stack.extend(([i], depth) for i in reversed(equal))
        else:
            stack.append((equal, depth + STEP))
        if less:
            stack.append((less, depth))
    shared = [0] * len(order)
    for k in range(1, len(order)):
        shared[k] = common(strings[order[k - 1]], strings[order[k]])
    return order, shared
