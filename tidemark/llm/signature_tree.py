"""Signature trees over sets of hashes, and the links between similar sets.

A leaf holds one set: its size, and a bitmap with a bit for each token.  A node
holds the OR of its children's bitmaps, the range of their sizes, and the most
tokens by which a set below it exceeds its bits.  Sets below two nodes have no more
tokens in common than the nodes have bits in common plus that excess, nor than the
smaller one has tokens.  Two trees are walked together, and a pair of nodes is left
when that can't make a similarity of `part` / `whole` for sets of any size in both ranges.
"""

from __future__ import annotations

import numpy as np

#: Bits of a bitmap for each token of a middling set; fewest and most bits.
BITS_A_TOKEN, FEWEST, MOST = 8, 1 << 10, 1 << 16
FANOUT = 8


class Node:
    __slots__ = ("bitmap", "children", "excess", "least", "member", "most", "one")

    def __init__(self, children: list[Node], member: int = -1) -> None:
        self.children, self.member, self.one = children, member, member >= 0
        if children:
            self.bitmap = np.bitwise_or.reduce([c.bitmap for c in children])
            self.least, self.most = min(c.least for c in children), max(c.most for c in children)
            self.excess = max(c.excess for c in children)


class Members:
    """Sets with the tokens that other sets may have too (sorted) and their whole sizes, and what links were found among them."""

    def __init__(self, tokens: list[np.ndarray], sizes: list[int], part: int, whole: int, thorough: bool = False) -> None:
        """thorough: pairs that are linked through others already are compared too."""
        self.tokens, self.sizes, self.part, self.whole, self.thorough = tokens, sizes, part, whole, thorough
        middling = int(np.median([len(t) for t in tokens])) if tokens else 0
        self.bits = min(MOST, max(FEWEST, 1 << (BITS_A_TOKEN * middling).bit_length()))
        self.parent = list(range(len(sizes)))
        self.links: list[tuple[int, int]] = []

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = k = self.parent[self.parent[k]]
        return k

    def tree(self, members: list[int]) -> Node:
        """Similar sets near each other: by their least tokens, then by size."""
        level = []
        for k in sorted(members, key=lambda k: (self.tokens[k][:2].tolist(), self.sizes[k])):
            leaf = Node([], k)
            bits = np.zeros(self.bits, np.uint8)
            bits[(self.tokens[k] % np.uint64(self.bits)).astype(np.int64)] = 1
            leaf.bitmap = np.packbits(bits).view(np.uint64)
            leaf.least = leaf.most = self.sizes[k]
            leaf.excess = len(self.tokens[k]) - int(bits.sum())
            level.append(leaf)
        while len(level) > 1:
            level = [Node(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
        return level[0]

    def enough(self, overlap: int, a: int, b: int) -> bool:
        return self.whole * overlap >= self.part * (a + b - overlap)

    def possible(self, x: Node, y: Node) -> bool:
        """Whether sets below both nodes may be similar enough."""
        common = int(np.bitwise_count(x.bitmap & y.bitmap).sum()) + min(x.excess, y.excess)
        # the overlap is at most this; the union has as many tokens as the overlap and as the larger set at least
        most = min(x.most, y.most, common)
        return self.whole * most >= self.part * max(most, x.least, y.least)

    def joined(self, node: Node) -> bool:
        """Whether all sets below are linked to each other already; that stays so."""
        if not node.one:
            roots = {self.root(c.member) if c.member >= 0 else -1 for c in node.children if self.joined(c)}
            if all(c.one for c in node.children) and len(roots) == 1:
                node.one, node.member = True, node.children[0].member
        return node.one

    def walk(self, x: Node, y: Node) -> None:
        """Link the similar pairs below two nodes, as far as they aren't linked already."""
        stack = [(x, y)]
        while stack:
            x, y = stack.pop()
            if x is y and not x.children:
                continue
            if not self.thorough and self.joined(x) and self.joined(y) and self.root(x.member) == self.root(y.member):
                continue
            if x is y:
                stack += [(a, b) for i, a in enumerate(x.children) for b in x.children[i + 1 :]]
                stack += [(a, a) for a in x.children]  # first, so that what lies close is linked by then
            elif not self.possible(x, y):
                continue
            elif not x.children and not y.children:
                self.compare(x.member, y.member)
            elif not y.children or (x.children and x.most - x.least >= y.most - y.least):
                stack += [(a, y) for a in x.children]
            else:
                stack += [(x, b) for b in y.children]

    def compare(self, a: int, b: int) -> None:
        both = np.concatenate((self.tokens[a], self.tokens[b]))
        both.sort()
        overlap = int((both[1:] == both[:-1]).sum())
        if self.enough(overlap, self.sizes[a], self.sizes[b]):
            self.links.append((a, b))
            self.parent[self.root(a)] = self.root(b)
