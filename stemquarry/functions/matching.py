"""Matching blocks of two texts at any length, with the results of the standard library's matcher.

That matcher looks for the longest common block (earliest in the first text, then in the second)
and goes on to the left and to the right of it; each search takes time that grows with the product
of the lengths.  Here a suffix automaton of the second text gives the longest block in linear time,
and one pass takes all blocks of that length from left to right: what remains between them has
shorter blocks only.
"""

from __future__ import annotations

import difflib
from bisect import bisect_left

#: Block length up to which the places of all runs of that length are listed; longer ones are searched for.
LISTED = 64


class SuffixAutomaton:
    """States of all substrings of a text; ``lengths`` follows another text through them."""

    def __init__(self, text: str):
        self.move: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for c in text:
            state = len(self.size)
            self.move.append({})
            self.size.append(self.size[last] + 1)
            self.link.append(0)
            at = last
            while at >= 0 and c not in self.move[at]:
                self.move[at][c] = state
                at = self.link[at]
            if at >= 0:
                onto = self.move[at][c]
                if self.size[at] + 1 == self.size[onto]:
                    self.link[state] = onto
                else:
                    copy = len(self.size)
                    self.move.append(dict(self.move[onto]))
                    self.size.append(self.size[at] + 1)
                    self.link.append(self.link[onto])
                    while at >= 0 and self.move[at].get(c) == onto:
                        self.move[at][c] = copy
                        at = self.link[at]
                    self.link[onto] = self.link[state] = copy
            last = state

    def lengths(self, text: str) -> list[int]:
        """For each end in ``text``, the length of the longest block of the automaton's text that ends there."""
        out, at, n = [], 0, 0
        move, link, size = self.move, self.link, self.size
        for c in text:
            while at and c not in move[at]:
                at = link[at]
                n = size[at]
            if c in move[at]:
                at = move[at][c]
                n += 1
            out.append(n)
        return out


class BlockMatcher(difflib.SequenceMatcher):
    """``difflib.SequenceMatcher`` of two texts whose blocks come from suffix automata."""

    def __init__(self, a: str, b: str, autojunk: bool = True):
        super().__init__(None, a, b, autojunk)
        self._a, self._b = a, b
        if self.bpopular:  # they start no block: here they are characters that the other text doesn't have
            used = {*a, *b}
            unused = (chr(x) for x in range(0x10FFFF, 0, -1) if chr(x) not in used)
            self._a, self._b = (t.translate(dict.fromkeys(map(ord, self.bpopular), next(unused))) for t in (a, b))

    def get_matching_blocks(self) -> list[difflib.Match]:
        if self.matching_blocks is not None:
            return self.matching_blocks
        found, ranges = [], [(0, len(self.a), 0, len(self.b))]
        while ranges:
            alo, ahi, blo, bhi = ranges.pop()
            if alo < ahi and blo < bhi:
                blocks = self._blocks(alo, ahi, blo, bhi)
                found += blocks
                if blocks:
                    for i, j, n in blocks:
                        ranges.append((alo, i, blo, j))
                        alo, blo = i + n, j + n
                    ranges.append((alo, ahi, blo, bhi))
        found.sort()
        joined: list[difflib.Match] = []
        for i, j, n in found:
            if joined and joined[-1].a + joined[-1].size == i and joined[-1].b + joined[-1].size == j:
                joined[-1] = joined[-1]._replace(size=joined[-1].size + n)
            else:
                joined.append(difflib.Match(i, j, n))
        self.matching_blocks = [*joined, difflib.Match(len(self.a), len(self.b), 0)]
        return self.matching_blocks

    def _blocks(self, alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int, int]]:
        """All longest blocks of the range, from left to right, each behind the one before in both texts."""
        ends = SuffixAutomaton(self._b[blo:bhi]).lengths(self._a[alo:ahi])
        size = max(ends)
        if not size:  # popular characters may still go on from the start of the range
            block = self._extended(alo, blo, 0, alo, ahi, blo, bhi)
            return [block] if block[2] else []
        places: dict[str, list[int]] = {}
        if size <= LISTED:
            for j in range(blo, bhi - size + 1):
                places.setdefault(self._b[j : j + size], []).append(j)
        out = []
        for i in [alo + e + 1 - size for e, n in enumerate(ends) if n == size]:
            if i < alo:
                continue
            block = self._a[i : i + size]
            if size <= LISTED:
                known = places[block]
                k = bisect_left(known, blo)
                j = known[k] if k < len(known) else -1
            else:
                j = self._b.find(block, blo, bhi)
            if j >= 0:
                out.append(self._extended(i, j, size, alo, ahi, blo, bhi))
                alo, blo = out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]
        return out

    def _extended(self, i: int, j: int, n: int, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """The block with equal characters on either side, popular ones too."""
        a, b = self.a, self.b
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < ahi and j + n < bhi and a[i + n] == b[j + n]:
            n += 1
        return i, j, n
