"""Regular expressions to one minimal deterministic automaton over bytes, as transition arrays.

``parse`` reads the usual ASCII syntax (literals, escapes, classes, groups, ``| ? * + {m} {m,}
{m,n}`` and ``(?i:...)``) into a tree, ``Nfa`` lays rules out as one Thompson automaton, ``compile``
determinises it by subset construction over byte equivalence classes and minimises it by partition
refinement.  ``scan`` runs the automaton over a whole block of text in one pass: the block is cut
into lanes that advance together, one array operation per byte position, and lanes whose true
incoming state differs from the assumed one are run again until they meet their recorded states.

``matches`` gives spans: one pass of the backward automaton of all rules (each rule reversed, read
from the block's end) marks every byte at which a rule's match begins; from those bytes the anchored
automaton of the rule runs forward to the match's longest end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ALL = (1 << 256) - 1
_INF = -1


def _bits(chars: bytes) -> int:
    out = 0
    for c in chars:
        out |= 1 << c
    return out


class _Parser:
    """Recursive descent over the pattern; nodes are ('set', bits), ('cat', ...), ('alt', ...), ('rep', node, m, n)."""

    def __init__(self, pattern: str):
        self.s, self.i, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def take(self, n: int = 1) -> str:
        self.i += n
        return self.s[self.i - n : self.i]

    def alt(self):
        parts = [self.cat()]
        while self.peek() == "|":
            self.take()
            parts.append(self.cat())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def cat(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeat())
        return ("cat", parts)

    def repeat(self):
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                body = self.s[self.i : self.s.index("}", self.i)]
                self.take(len(body) + 1)
                low, comma, high = body.partition(",")
                m, n = int(low), (int(high) if high else _INF) if comma else int(low)
            else:
                m, n = {"?": (0, 1), "*": (0, _INF), "+": (1, _INF)}[c]
            node = ("rep", node, m, n)
        return node

    def atom(self):
        c = self.take()
        if c == "(":
            outer = self.fold
            if self.s.startswith("?i:", self.i):
                self.take(3)
                self.fold = True
            elif self.s.startswith("?:", self.i):
                self.take(2)
            node = self.alt()
            assert self.take() == ")", self.s
            self.fold = outer
            return node
        if c == "[":
            return ("set", self.char_class())
        if c == "\\":
            return ("set", 1 << self.escape())
        if c == ".":
            return ("set", ALL & ~(1 << 10))
        return ("set", self.folded(1 << ord(c)))

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            return int(self.take(2), 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def folded(self, bits: int) -> int:
        if self.fold:
            for k in range(26):
                if bits >> (65 + k) & 1 or bits >> (97 + k) & 1:
                    bits |= 1 << (65 + k) | 1 << (97 + k)
        return bits

    def char_class(self) -> int:
        negate = self.peek() == "^"
        if negate:
            self.take()
        bits = 0
        while self.peek() != "]":
            c = self.take()
            low = self.escape() if c == "\\" else ord(c)
            high = low
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.take()
                c = self.take()
                high = self.escape() if c == "\\" else ord(c)
            bits |= _bits(bytes(range(low, high + 1)))
        self.take()
        bits = self.folded(bits)
        return ALL & ~bits if negate else bits


def backwards(node):
    """The tree of the reversed language."""
    if node[0] == "cat":
        return ("cat", [backwards(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [backwards(x) for x in node[1]])
    return node if node[0] == "set" else ("rep", backwards(node[1]), *node[2:])


def parse(pattern: str):
    p = _Parser(pattern)
    tree = p.alt()
    assert p.i == len(pattern), f"unread pattern: {pattern[p.i:]}"
    return tree


class Nfa:
    """Thompson automaton: epsilon moves and at most one byte-set move per state."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.move: list[tuple[int, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.move.append(None)
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        """Attach ``node`` behind ``start``; returns its end state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            via = self.state()
            self.empty[start].append(via)
            self.move[via] = (node[1], end)
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                self.empty[self.add(part, start)].append(end)
            return end
        _, part, m, n = node
        for _ in range(m):
            start = self.add(part, start)
        if n == _INF:
            loop, end = self.state(), self.state()
            self.empty[start] += [loop]
            self.empty[self.add(part, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        end = self.state()
        self.empty[start].append(end)
        for _ in range(n - m):
            start = self.add(part, start)
            self.empty[start].append(end)
        return end


@dataclass
class Dfa:
    """kind[byte] is the byte's class, step[state * classes + class] the next state, hit[state] a rule bit
    mask, dead the state that nothing leads out of (-1: none)."""

    kind: np.ndarray
    step: np.ndarray
    hit: np.ndarray
    classes: int
    dead: int = -1


def compile(patterns: list[str], *, reverse: bool = False, anchored: bool = False) -> Dfa:
    """One minimal automaton of all rules; state 0 is the start.

    It finds rules that start at any byte, or at the first one only where it is ``anchored``;
    ``reverse`` is for texts that are read from their end.
    """
    nfa = Nfa()
    root = nfa.state()
    ends = {}
    for r, pattern in enumerate(patterns):
        tree = parse(pattern)
        ends[nfa.add(backwards(tree) if reverse else tree, root)] = 1 << r

    sets = list({m[0] for m in nfa.move if m})
    kinds: dict[tuple, int] = {}
    kind = np.array([kinds.setdefault(tuple(s >> b & 1 for s in sets), len(kinds)) for b in range(256)], np.uint8)
    sample = [int(np.flatnonzero(kind == k)[0]) for k in range(len(kinds))]

    def closure(states) -> frozenset[int]:
        seen, stack = set(), [*states]
        while stack:
            s = stack.pop()
            if s not in seen:
                seen.add(s)
                stack += nfa.empty[s]
        return frozenset(s for s in seen if nfa.move[s] or s in ends)

    begin = closure([root])
    again = frozenset() if anchored else begin
    number, todo, step, hit = {begin: 0}, [begin], [], []
    while todo:
        now = todo.pop(0)
        hit.append(sum({ends[s] for s in now if s in ends}))
        for b in sample:
            to = closure([nfa.move[s][1] for s in now if nfa.move[s] and nfa.move[s][0] >> b & 1]) | again
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            step.append(number[to])
    table, mask = np.array(step, np.int64).reshape(-1, len(sample)), np.array(hit, np.int64)

    block = np.unique(mask, return_inverse=True)[1]
    while True:  # states stay together while their successors do
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    order = np.unique(block, return_index=True)[1]
    name = np.empty(block.max() + 1, np.int64)
    rank = np.argsort(order, kind="stable")  # the start state is state 0 again
    name[rank] = np.arange(rank.size)
    small = name[block[table[order[rank]]]]
    stuck = np.flatnonzero((small == np.arange(len(small))[:, None]).all(axis=1) & (mask[order[rank]] == 0))
    return Dfa(kind, small.astype(np.int32).ravel(), mask[order[rank]], len(sample), int(stuck[0]) if stuck.size else -1)


LANE = 512


def scan(dfa: Dfa, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, rule masks): bytes at which some rule is accepted, ascending."""
    if not data.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lanes = -(-data.size // LANE)
    padded = np.full(lanes * LANE, 10, np.uint8)
    padded[: data.size] = data
    kinds = np.ascontiguousarray(dfa.kind[padded].reshape(lanes, LANE).T)
    seen = np.empty((LANE, lanes), np.int32)
    state = np.zeros(lanes, np.int32)
    for t in range(LANE):
        state = dfa.step[state * dfa.classes + kinds[t]]
        seen[t] = state
    entry = np.zeros(lanes, np.int32)  # the state each lane was assumed to start in
    while True:
        true = np.concatenate(([0], seen[-1, :-1])).astype(np.int32)
        live = np.flatnonzero(true != entry)
        if not live.size:
            break
        entry = true
        state = true[live]
        for t in range(LANE):
            state = dfa.step[state * dfa.classes + kinds[t, live]]
            differs = state != seen[t, live]
            if not differs.any():
                break
            live, state = live[differs], state[differs]
            seen[t, live] = state
    flat = dfa.hit[seen.T.ravel()[: data.size]]
    at = np.flatnonzero(flat)
    return at, flat[at]


#: Lanes from which positions are advanced together rather than one by one.
TOGETHER = 12


def extents(dfa: Dfa, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last): ends (exclusive) of the shortest and the longest match of an anchored automaton
    from each start, -1 where there is none."""
    first, last = np.full(starts.size, -1, np.int64), np.full(starts.size, -1, np.int64)
    live, state, t = np.arange(starts.size), np.zeros(starts.size, np.int64), 0
    accepts = dfa.hit > 0
    while live.size >= TOGETHER:
        live = live[starts[live] + t < data.size]
        at = starts[live] + t
        state[live] = dfa.step[state[live] * dfa.classes + dfa.kind[data[at]]]
        hit = live[accepts[state[live]]]
        last[hit] = starts[hit] + t + 1
        first[hit] = np.where(first[hit] < 0, last[hit], first[hit])
        live = live[state[live] != dfa.dead]
        t += 1
    step, ok = (dfa.step.tolist(), accepts.tolist()) if live.size else ([], [])
    for i in live.tolist():
        now, at = int(state[i]), int(starts[i]) + t
        while now != dfa.dead and at < data.size:
            for k in dfa.kind[data[at : at + 4096]].tolist():
                now = step[now * dfa.classes + k]
                at += 1
                if ok[now]:
                    last[i] = at
                    first[i] = at if first[i] < 0 else first[i]
                elif now == dfa.dead:
                    break
    return first, last


def matches(backward: Dfa, anchored: list[Dfa], data: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each rule its leftmost, longest, non-overlapping matches as (start, first end, end)."""
    at, mask = scan(backward, data[::-1])
    starts, mask = (data.size - 1 - at)[::-1], mask[::-1]
    out: list[list[tuple[int, int, int]]] = []
    for r, dfa in enumerate(anchored):
        own = starts[mask >> r & 1 == 1]
        heads = own[np.concatenate(([True], np.diff(own) > 1))] if own.size else own  # starts inside a run are covered by its head
        known = dict(zip(heads.tolist(), zip(*(x.tolist() for x in extents(dfa, data, heads)), strict=True), strict=True))
        found, i = [], 0
        while i < own.size:
            a = int(own[i])
            first, end = known[a] if a in known else (int(x[0]) for x in extents(dfa, data, own[i : i + 1]))
            found.append((a, first, end))
            i = int(np.searchsorted(own, end))
        out.append(found)
    return out
