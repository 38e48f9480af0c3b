"""Byte automata: regexes become one deterministic, minimal transition array.

The syntax is literals, \\ escapes, [classes] with ranges, groups, |, and the quantifiers ? * + {m} {m,} {m,n}.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


class Parser:
    """A regex as nested tuples: ("set", bytes), ("cat", [...]), ("alt", [...]), ("rep", node, low, high)."""

    def __init__(self, pattern: str, fold: bool):
        self.p, self.i, self.fold = pattern, 0, fold

    def parse(self):
        node = self._alt()
        if self.i != len(self.p):
            raise ValueError(f"can't read {self.p!r} from {self.i}")
        return node

    def _peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def _alt(self):
        parts = [self._cat()]
        while self._peek() == "|":
            self.i += 1
            parts.append(self._cat())
        return ("alt", parts) if len(parts) > 1 else parts[0]

    def _cat(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeat(self._atom()))
        return "cat", parts

    def _atom(self):
        c, self.i = self.p[self.i], self.i + 1
        if c == "(":
            node = self._alt()
            if self._peek() != ")":
                raise ValueError("a group is open")
            self.i += 1
            return node
        if c == "[":
            return self._class()
        return self._set(self._escaped() if c == "\\" else c)

    def _escaped(self) -> str:
        c, self.i = self.p[self.i], self.i + 1
        if c == "x":
            c, self.i = chr(int(self.p[self.i : self.i + 2], 16)), self.i + 2
        return c

    def _class(self):
        chars = ""
        while self._peek() != "]":
            c, self.i = self.p[self.i], self.i + 1
            c = self._escaped() if c == "\\" else c
            if self._peek() == "-" and self.p[self.i + 1] != "]":
                end, self.i = self.p[self.i + 1], self.i + 2
                c = "".join(map(chr, range(ord(c), ord(end) + 1)))
            chars += c
        self.i += 1
        return self._set(chars)

    def _set(self, chars: str):
        return "set", frozenset((chars + chars.lower() + chars.upper() if self.fold else chars).encode("ascii"))

    def _repeat(self, node):
        while (c := self._peek()) in ("?", "*", "+", "{") and c:
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                low, high = int(low), (int(high) if high else None) if comma else int(low)
            else:
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = "rep", node, low, high
        return node


def reverse(node):
    kind = node[0]
    if kind == "cat":
        return kind, [reverse(x) for x in reversed(node[1])]
    if kind == "alt":
        return kind, [reverse(x) for x in node[1]]
    return (kind, reverse(node[1]), *node[2:]) if kind == "rep" else node


@dataclass
class Nfa:
    moves: list[list[tuple[frozenset, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def build(self, node, at: int) -> int:
        """Adds the node from state `at`; returns the state behind it."""
        kind = node[0]
        if kind == "set":
            to = self.state()
            self.moves[at].append((node[1], to))
            return to
        if kind == "cat":
            for x in node[1]:
                at = self.build(x, at)
            return at
        if kind == "alt":
            end = self.state()
            for x in node[1]:
                start = self.state()
                self.free[at].append(start)
                self.free[self.build(x, start)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            at = self.build(inner, at)
        end = self.state()
        if high is None:
            loop = self.state()
            self.free[at].append(loop)
            self.free[self.build(inner, loop)].append(loop)
            self.free[loop].append(end)
        else:
            for _ in range(high - low):
                self.free[at].append(end)
                at = self.build(inner, at)
            self.free[at].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


class Dfa:
    """Minimal deterministic automaton of several rules. table[state, byte] is the next state, accepts[state] a bit mask of rules.

    Unanchored, every byte may begin a match. State 0 is the start; `dead` is the state that nothing leaves, or -1.
    """

    def __init__(self, nodes: list, anchored: bool):
        nfa = Nfa()
        start = nfa.state()
        ends = {}
        for k, node in enumerate(nodes):
            own = nfa.state()
            nfa.free[start].append(own)
            ends[nfa.build(node, own)] = 1 << k
        table, accepts = self._subsets(nfa, start, ends, anchored)
        self.table, self.accepts = self._minimal(table, accepts)
        stuck = [s for s in range(len(self.table)) if not self.accepts[s] and (self.table[s] == s).all()]
        self.dead = stuck[0] if stuck and anchored else -1
        self.rows = self._rows()

    @staticmethod
    def _subsets(nfa: Nfa, start: int, ends: dict, anchored: bool) -> tuple[np.ndarray, np.ndarray]:
        # bytes that no transition tells apart share a class
        sets = list({s for m in nfa.moves for s, _ in m})
        classes: dict[tuple, int] = {}
        of_byte = [classes.setdefault(tuple(b in s for s in sets), len(classes)) for b in range(256)]
        sample = [of_byte.index(c) for c in range(len(classes))]
        first = nfa.closure([start])
        known, order, rows = {first: 0}, [first], []
        for now in order:
            row = []
            for b in sample:
                to = {t for s in now for chars, t in nfa.moves[s] if b in chars}
                to = nfa.closure(to if anchored else to | {start})
                if to not in known:
                    known[to] = len(order)
                    order.append(to)
                row.append(known[to])
            rows.append(row)
        masks = [sum({m for e, m in ends.items() if e in s}) for s in order]
        return np.array(rows, np.int32)[:, of_byte], np.array(masks, np.int64)

    @staticmethod
    def _minimal(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Partition refinement: states stay together while their bytes lead to the same parts."""
        _, part = np.unique(accepts, return_inverse=True)
        while True:
            _, finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == part.max():
                break
            part = finer
        _, first = np.unique(part, return_index=True)
        order = np.argsort(first)  # the start's part comes first
        rank = np.empty(len(first), np.int64)
        rank[order] = np.arange(len(first))
        keep = first[order]
        return rank[part[table[keep]]].astype(np.int32), accepts[keep]

    def _rows(self) -> list[list]:
        """The table as rows that hold the next rows themselves, so that a byte costs one index; the mask is entry 256, the state 257."""
        rows = [[] for _ in self.table]
        for s, row in enumerate(rows):
            row.extend(rows[t] for t in self.table[s].tolist())
            row += [int(self.accepts[s]), s]
        return rows
