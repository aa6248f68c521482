"""Byte automata: regular expressions to one minimal deterministic automaton for many rules.

Supported syntax: literals, escapes (`\\.`, `\\xHH`), classes with ranges and negation, groups,
`(?i:...)`, alternation and the quantifiers `? * + {m} {m,} {m,n}`. Everything is over bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class _Parser:
    """Recursive descent to a tree of ('set', bytes) / ('cat', [..]) / ('alt', [..]) / ('rep', x, m, n)."""

    def __init__(self, text: str):
        self.s, self.i, self.fold = text, 0, False

    def parse(self):
        tree = self.alt()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i :]!r}")
        return tree

    def alt(self):
        options = [self.cat()]
        while self.i < len(self.s) and self.s[self.i] == "|":
            self.i += 1
            options.append(self.cat())
        return options[0] if len(options) == 1 else ("alt", options)

    def cat(self):
        parts = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            parts.append(self.quantified())
        return ("cat", parts)

    def quantified(self):
        x = self.atom()
        while self.i < len(self.s) and self.s[self.i] in "?*+{":
            c = self.s[self.i]
            self.i += 1
            if c == "{":
                j = self.s.index("}", self.i)
                low, comma, high = self.s[self.i : j].partition(",")
                self.i = j + 1
                m, n = int(low), (int(high) if high else None) if comma else int(low)
            else:
                m, n = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            x = ("rep", x, m, n)
        return x

    def atom(self):
        c = self.s[self.i]
        self.i += 1
        if c == "(":
            fold = self.fold
            if self.s.startswith("?i:", self.i):
                self.i, self.fold = self.i + 3, True
            elif self.s.startswith("?:", self.i):
                self.i += 2
            tree = self.alt()
            if self.s[self.i : self.i + 1] != ")":
                raise ValueError("missing )")
            self.i, self.fold = self.i + 1, fold
            return tree
        if c == "[":
            return ("set", self.char_class())
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        return ("set", self.folded({self.escape() if c == "\\" else ord(c)}))

    def escape(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def char_class(self) -> frozenset:
        negate = self.s[self.i] == "^"
        self.i += negate
        out: set[int] = set()
        while self.s[self.i] != "]" or not out:
            low = self.one()
            if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                out |= set(range(low, self.one() + 1))
            else:
                out.add(low)
        self.i += 1
        out = set(self.folded(out))
        return frozenset(set(range(256)) - out if negate else out)

    def one(self) -> int:
        c = self.s[self.i]
        self.i += 1
        return self.escape() if c == "\\" else ord(c)

    def folded(self, codes: set[int]) -> frozenset:
        if self.fold:
            codes = codes | {c ^ 32 for c in codes if chr(c).isascii() and chr(c).isalpha()}
        return frozenset(codes)


def _reverse(tree):
    kind = tree[0]
    if kind == "cat":
        return ("cat", [_reverse(x) for x in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [_reverse(x) for x in tree[1]])
    if kind == "rep":
        return ("rep", _reverse(tree[1]), tree[2], tree[3])
    return tree


class _Nfa:
    """Thompson's construction with epsilon edges."""

    def __init__(self):
        self.eps: list[list[int]] = []
        self.on: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.on.append(None)
        return len(self.eps) - 1

    def build(self, tree, at: int) -> int:
        """Add the tree from state `at`; the state after it."""
        kind = tree[0]
        if kind == "set":
            to = self.state()
            a = self.state()
            self.eps[at].append(a)
            self.on[a] = (tree[1], to)
            return to
        if kind == "cat":
            for x in tree[1]:
                at = self.build(x, at)
            return at
        if kind == "alt":
            out = self.state()
            for x in tree[1]:
                self.eps[self.build(x, at)].append(out)
            return out
        _, x, m, n = tree
        for _ in range(m):
            at = self.build(x, at)
        if n is None:
            loop = self.state()
            self.eps[at].append(loop)
            self.eps[self.build(x, loop)].append(loop)
            return loop
        out = self.state()
        for _ in range(n - m):
            self.eps[at].append(out)
            at = self.build(x, at)
        self.eps[at].append(out)
        return out

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Automaton:
    """classes[byte] -> symbol; step[state * width + symbol] -> next state * width; accept[state] -> rule bits.

    State 0 is the start. With search=True a match may start at any byte.
    """

    def __init__(self, patterns: Sequence[str], search: bool = True, backwards: bool = False):
        nfa = _Nfa()
        start = nfa.state()
        ends: dict[int, int] = {}
        for bit, pattern in enumerate(patterns):
            tree = _Parser(pattern).parse()
            ends[nfa.build(_reverse(tree) if backwards else tree, start)] = 1 << bit
        sets = {on[0] for on in nfa.on if on}
        signature = [tuple(b in s for s in sets) for b in range(256)]
        symbols = {sig: i for i, sig in enumerate(dict.fromkeys(signature))}
        self.classes = np.array([symbols[s] for s in signature], np.int32)
        sample = [signature.index(sig) for sig in symbols]
        width = len(sample)
        first = nfa.closure([start])
        # Only states with a byte edge and accepting states tell subsets apart.
        core = lambda states: frozenset(s for s in states if nfa.on[s] or s in ends)
        moves: dict[tuple[frozenset, int], frozenset] = {}
        ids, todo, rows = {core(first): 0}, [core(first)], []
        while len(rows) < len(todo):
            now, row = todo[len(rows)], []
            for k in range(width):
                to: set[int] = set(first) if search else set()
                for s in now:
                    on = nfa.on[s]
                    if on and sample[k] in on[0]:
                        if (key := (s, k)) not in moves:
                            moves[key] = nfa.closure([on[1]])
                        to |= moves[key]
                to = core(to)
                if to not in ids:
                    ids[to] = len(todo)
                    todo.append(to)
                row.append(ids[to])
            rows.append(row)
        accept = np.array([sum(ends.get(s, 0) for s in states) for states in todo], np.int64)
        self._minimise(np.array(rows, np.int64), accept)

    def _minimise(self, table: np.ndarray, accept: np.ndarray) -> None:
        """Refine the partition by accepted rules until no block has states that move to different blocks."""
        _, block = np.unique(accept, return_inverse=True)
        while True:
            _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
            if finer.max() == block.max():
                break
            block = finer
        # The start's block comes first.
        order = np.full(block.max() + 1, -1)
        order[block[0]] = 0
        rest = [b for b in range(block.max() + 1) if b != block[0]]
        order[rest] = np.arange(1, len(rest) + 1)
        block = order[block]
        _, member = np.unique(block, return_index=True)
        self.width = table.shape[1]
        self.n_states = len(member)
        self.accept = accept[member]
        self.step = (block[table[member]] * self.width).astype(np.int32).ravel()
        # Rules that accepted before a transition and no longer do after it: their match has ended.
        after = self.accept[self.step // self.width]
        self.ended = (np.repeat(self.accept, self.width) & ~after).astype(np.int32)
        self.dead = next((s for s in range(self.n_states) if not self.accept[s] and (self.step[s * self.width : (s + 1) * self.width] == s * self.width).all()), -1)

    def farthest(self, data: bytes, end: int, low: int) -> int:
        """Of a backwards automaton: the smallest start >= low of a match that ends at `end`, or -1."""
        state, best = 0, -1
        step, classes, accept, width = self.step, self.classes, self.accept, self.width
        dead = self.dead * width
        for i in range(end - 1, low - 1, -1):
            state = int(step[state + int(classes[data[i]])])
            if state == dead:
                break
            if accept[state // width]:
                best = i
        return best
