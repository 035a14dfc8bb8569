"""Byte automata: a small regex dialect, subset construction, minimisation, transition arrays.

The dialect: literals, escapes (\\xHH, \\n and the like, escaped signs), classes with ranges and negation,
groups, alternation, ``? * +`` and ``{n}`` / ``{n,m}`` / ``{n,}``. A leading ``(?i)`` folds ASCII case.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.steps: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.steps.append([])
        return len(self.empty) - 1


class _Parser:
    """Recursive descent to a tree of tuples."""

    def __init__(self, text: str) -> None:
        self.fold = text.startswith("(?i)")
        self.s, self.i = text[4:] if self.fold else text, 0

    def parse(self):
        node = self.alternation()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i} in {self.s!r}")
        return node

    def alternation(self):
        options = [self.sequence()]
        while self.i < len(self.s) and self.s[self.i] == "|":
            self.i += 1
            options.append(self.sequence())
        return ("or", options) if len(options) > 1 else options[0]

    def sequence(self):
        items = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            items.append(self.repeat())
        return ("seq", items)

    def repeat(self):
        node = self.atom()
        while self.i < len(self.s) and self.s[self.i] in "?*+{":
            c = self.s[self.i]
            self.i += 1
            if c == "{":
                end = self.s.index("}", self.i)
                low, _, high = self.s[self.i : end].partition(",")
                lo, hi = int(low), (int(high) if high else None if "," in self.s[self.i : end] else int(low))
                self.i = end + 1
            else:
                lo, hi = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("rep", node, lo, hi)
        return node

    def escape(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return {"n": 10, "r": 13, "t": 9, "f": 12, "v": 11}.get(c, ord(c))

    def folded(self, chars: set[int]) -> frozenset[int]:
        if self.fold:
            chars |= {c ^ 32 for c in chars if chr(c).isalpha() and c < 128}
        return frozenset(chars)

    def atom(self):
        c = self.s[self.i]
        self.i += 1
        if c == "(":
            if self.s.startswith("?:", self.i):
                self.i += 2
            node = self.alternation()
            if self.i >= len(self.s):
                raise ValueError(f"unclosed group in {self.s!r}")
            self.i += 1
            return node
        if c == "[":
            return ("set", self.klass())
        if c == ".":
            return ("set", frozenset(set(range(256)) - {10}))
        if c == "\\":
            return ("set", self.folded({self.escape()}))
        if ord(c) > 127:
            return ("seq", [("set", frozenset({b})) for b in c.encode()])
        return ("set", self.folded({ord(c)}))

    def klass(self) -> frozenset[int]:
        chars: set[int] = set()
        negated = self.s[self.i] == "^"
        self.i += negated
        first = True
        while first or self.s[self.i] != "]":
            first = False
            lo = self.s[self.i]
            self.i += 1
            lo = self.escape() if lo == "\\" else ord(lo)
            hi = lo
            if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                hi = self.s[self.i]
                self.i += 1
                hi = self.escape() if hi == "\\" else ord(hi)
            chars.update(range(lo, hi + 1))
        self.i += 1
        chars = set(self.folded(chars))
        return frozenset(set(range(256)) - chars if negated else chars)


def _mirrored(node):
    """The tree of the reversed texts."""
    kind = node[0]
    if kind == "seq":
        return ("seq", [_mirrored(x) for x in reversed(node[1])])
    if kind == "or":
        return ("or", [_mirrored(x) for x in node[1]])
    return ("rep", _mirrored(node[1]), *node[2:]) if kind == "rep" else node


def _build(nfa: _Nfa, node, start: int) -> int:
    """Add node after state start; returns its end state."""
    kind = node[0]
    if kind == "set":
        end = nfa.state()
        nfa.steps[start].append((node[1], end))
        return end
    if kind == "seq":
        for x in node[1]:
            start = _build(nfa, x, start)
        return start
    if kind == "or":
        end = nfa.state()
        for x in node[1]:
            a = nfa.state()
            nfa.empty[start].append(a)
            nfa.empty[_build(nfa, x, a)].append(end)
        return end
    _, inner, lo, hi = node
    for _ in range(lo):
        start = _build(nfa, inner, start)
    if hi is None:
        loop = nfa.state()
        nfa.empty[start].append(loop)
        nfa.empty[_build(nfa, inner, loop)].append(loop)
        return loop
    ends = [start]
    for _ in range(hi - lo):
        start = _build(nfa, inner, start)
        ends.append(start)
    out = nfa.state()
    for e in ends:
        nfa.empty[e].append(out)
    return out


@dataclass(frozen=True)
class Dfa:
    """Transitions over byte classes. State 0 starts; accepts[q] is a bit mask of rules; dead is -1 if there is none."""

    classes: bytes
    table: tuple[tuple[int, ...], ...]
    accepts: tuple[int, ...]
    dead: int

    def longest(self, data: bytes, start: int, end: int) -> int:
        """End of the longest match that begins at start, or -1."""
        q, best = 0, -1
        table, accepts, classes, dead = self.table, self.accepts, self.classes, self.dead
        for i in range(start, end):
            q = table[q][classes[data[i]]]
            if q == dead:
                return best
            if accepts[q]:
                best = i + 1
        return best

    def starts(self, data: bytes, start: int, end: int) -> list[int]:
        """Places where a match begins, in falling order, told by one pass backwards. For an automaton of the
        reversed texts that accepts anywhere."""
        q, out = 0, []
        table, accepts, classes = self.table, self.accepts, self.classes
        for i in range(end - 1, start - 1, -1):
            q = table[q][classes[data[i]]]
            if accepts[q]:
                out.append(i)
        return out

    def seen(self, data: bytes, start: int, end: int) -> int:
        """Mask of the rules accepted anywhere in one pass."""
        q, mask = 0, 0
        table, accepts, classes = self.table, self.accepts, self.classes
        for i in range(start, end):
            q = table[q][classes[data[i]]]
            mask |= accepts[q]
        return mask

    def resets(self) -> np.ndarray:
        """Which bytes lead every state back to the start: a text may be cut behind them."""
        back = [all(row[c] == 0 for row in self.table) for c in range(len(self.table[0]))]
        return np.array([back[c] for c in self.classes], dtype=bool)


def compile_rules(rules: list[str], anywhere: bool, mirrored: bool = False) -> Dfa:
    """One minimal automaton for all rules: subset construction over byte classes, then partition refinement.

    anywhere: a match may begin at any byte (the start set is kept alive), else only at the first. mirrored: the
    automaton reads texts from their end.
    """
    nfa = _Nfa()
    first = nfa.state()
    finals = {}
    for k, rule in enumerate(rules):
        a = nfa.state()
        nfa.empty[first].append(a)
        tree = _Parser(rule).parse()
        finals[_build(nfa, _mirrored(tree) if mirrored else tree, a)] = 1 << k
    sets = sorted({s for steps in nfa.steps for s, _ in steps}, key=sorted)
    signature: dict[tuple, int] = {}
    classes = bytearray(256)
    for b in range(256):
        classes[b] = signature.setdefault(tuple(b in s for s in sets), len(signature))
    sample = {c: b for b, c in reversed(list(enumerate(classes)))}

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    start = closure({first})
    index, order, table = {start: 0}, [start], []
    for current in order:
        row = []
        for c in range(len(signature)):
            step = {t for q in current for s, t in nfa.steps[q] if sample[c] in s}
            after = closure(step | ({first} if anywhere else set()))
            if after not in index:
                index[after] = len(order)
                order.append(after)
            row.append(index[after])
        table.append(row)
    accepts = [sum(finals[q] for q in s if q in finals) for s in order]
    block = accepts[:]
    while True:
        keys = {}
        refined = [keys.setdefault((block[q], *(block[t] for t in table[q])), len(keys)) for q in range(len(table))]
        if len(keys) == len(set(block)):
            break
        block = refined
    block = refined
    names: dict[int, int] = {}
    for q in range(len(table)):
        names.setdefault(block[q], len(names))
    small = [None] * len(names)
    masks = [0] * len(names)
    for q in range(len(table)):
        small[names[block[q]]] = tuple(names[block[t]] for t in table[q])
        masks[names[block[q]]] = accepts[q]
    dead = next((q for q, row in enumerate(small) if not masks[q] and all(t == q for t in row)), -1)
    return Dfa(bytes(classes), tuple(small), tuple(masks), dead)


class Scanner:
    """Finds the stretches of many texts that hold a match of any rule, in one pass over the bytes.

    The texts are cut into lanes behind bytes that reset the automaton, and all lanes advance together:
    one step of the transition array moves every lane by one byte. Accepting states are absorbing.
    """

    LANE = 512

    def __init__(self, dfa: Dfa) -> None:
        n, width = len(dfa.table), len(dfa.table[0])
        hit = n
        flat = np.full((n + 1, width), hit, dtype=np.int32)
        for q, row in enumerate(dfa.table):
            if not dfa.accepts[q]:
                flat[q] = [hit if dfa.accepts[t] else t for t in row]
        self.flat, self.hit = (flat * width).ravel(), hit * width
        self.classes, self.reset = dfa.classes, dfa.resets()

    def lanes(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of lanes: cut at bounds (text ends) and, past LANE bytes, at the next reset byte."""
        cuts = np.flatnonzero(self.reset[data]) + 1
        if len(cuts):
            slot = cuts // self.LANE
            cuts = cuts[np.r_[True, slot[1:] != slot[:-1]]]
        ends = np.union1d(cuts, bounds)
        starts = np.r_[0, ends[:-1]]
        keep = ends > starts
        return starts[keep], ends[keep]

    def __call__(self, data: bytes, bounds: np.ndarray) -> list[tuple[int, int]]:
        """Lanes with a hit, in order."""
        if not data:
            return []
        raw = np.frombuffer(data, dtype=np.uint8)
        step = np.frombuffer(data.translate(self.classes), dtype=np.uint8)
        starts, ends = self.lanes(raw, bounds)
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        at, lengths = starts[order].copy(), lengths[order]
        state = np.zeros(len(at), dtype=np.int32)
        alive = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")
        for live in alive.tolist():
            view, place = state[:live], at[:live]
            view += step.take(place)
            self.flat.take(view, out=view, mode="clip")
            place += 1
        found = np.sort(order[state == self.hit])
        return [(int(starts[i]), int(ends[i])) for i in found]
