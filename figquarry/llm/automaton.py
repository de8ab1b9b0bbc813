"""Regular expressions to one minimal deterministic automaton over bytes.

Rules are parsed to a Thompson automaton, made deterministic by subset construction over classes of bytes that no
rule tells apart, and minimised by partition refinement. What is left is an array of transitions: scanning is one
look-up a byte, whatever the number of rules. Syntax: literals, \\xHH, escapes, [classes], groups, |, ?, *, +,
{m}, {m,} and {m,n}; a rule may ignore the case of ASCII letters.
"""

from __future__ import annotations

from dataclasses import dataclass, field


class _Parser:
    """Recursive descent; builds fragments (start, end) of the automaton `nfa` as it goes."""

    def __init__(self, pattern: str, ignore_case: bool, nfa: _Nfa) -> None:
        self.p, self.i, self.ignore_case, self.nfa = pattern, 0, ignore_case, nfa

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def alternatives(self) -> tuple[int, int]:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        start, end = self.nfa.state(), self.nfa.state()
        for a, b in parts:
            self.nfa.free[start].append(a)
            self.nfa.free[b].append(end)
        return start, end

    def sequence(self) -> tuple[int, int]:
        start = end = self.nfa.state()
        while self.peek() not in ("", "|", ")"):
            a, b = self.repeated()
            self.nfa.free[end].append(a)
            end = b
        return start, end

    def repeated(self) -> tuple[int, int]:
        at = self.i
        a, b = self.atom()
        end_of_atom, c = self.i, self.peek()
        if c == "{":
            close = self.p.index("}", self.i)
            low, _, high = self.p[self.i + 1 : close].partition(",")
            least = int(low)
            most = least if "," not in self.p[self.i : close] else int(high) if high else None
            self.i = close + 1
        elif c and c in "?*+":
            least, most = (1 if c == "+" else 0), (1 if c == "?" else None)
            self.i += 1
        else:
            return a, b
        after = self.i

        def copy() -> tuple[int, int]:
            self.i = at
            got = self.atom()
            assert self.i == end_of_atom
            return got

        free = self.nfa.free
        start = end = self.nfa.state()
        for _ in range(least):
            x, y = copy()
            free[end].append(x)
            end = y
        if most is None:
            x, y = copy()
            free[end].append(x)
            free[y].append(end)
        for _ in range((most or 0) - least):
            x, y = copy()
            free[end].append(x)
            out = self.nfa.state()
            free[end].append(out)
            free[y].append(out)
            end = out
        self.i = after
        return start, end

    def atom(self) -> tuple[int, int]:
        c = self.peek()
        if c == "(":
            self.i += 1
            got = self.alternatives()
            assert self.peek() == ")", self.p
            self.i += 1
            return got
        members = self.charset() if c == "[" else {self.char()}
        if self.ignore_case:
            members |= {x ^ 32 for x in members if chr(x).isalpha() and x < 128}
        a, b = self.nfa.state(), self.nfa.state()
        self.nfa.moves[a].append((frozenset(members), b))
        return a, b

    def char(self) -> int:
        c = self.peek()
        self.i += 1
        if c == "\\":
            c = self.peek()
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
        if ord(c) > 127:
            raise ValueError("rules are written in ASCII")
        return ord(c)

    def charset(self) -> set[int]:
        self.i += 1
        negated = self.peek() == "^"
        self.i += negated
        members: set[int] = set()
        while self.peek() != "]":
            low = high = self.char()
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                high = self.char()
            members |= set(range(low, high + 1))
        self.i += 1
        return set(range(256)) - members if negated else members


@dataclass
class _Nfa:
    free: list[list[int]] = field(default_factory=list)
    moves: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def turned(self) -> _Nfa:
        """The automaton with every edge the other way."""
        out = _Nfa([[] for _ in self.free], [[] for _ in self.moves])
        for s, (free, moves) in enumerate(zip(self.free, self.moves)):
            for t in free:
                out.free[t].append(s)
            for members, t in moves:
                out.moves[t].append((members, s))
        return out


@dataclass
class Automaton:
    """table[state + class of byte] is the next state. States are multiples of width, those from `accepts` on accept rules."""

    classes: bytes
    width: int
    table: list[int]
    start: int
    dead: int
    accepts: int
    rules: dict[int, tuple[int, ...]]

    def starts(self, data: bytes) -> dict[int, list[int]]:
        """By rule, where in data a match starts, ascending: one pass from the last byte to the first (for an automaton
        made with anchored=False, backward=True)."""
        s, table, accepts, hits = self.start, self.table, self.accepts, []
        for i, c in enumerate(reversed(data.translate(self.classes)), 1):
            s = table[s + c]
            if s >= accepts:
                hits.append((i, s))
        found: dict[int, list[int]] = {}
        for i, s in reversed(hits):
            for rule in self.rules[s]:
                found.setdefault(rule, []).append(len(data) - i)
        return found

    def longest(self, coded: bytes, at: int) -> int:
        """The end of the longest match that starts at `at` of data that has been translated by classes, or -1."""
        s, table, accepts, dead, end = self.start, self.table, self.accepts, self.dead, -1
        for i in range(at, len(coded)):
            s = table[s + coded[i]]
            if s >= accepts:
                end = i + 1
            elif s == dead:
                break
        return end


def build(rules: list[tuple[str, bool]], anchored: bool, backward: bool = False) -> Automaton:
    """rules: (pattern, ignore case). anchored: matches start at the first byte read, else at any byte. backward: the
    automaton reads texts from their end; then it accepts where matches start."""
    nfa, ends = _Nfa(), {}
    fragments = []
    for pattern, ignore_case in rules:
        parser = _Parser(pattern, ignore_case, nfa)
        fragments.append(parser.alternatives())
        assert parser.i == len(pattern), pattern
    if backward:
        nfa, fragments = nfa.turned(), [(b, a) for a, b in fragments]
    start = nfa.state()
    for k, (a, b) in enumerate(fragments):
        nfa.free[start].append(a)
        ends[b] = k
    kinds: dict[tuple, int] = {}
    sets = list({m for moves in nfa.moves for m, _ in moves})
    classes = bytes(kinds.setdefault(tuple(b in m for m in sets), len(kinds)) for b in range(256))
    width = len(kinds)
    sample = [classes.index(c) for c in range(width)]

    def closure(states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in nfa.free[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(s for s in out if nfa.moves[s] or s in ends)

    steps = [[closure({t for m, t in moves if b in m}) if moves else frozenset() for b in sample] for moves in nfa.moves]
    first = closure({start})
    number, todo, rows = {first: 0}, [first], []
    while todo:
        states = todo.pop()
        row = [0] * width
        for c in range(width):
            to = frozenset().union(*[steps[s][c] for s in states], () if anchored else first)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row[c] = number[to]
        rows.append((number[states], row))
    table = [row for _, row in sorted(rows)]
    label = [tuple(sorted({ends[s] for s in states if s in ends})) for states in number]
    block = _minimal(table, label)
    # blocks in order of acceptance, so that one comparison tells whether a state accepts
    accepting = {b: label[i] for i, b in enumerate(block)}
    order = {b: k for k, b in enumerate(sorted(accepting, key=lambda b: bool(accepting[b])))}
    out = [0] * (len(order) * width)
    for i, row in enumerate(table):
        at = order[block[i]] * width
        out[at : at + width] = [order[block[t]] * width for t in row]
    dead = next((order[b] * width for b in order if not accepting[b] and all(x == order[b] * width for x in out[order[b] * width : order[b] * width + width])), -1)
    return Automaton(classes, width, out, order[block[0]] * width, dead, sum(not accepting[b] for b in order) * width, {order[b] * width: r for b, r in accepting.items() if r})


def _minimal(table: list[list[int]], label: list[tuple[int, ...]]) -> list[int]:
    """The block of each state: states are together if no input tells which rules accept from them (Moore's refinement)."""
    names: dict = {}
    block = [names.setdefault(x, len(names)) for x in label]
    while True:
        names = {}
        finer = [names.setdefault((block[i], *[block[t] for t in row]), len(names)) for i, row in enumerate(table)]
        if len(names) == len(set(block)):
            return block
        block = finer
