"""Secret scan by one combined deterministic automaton.

Every rule's regular expression is reversed and compiled: Thompson NFA,
subset construction over byte classes, minimisation by partition refinement into
transition rows. One automaton for all rules reads a text's bytes once, from the last to
the first; it accepts where some rule's match can start. At those places a
small automaton per rule, compiled the same way, finds the longest match.
That gives the leftmost, longest, non-overlapping matches of each rule.

The pass runs in blocks of bytes over an automaton whose accepting states
absorb; a block that ends there is read again step by step, so plain text
costs one table lookup per byte, and long texts bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import getitem

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, process_cache

WORD = "A-Za-z0-9"
#: kind: (expression, least length of what follows the first + repeat's start)
BASE = {
    "assign": "(<password>|<passwd>|<secret>|<token>|<api>_?<key>)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]+",
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
}
#: The method's own kinds: other credentials with a fixed form.
MORE = {
    "github": "gh[opsur]_[A-Za-z0-9]{36,}",
    "slack": "xox[abprs]-[A-Za-z0-9-]{10,}",
    "jwt": "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}",
    "pem": "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
    "google": "AIza[A-Za-z0-9_-]{35}",
    "login": "://[A-Za-z0-9._%+-]+:[^ \t-\r/@\"'<>]+@",
}
LEAST_ASSIGNED = 6
#: Kinds without a literal start: their least length is counted in the pass.
COUNTED = {"hex"}
BLOCK, CHECKED = 4096, 256


class Nfa:
    """Thompson construction. Syntax: literals, escapes, [classes], groups,
    |, ?, *, +, {m,}, {m,n}, {m}; <word> is the word in either case."""

    def __init__(self):
        self.eps: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def node(self) -> int:
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1

    def build(self, tree, at: int) -> int:
        """Adds the tree from state at; returns its end state."""
        kind = tree[0]
        if kind == "set":
            end = self.node()
            self.step[at] = (tree[1], end)
            nxt = self.node()
            self.eps[end].append(nxt)
            return nxt
        if kind == "cat":
            for t in tree[1]:
                at = self.build(t, at)
            return at
        if kind == "alt":
            end = self.node()
            for t in tree[1]:
                begin = self.node()
                self.eps[at].append(begin)
                self.eps[self.build(t, begin)].append(end)
            return end
        _, t, least, most = tree
        for _ in range(least):
            at = self.build(t, at)
        if most is None:
            loop, end = self.node(), self.node()
            self.eps[at] += [loop, end]
            back = self.build(t, loop)
            self.eps[back] += [loop2 := self.node()]
            self.eps[loop2] += [end]
            again = self.node()
            self.eps[loop2].append(again)
            self.eps[again].append(loop)
            return end
        end = self.node()
        for _ in range(most - least):
            self.eps[at].append(end)
            begin = self.node()
            self.eps[at].append(begin)
            at = self.build(t, begin)
        self.eps[at].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.eps[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def parse(rule: str):
    """The rule's tree, over bytes."""
    pos = 0

    def char() -> int:
        nonlocal pos
        c = rule[pos]
        pos += 1
        if c == "\\":
            c = rule[pos]
            pos += 1
        return ord(c)

    def atom():
        nonlocal pos
        c = rule[pos]
        if c == "(":
            pos += 1
            t = alt()
            pos += 1
            return t
        if c == "<":
            end = rule.index(">", pos)
            word, pos = rule[pos + 1 : end], end + 1
            return "cat", [("set", frozenset({ord(x.lower()), ord(x.upper())})) for x in word]
        if c == "[":
            pos += 1
            negate = rule[pos] == "^"
            pos += negate
            got: set[int] = set()
            while rule[pos] != "]":
                a = char()
                if rule[pos] == "-" and rule[pos + 1] != "]":
                    pos += 1
                    got |= set(range(a, char() + 1))
                else:
                    got.add(a)
            pos += 1
            return "set", frozenset(set(range(256)) - got if negate else got)
        return "set", frozenset({char()})

    def cat():
        nonlocal pos
        out = []
        while pos < len(rule) and rule[pos] not in "|)":
            t = atom()
            while pos < len(rule) and rule[pos] in "?*+{":
                c = rule[pos]
                pos += 1
                if c == "{":
                    end = rule.index("}", pos)
                    a, comma, b = rule[pos:end].partition(",")
                    pos = end + 1
                    t = ("rep", t, int(a), int(b) if b else (None if comma else int(a)))
                else:
                    t = ("rep", t, int(c == "+"), 1 if c == "?" else None)
            out.append(t)
        return "cat", out

    def alt():
        nonlocal pos
        out = [cat()]
        while pos < len(rule) and rule[pos] == "|":
            pos += 1
            out.append(cat())
        return ("alt", out) if len(out) > 1 else out[0]

    return alt()


def reverse(tree):
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return "rep", reverse(tree[1]), *tree[2:]
    return kind, [reverse(t) for t in (tree[1][::-1] if kind == "cat" else tree[1])]


def compiled(trees: list, search: bool) -> tuple[list[list[int]], list[int], bytes]:
    """Minimal automaton: rows by byte class, for each state the set of trees
    it accepts (as bits), and the byte classes. State 0 is the start. search:
    a match may begin anywhere."""
    nfa = Nfa()
    start = nfa.node()
    accept: dict[int, int] = {}
    for i, t in enumerate(trees):
        begin = nfa.node()
        nfa.eps[start].append(begin)
        accept[nfa.build(t, begin)] = 1 << i
    sets = list({s[0] for s in nfa.step if s})
    signs: dict[tuple[bool, ...], int] = {}
    classes = bytes(signs.setdefault(tuple(b in s for s in sets), len(signs)) for b in range(256))
    sample = [classes.index(k) for k in range(len(signs))]
    first = nfa.closure({start})
    number, rows, todo = {first: 0}, [], [first]
    for here in todo:  # subset construction; todo grows
        row = []
        for b in sample:
            to = {nfa.step[x][1] for x in here if nfa.step[x] and b in nfa.step[x][0]}
            nxt = nfa.closure(to | ({start} if search else set()))
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            row.append(number[nxt])
        rows.append(row)
    marks = [sum({accept[x] for x in here if x in accept}) for here in todo]
    rows, marks = minimal(rows, marks)
    return rows, marks, classes


def minimal(rows: list[list[int]], marks: list[int]) -> tuple[list[list[int]], list[int]]:
    """Partition refinement until no block is split."""
    block, n = list(marks), -1
    while True:
        names: dict[tuple, int] = {}
        block = [names.setdefault((block[i], *(block[x] for x in row)), len(names)) for i, row in enumerate(rows)]
        if len(names) == n:
            break
        n = len(names)
    out, kind = [[]] * n, [0] * n
    for i, row in enumerate(rows):
        out[block[i]], kind[block[i]] = [block[x] for x in row], marks[i]
    assert block[0] == 0
    return out, kind


def loosened(tree):
    """A tree of which every match of the given one has a prefix: counted
    repeats are cut to two, so that the combined automaton needs no counters
    for rules that start with a literal."""
    kind = tree[0]
    if kind == "rep":
        return ("rep", loosened(tree[1]), min(2, tree[2]), None if tree[3] != 1 else 1)
    return tree if kind == "set" else (kind, [loosened(t) for t in tree[1]])


class Row(list):
    """A state: the next state for each byte; accepts has the rules' bits."""

    __slots__ = ("accepts",)
    __hash__ = object.__hash__


def linked(rows: list[list[int]], marks: list[int], classes: bytes, absorb: bool) -> list[Row]:
    out = [Row() for _ in rows]
    for r, row, m in zip(out, rows, marks, strict=True):
        r.accepts = m
        r.extend([r] * 256 if absorb and m else [out[row[c]] for c in classes])
    return out


def tables(rules: dict[str, str]) -> tuple:
    """What a Scanner needs, in plain lists: made once by the driver."""
    trees = [parse(r) for r in rules.values()]
    return list(rules), compiled([reverse(t if k in COUNTED else loosened(t)) for k, t in zip(rules, trees, strict=True)], True), [compiled([t], False) for t in trees]


class Scanner:
    def __init__(self, made: tuple):
        self.kinds, (rows, marks, classes), single = made
        self.exact, self.fast = linked(rows, marks, classes, False), linked(rows, marks, classes, True)
        self.place = {id(r): i for i, r in enumerate(self.exact)}
        self.back = {id(r): i for i, r in enumerate(self.fast)}
        self.single = []
        for rows, marks, classes in single:
            dead = [i for i, r in enumerate(rows) if not marks[i] and all(x == i for x in r)]
            self.single.append((rows, marks, classes, dead[0] if dead else -1))

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """(position, rules' bits) of places where matches start, ascending."""
        out, row = [], self.exact[0]
        for end in range(len(data), 0, -BLOCK):
            block = data[max(0, end - BLOCK) : end][::-1]
            if not row.accepts:
                last = reduce(getitem, block, self.fast[self.place[id(row)]])
                if not last.accepts:
                    row = self.exact[self.back[id(last)]]
                    continue
            for i, b in enumerate(block, 1):
                row = row[b]
                if row.accepts:
                    out.append((end - i, row.accepts))
        return out[::-1]

    def longest(self, rule: int, data: bytes, at: int, failed: set[tuple[int, int]]) -> tuple[int, int]:
        """Ends of the shortest and the longest match that starts here.
        failed: places (every CHECKED bytes) and states from which no match was
        found before, so that many starts before a long run are read in it once."""
        rows, marks, classes, dead = self.single[rule]
        state, first, last = 0, -1, -1
        seen: list[tuple[int, int]] = []
        for i in range(at, len(data)):
            state = rows[state][classes[data[i]]]
            if state == dead:
                break
            if marks[state]:
                last = i + 1
                if first < 0:
                    first = last
            elif first < 0 and not i % CHECKED:
                if (i, state) in failed:
                    break
                seen.append((i, state))
        if first < 0:
            failed.update(seen)
        return first, last

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in bytes by start, then kind; leftmost, longest
        and non-overlapping per kind."""
        out, done = [], [0] * len(self.kinds)
        failed: list[set] = [set() for _ in self.kinds]
        for at, bits in self.starts(data):
            for k, kind in enumerate(self.kinds):
                if bits >> k & 1 and at >= done[k]:
                    first, last = self.longest(k, data, at, failed[k])
                    if last < 0:
                        continue
                    done[k] = last
                    if kind != "assign" or last - first + 1 >= LEAST_ASSIGNED:
                        out.append((kind, at, last))
        return out


def scan(text: str, scanner: Scanner) -> list[tuple[str, int, int]]:
    """Spans in code points."""
    data = text.encode("utf-8", "surrogatepass")
    got = scanner.spans(data)
    if len(data) != len(text) and got:
        at, place = 0, {}
        seen = 0
        for p in sorted({x for _, a, b in got for x in (a, b)}):
            seen += len(data[at:p].decode("utf-8", "surrogatepass"))
            at, place[p] = p, seen
        got = [(k, place[a], place[b]) for k, a, b in got]
    return got


def default_tables() -> tuple:
    cache = process_cache("secrets")
    return cache.get("tables") or cache.setdefault("tables", tables({**BASE, **MORE}))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scanned(made: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = process_cache("secrets")
        scanner = cache.get("scanner") or cache.setdefault("scanner", Scanner(made))
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for t in b.column("text"):
                got = scan(t.as_py(), scanner)
                base = [s for s in got if s[0] in BASE]
                for o, k in zip(out, BASE, strict=False):
                    o.append(sum(s[0] == k for s in base))
                out[3].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out[4].append(_joined(got))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string()), pa.array(out[4], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, base_sha256 and spans
    (kind:start:end by start, then kind as listed; base kinds first).
    Null and empty texts have no spans; texts may be of any length. Of matches
    of one kind the leftmost wins, of those with one start the longest. Repeated
    rows get equal results, an empty table has none, extra columns are ignored."""
    return documents(docs).mapInArrow(_scanned(default_tables()), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
