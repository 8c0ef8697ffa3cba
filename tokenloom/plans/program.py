"""Rules as data: each pattern as a small graph whose edges are runs of single tokens.

A rule's graph has a node behind each run, and node 0 before all. An edge leads from a node over an ellipsis, or over nothing,
and then a run, to the node behind it. Branches of an alternation are edges beside each other, a repetition is a cycle. All
rules' runs, edges, accepting nodes and names are rows of small tables, so that a plan does not grow with their
number.
"""

from __future__ import annotations

import base64
import json
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from tokenloom.functions.captures import TRANSFORMS, transforms_of
from tokenloom.functions.structure import BOUNDS
from tokenloom.plans.pattern import Item, Pattern

#: Items that test a token and leave captures alone.
PLAIN = ("byte", "token", "level", "any")
SINGLE = ("byte", "token", "level", "capture", "back", "any", "replace", "pop")
#: Tests of a run's tokens; CLOSER: the token that closes the bracket, named in the text, that is open behind the token before, over an ellipsis.
BYTE, TOKEN, LEVEL, ANY, CLOSER = range(5)
#: What an edge does with a token: equal to a capture, becomes one, hands one on, span begins, span ends.
BACK, SET, POP, BEGIN, FINISH = range(5)
#: Kinds of ways to a run: next to it, after any tokens, or within one of BOUNDS.
NEXT, FREE = "next", "free"
_CLOSERS = {"round": ")", "square": "]", "curly": "}", "corner": ">"}

#: A run: (test, text, level) of each token, and pairs of tokens that have to be equal. Its tokens are next to each other but for closers.
Run = tuple[tuple[tuple[int, str, int], ...], tuple[tuple[int, int], ...]]

OPS = "ops array<struct<op:int,k:int,a:int,b:int>>"
#: What the ops of an edge come to, see settled().
SETTLED = "equal array<array<int>>, sources array<int>, begin int, finish int"
EDGES = f"rule int, node int, kind string, run int, target int, {OPS}, closed boolean, back_k int, back_slot int, size int, languages array<string>"
RULES = f"rule int, name string, grp struct<name:string,unique:boolean,cancel:boolean,match:array<string>>, slots array<string>, out map<string,string>, transforms {TRANSFORMS}"
ACCEPTED = "rule int, node int, ways int"
ANCHORED = "map<string,array<struct<run:int,offset:int,wanted:array<struct<k:int,t:binary,l:int>>,equal:array<array<int>>>>>"


def run_of(items: Iterable[Item]) -> Run:
    wanted, equal, captured, over = [], [], {}, ""
    for x in items:
        if x.kind == "skip":
            over = x.text
            continue
        k = len(wanted)
        if over:
            wanted.append((CLOSER, over, 0))
            over = ""
            continue
        test = {"byte": BYTE, "token": TOKEN, "level": LEVEL}.get(x.kind, ANY)
        wanted.append((test, x.text if test in (BYTE, TOKEN) else "", int(x.text) if test == LEVEL else 0))
        if x.kind == "back" and x.text in captured:
            equal.append((captured[x.text], k))
        elif x.kind in ("capture", "replace"):
            captured[x.text] = k
        elif x.kind == "pop":
            for name in x.text.split("\n"):
                captured.pop(name, None)
    return tuple(wanted), tuple(equal)


def captures_of(items: Iterable[Item]) -> list[str]:
    """All capture names, those inside repetitions too."""
    out: dict[str, None] = {}
    for x in items:
        if x.kind == "capture":
            out[x.text] = None
        for b in x.branches:
            out |= dict.fromkeys(captures_of(b))
    return list(out)


def depths_needed(patterns: Iterable[Pattern]) -> tuple[str, ...]:
    """The bounds (of BOUNDS) that the ellipses of the patterns need; `statement` brings `scope`."""

    def walk(items: Iterable[Item]) -> Iterable[str]:
        for x in items:
            if x.kind == "skip" and x.text != FREE:
                yield x.text
            for b in x.branches:
                yield from walk(b)

    found = {d for p in patterns for d in walk(p.items)}
    return tuple(d for d in BOUNDS if d in found or d == "scope" and "statement" in found)


def settled(ops: Iterable[tuple[int, int, int, int]], slots: int, width: int) -> tuple[list[list[int]], list[int], int, int]:
    """What ops come to: pairs of a token and a source that have to be equal, the source of each slot, and the tokens at which a span begins and ends (-1: none).

    A source from 0 is a token of the run, -1 - j is what slot j was before. No sources: all slots stay. Slots from `slots` to `width` are of other rules and
    null; slot `width` always is.
    """
    same = [-1 - j for j in range(slots)] + [-1 - width] * (width - slots)
    sources, equal, begin, finish = list(same), [], -1, -1
    for op, k, a, b in ops:
        if op == BACK:
            equal.append([k, sources[a]])
        elif op == SET:
            sources[a] = k
        elif op == POP:
            equal.append([k, sources[b]])
            sources[a], sources[b] = -1 - width, sources[a]
        elif op == BEGIN:
            begin = k
        else:
            finish = k
    return equal, [] if sources == same else sources, begin, finish


@dataclass
class Program:
    """The tables of some rules."""

    runs: dict[Run, int] = field(default_factory=dict)
    edges: list[tuple] = field(default_factory=list)
    accepted: list[tuple] = field(default_factory=list)
    rules: list[tuple] = field(default_factory=list)
    #: Bounds that are asked for behind a run; node 0 of rules that begin with an ellipsis.
    bounds_after: dict[int, set[str]] = field(default_factory=dict)
    begins: list[tuple] = field(default_factory=list)
    #: Repetitions of single runs without captures: (rule, node, loop), and their runs: (loop, run).
    loops: list[tuple] = field(default_factory=list)
    bodies: dict[tuple[int, ...], int] = field(default_factory=dict)
    #: Whether the runs that begin rules go on over ellipses to the brackets that close them, see closes().
    fused: bool = False

    @staticmethod
    def of(patterns: list[Pattern], fused: bool = False) -> Program:
        program = Program(fused=fused)
        for rule, p in enumerate(patterns):
            _Rule(program, rule, p).add()
        return program

    def longest(self) -> int | None:
        """The most edges in a row of any rule; None if some rule has a cycle."""
        after: dict[tuple[int, int], set[int]] = {}
        for rule, node, _, _, target, *_ in self.edges:
            after.setdefault((rule, node), set()).add(target)
        found: dict[tuple[int, int], int | None] = {}

        def length(rule: int, node: int) -> int | None:
            key = (rule, node)
            if key not in found:
                found[key] = None  # met again before it is known: a cycle
                below = [length(rule, t) for t in after.get(key, ())]
                found[key] = None if None in below else 1 + max(below, default=-1)
            return found[key]

        lengths = [length(rule, 0) for rule in {r for r, *_ in self.edges}]
        return None if None in lengths else max(lengths, default=0)

    def anchored(self) -> tuple[str, list[str], list[tuple[int, Run]]]:
        """Runs with a fixed token, as JSON of ANCHORED by that token; the tokens; and the runs without one."""
        table: dict[str, list[dict]] = {}
        rest = []
        for (wanted, equal), number in self.runs.items():
            anchor = next((k for test in (TOKEN, BYTE) for k, w in enumerate(wanted) if w[0] == test), None)
            if anchor is None:
                rest.append((number, (wanted, equal)))
                continue
            tests = [{"k": k, "t": base64.b64encode(t.encode()).decode(), "l": lv} for k, t, lv in wanted]
            table.setdefault(wanted[anchor][1], []).append({"run": number, "offset": anchor, "wanted": tests, "equal": [list(e) for e in equal]})
        return json.dumps(table), sorted(table), rest


#: Open ways: (node, ellipsis) and how many ways lead there.
Open = Counter


class _Rule:
    def __init__(self, program: Program, rule: int, pattern: Pattern):
        self.program, self.rule, self.pattern = program, rule, pattern
        self.names = captures_of(pattern.items)
        self.nodes = 0
        self.turning = False
        self.twice: set[int] = set()  # nodes inside repetitions, after the first turn
        self.runs_at: dict[int, set[int]] = {}  # node -> the runs before it

    def add(self) -> None:
        p, program = self.pattern, self.program
        items = list(p.items)
        while items and items[-1].kind == "skip":
            items.pop()
        ways: Counter = Counter()
        for (node, _), n in self.follow(Counter({(0, NEXT): 1}), items).items():
            if node:
                ways[node] += n
        program.accepted += [(self.rule, node, n) for node, n in ways.items()]
        group = (p.group, p.unique, p.cancel, list(p.match))
        program.rules.append((self.rule, p.name, group, self.names, dict(p.out), transforms_of(p.transform, tuple(self.names))))

    def closes(self, ways: Open, run: list[Item], items: Sequence[Item], n: int) -> bool:
        """Whether items[n] is an ellipsis from the rule's first run to the bracket that ends it: there is one such place, known without a join."""
        ends = n + 1 < len(items) and items[n].kind == "skip" and items[n + 1].kind == "byte" and items[n + 1].text == _CLOSERS.get(items[n].text)
        return self.program.fused and ends and bool(run) and not self.turning and set(ways) == {(0, NEXT)}

    def follow(self, ways: Open, items: Sequence[Item]) -> Open:
        run: list[Item] = []
        for n, x in enumerate(items):
            if x.kind in SINGLE or self.closes(ways, run, items, n):
                run.append(x)
                continue
            ways, run = self.run(ways, run), []
            if x.kind == "skip":
                over: Counter = Counter()
                for (node, _), n in ways.items():
                    over[node, x.text] += n
                ways = over
            elif x.kind == "either":
                ways = sum((self.follow(ways, b) for b in x.branches), Counter())
            else:
                ways = self.turns(ways, x.branches)
        return self.run(ways, run)

    def turns(self, ways: Open, branches: tuple[tuple[Item, ...], ...]) -> Open:
        """Any number of turns: what a branch leads to leads into all branches again.

        Turns of single runs that leave captures alone are one node, on which the scan composes turns by doubling.
        """
        if all(kind == NEXT for _, kind in ways) and all(x.kind in PLAIN for b in branches for x in b):
            self.nodes += 1
            node, before = self.nodes, len(self.program.edges)
            for b in branches:
                self.run(ways, list(b), node)
            body = tuple(sorted(e[3] for e in self.program.edges[before:] if e[1] == next(iter(ways))[0]))
            loop = self.program.bodies.setdefault(body, len(self.program.bodies))
            self.program.loops.append((self.rule, node, loop))
            return ways + Counter({(node, NEXT): 1})
        all_, fresh = Counter(ways), ways
        first, self.turning = self.nodes, True
        while fresh:
            reached: Counter = Counter()
            self.nodes = first  # each turn goes through the same nodes
            for b in branches:
                reached += self.follow(fresh, b)
            self.twice.update(range(first + 1, self.nodes + 1))
            fresh = Counter({k: 1 for k in reached if k not in all_})
            all_ += fresh
        self.turning = False
        return all_

    def run(self, ways: Open, items: list[Item], target: int = 0) -> Open:
        """Edges from all open ways over the run to a new node, or to `target`."""
        if not items:
            return ways
        program, names = self.program, self.names
        shape = run_of(items)
        number = program.runs.setdefault(shape, len(program.runs))
        items = [x for x in items if x.kind != "skip"]
        if not target:
            self.nodes += 1
            target = self.nodes
        ops: list[tuple[int, int, int, int]] = []
        back: tuple[int, int] | None = None
        touched: set[str] = set()
        for k, x in enumerate(items):
            if x.kind == "back":
                ops.append((BACK, k, names.index(x.text), 0))
                if back is None and x.text not in touched:
                    back = (k, names.index(x.text))
            elif x.kind in ("capture", "replace"):
                ops.append((SET, k, names.index(x.text), 0))
                touched.add(x.text)
            elif x.kind == "pop":
                new, old = x.text.split("\n")
                ops.append((POP, k, names.index(new), names.index(old)))
                touched |= {new, old}
            ops += [(BEGIN, k, 0, 0)] * x.start + [(FINISH, k, 0, 0)] * x.end
        for (node, kind), n in ways.items():
            closed = items[0].kind == "byte" and items[0].text == _CLOSERS.get(kind)
            if kind not in (NEXT, FREE):
                for before in self.runs_at.get(node, ()):
                    program.bounds_after.setdefault(before, set()).add(kind)
            if not node and kind != NEXT:
                program.begins.append((self.rule, kind, list(self.pattern.languages)))
            edge = (self.rule, node, kind, number, target, ops, closed, *(back or (-1, -1)), len(items), list(self.pattern.languages))
            if target not in self.twice or edge not in program.edges:  # a turn of a repetition comes here again
                program.edges += [edge] * n
        self.runs_at.setdefault(target, set()).add(number)
        return Counter({(target, NEXT): 1})
