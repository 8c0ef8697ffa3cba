"""All rules over the token lists of files, in one loop of joins.

A state is a partial match of a rule: where it began, its node in the rule's graph, the next token `pos`, its captures, its
span and the depths that its ellipses carry. The runs of single tokens of all rules are found in one reading of the token
lists: where a token stands that some run has to have, the runs that have it are held against the tokens around it. Each
round joins all states of all rules with the edges of their nodes (a small table) and then with the runs that these ask
for. Where an ellipsis ends is known before: a run's row has, for each bracket that is open behind it, the place where
it is closed, so each state asks for runs between two places. The join's key is a bin of the places at the scale of
that distance, so that a state meets few runs outside it, and a back-reference's value where the run has one.
Every way in which a pattern matches gives a row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import tokenize as tk
from tokenloom.functions.captures import fits_early, transformed
from tokenloom.functions.shared import cut
from tokenloom.functions.structure import DEPTHS
from tokenloom.functions.tokenize import as_text
from tokenloom.plans import program as pg
from tokenloom.plans.pattern import Pattern
from tokenloom.plans.program import Program, depths_needed

#: Runs up to which each is looked for by itself; beyond it the tokens tell which runs to try.
FEW = 4
#: Behind every place of a file.
FAR = (1 << 31) - 1
_SPAN = "struct<offset:bigint,column:bigint,line:bigint>"


class Runs:
    """What a file's row tells of the runs in it. bounds: those of BOUNDS that the rules need."""

    def __init__(self, program: Program, bounds: tuple[str, ...]):
        self.program, self.bounds = program, bounds
        self.depths = [d for d in bounds if d in DEPTHS]

    @staticmethod
    def place(i: Column, *columns: str) -> Column:
        return F.struct(*(F.get(c, i).cast("long").alias(n) for c, n in zip(columns, ("offset", "column", "line"), strict=True)))

    def at(self, pos: Column) -> Column:
        """The depths before token pos, in the order of self.depths."""
        return F.array(*(F.get(d, pos) for d in self.depths)).cast("array<int>")

    @staticmethod
    def closers(pos: Column, bound: str) -> Column:
        """The places at pos or later where the depth falls below that before pos, below one less, and so on; as many as brackets are open and closed later."""
        depth = bound if bound in DEPTHS else "scope"
        ends = bound == "statement"

        def step(state: Column, _: Column) -> Column:
            p = state["p"]
            fall = F.get(f"next_{depth}", p)
            falls = fall >= 0
            by = F.get(depth, p) - F.get(depth, fall + 1)
            if ends:
                own = F.get("next_statement", p)
                found = F.concat(F.array(F.when(own >= 0, own)), F.when(falls, F.array_repeat(fall, by - 1)).otherwise(F.array().cast("array<int>")))
            else:
                found = F.array_repeat(fall, by)
            known = p >= 0
            return F.struct(F.when(known & falls, fall + 1).otherwise(-1).alias("p"), F.when(known & (falls | F.lit(ends)), F.concat(state["all"], found)).otherwise(state["all"]).alias("all"))

        start = F.struct(pos.cast("int").alias("p"), F.array().cast("array<int>").alias("all"))
        times = F.get(f"left_{depth}", pos) + int(ends)
        return F.when(times > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(times, F.lit(1))), start, step, lambda s: s["all"])).otherwise(F.array().cast("array<int>"))

    def stops(self, pos: Column, run: Column | None) -> Column:
        """closers() for each of self.bounds, where some rule asks for them behind the run."""
        wanted = {b: [r for r, kinds in self.program.bounds_after.items() if b in kinds] for b in self.bounds}
        none = F.array().cast("array<int>")
        return F.array(*(self.closers(pos, b) if run is None else F.when(run.isin(wanted[b]), self.closers(pos, b)).otherwise(none) if wanted[b] else none for b in self.bounds)).cast("array<array<int>>")

    def span(self, i: Column) -> Column:
        return F.struct(self.place(i, "s", "col", "line").alias("start"), self.place(i, "e", "ecol", "eline").alias("end"))

    def row(self, run: Column, first: Column, pos: Column, toks: Column, spans: Column) -> list[Column]:
        """A match of a run that begins at token `first`; pos: the place behind it."""
        return [run.alias("run"), first.alias("first"), pos.alias("behind"), self.at(first).alias("before"), self.at(pos).alias("after"), self.stops(pos, run).alias("stops"), toks.alias("toks"), spans.alias("spans")]

    def together(self, run: Column, first: Column, size: Column) -> Column:
        """row() of a run whose tokens are next to each other."""
        return F.struct(*self.row(run, first, first + size, F.slice("tok", first + 1, size), F.transform(F.sequence(first, first + size - 1), self.span)))

    def apart(self, number: int, run: pg.Run, first: Column) -> list[Column]:
        """row() of a run that is known when the plan is made."""
        places = self.places(run, first)
        return self.row(F.lit(number), first, places[-1] + 1, F.array(*(F.get("tok", i) for i in places)), F.array(*map(self.span, places)))

    @staticmethod
    def places(run: pg.Run, first: Column) -> list[Column]:
        """The place of each token of a run that begins at token `first`."""
        out, base, off = [], first, 0
        for test, text, _ in run[0]:
            if test == pg.CLOSER:
                base, off = F.get(f"next_{text}", base + off), 0
            out.append(base + off if off else base)
            off += 1
        return out

    @staticmethod
    def fits(test: Column, text: Column, level: Column, i: Column) -> Column:
        kind = F.get("kind", i)
        word = kind.isin(tk.STRING, tk.IDENTIFIER)
        return F.when(test == pg.ANY, word).when(test == pg.LEVEL, (kind == tk.LEVEL) & (F.get("level", i) == level)).otherwise(F.when(test == pg.BYTE, kind == tk.BYTE).otherwise(word) & (F.get("tok", i) == text))

    @staticmethod
    def fit(wanted: tuple[int, str, int], i: Column) -> Column:
        """fits() for a test that is known when the plan is made."""
        test, text, level = wanted
        kind, same = F.get("kind", i), F.get("tok", i) == F.lit(text.encode())
        if test == pg.CLOSER:
            return i >= 0
        if test == pg.LEVEL:
            return (kind == tk.LEVEL) & (F.get("level", i) == level)
        return same & (kind == tk.BYTE) if test == pg.BYTE else kind.isin(tk.STRING, tk.IDENTIFIER) if test == pg.ANY else same & kind.isin(tk.STRING, tk.IDENTIFIER)

    def tests(self, number: int, run: pg.Run) -> Callable[[Column], Column]:
        """Whether a run is at a place, as far as its own tokens tell."""
        wanted, equal = run
        early = self.early(number)

        def at(i: Column) -> Column:
            order = sorted(enumerate(wanted), key=lambda x: x[1][0] not in (pg.BYTE, pg.TOKEN))  # what few tokens are first
            places = self.places(run, i)
            tests = [self.fit(w, places[k]) for k, w in order]
            tests += [F.get("tok", places[a]) == F.get("tok", places[b]) for a, b in equal]
            tests += [reduce(lambda a, b: a | b, (fits_early(lambda k: F.get("tok", places[k]), captures, transforms) for captures, transforms in early))] if early else []
            return reduce(lambda a, b: a & b, tests)

        return at

    def early(self, number: int) -> list[tuple[dict[str, int], list[tuple]]]:
        """For each edge over a run that only begins rules: the captures that it sets for good, by their tokens, and their rule's expressions. Empty where some edge has none."""
        out = []
        for rule, node, kind, run, _, ops, *_ in self.program.edges:
            if run != number:
                continue
            _, _, _, names, _, transforms = self.program.rules[rule]
            touched = Counter(x for e in self.program.edges if e[0] == rule for op, _, a, b in e[5] for x in {pg.SET: (a,), pg.POP: (a, b)}.get(op, ()))
            captures = {names[a]: k for op, k, a, _ in ops if op == pg.SET and touched[a] == 1}
            told = [t for t in transforms if t[0] in captures]
            if node or kind != pg.NEXT or not told:
                return []
            out.append((captures, told))
        return out

    def everywhere(self, number: int, run: pg.Run) -> Column:
        """The matches of a run that is known when the plan is made."""
        size = len(run[0])
        places = F.when(F.size("kind") >= size, F.sequence(F.lit(0), F.greatest(F.size("kind") - size, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        closes = any(test == pg.CLOSER for test, *_ in run[0])
        return F.transform(F.filter(places, self.tests(number, run)), lambda i: F.struct(*self.apart(number, run, i)) if closes else self.together(F.lit(number), i, F.lit(size)))

    def alone(self, lists: DataFrame, number: int, run: pg.Run) -> DataFrame:
        """everywhere() as rows, for the only run of rules that ask for no bounds behind it: a place is a row before it is tested, so all of it is compiled."""
        size, i = len(run[0]), F.col("first")
        rows = lists.where(F.size("kind") >= size).select("*", F.explode(F.sequence(F.lit(0), F.size("kind") - size)).alias("first")).where(self.tests(number, run)(i))
        return rows.select("file", "lang", *self.apart(number, run, i))

    def anchored(self, table: str, anchors: list[str]) -> Column:
        """The matches of runs with a fixed token: where such a token stands, the runs that have it are held against the tokens around."""
        entries = F.from_json(F.lit(table), pg.ANCHORED)
        literals = [a.encode() for a in anchors]
        places = F.filter(F.transform("tok", lambda t, i: F.when(t.isin(literals), i)), lambda i: i.isNotNull())

        def match(r: Column) -> Column:
            inside = (r["first"] >= 0) & (r["first"] + F.size(r["r"]["wanted"]) <= F.size("kind"))
            all_fit = F.forall(F.transform(r["r"]["wanted"], lambda w, j: F.coalesce(self.fits(w["k"], w["t"], w["l"], r["first"] + j), F.lit(False))), lambda x: x)
            return inside & all_fit & F.forall(r["r"]["equal"], lambda p: F.get("tok", r["first"] + p[0]) == F.get("tok", r["first"] + p[1]))

        tried = F.transform(places, lambda i: F.filter(F.transform(F.element_at(entries, F.get("tok", i).cast("string")), lambda r: F.struct(r.alias("r"), (i - r["offset"]).alias("first"))), match))
        return F.transform(F.flatten(tried), lambda m: self.together(m["r"]["run"], m["first"], F.size(m["r"]["wanted"])))

    def find(self, lists: DataFrame) -> DataFrame:
        """(file, lang, run, first, behind, before, after, stops, toks, spans) of every match of every run, from one reading of the lists."""
        table, anchors, rest = self.program.anchored()
        run = next(iter(self.program.runs), ((), ()))
        if len(self.program.runs) == 1 and not self.program.bounds_after and (not anchors or any(test == pg.CLOSER for test, *_ in run[0])):
            return self.alone(lists, 0, run)
        if anchors and len(self.program.runs) <= FEW:
            anchors, rest = [], [(number, run) for run, number in self.program.runs.items()]
        found = [self.everywhere(number, run) for number, run in rest] + ([self.anchored(table, anchors)] if anchors else [])
        return lists.select("file", "lang", F.explode(F.concat(*found)).alias("x")).select("file", "lang", "x.*")

    def starts(self, lists: DataFrame) -> DataFrame:
        """A state at every token with nothing matched, for rules that begin with an ellipsis."""
        states = F.transform(F.sequence(F.lit(0), F.size("kind") - 1), lambda i: F.struct(i.alias("pos"), self.at(i).alias("after"), self.stops(i, None).alias("stops"), self.place(i, "e", "ecol", "eline").alias("last"), self.place(i, "s", "col", "line").alias("origin")))
        return lists.where(F.size("kind") > 0).select("file", "lang", F.explode(states).alias("x")).select("file", "lang", "x.*")


class Scan:
    """The loop of joins of some rules."""

    def __init__(self, lists: DataFrame, patterns: list[Pattern]):
        self.spark = lists.sparkSession
        fused = Program.of(patterns, True)
        self.program = fused if len(fused.runs) <= FEW else Program.of(patterns)  # closers are only looked for by plans that know their runs
        self.bounds = depths_needed(patterns)
        self.runs = Runs(self.program, self.bounds)
        begins = bool(self.program.begins)
        self.slots = max((len(r[3]) for r in self.program.rules), default=0)
        self.lists = cut(lists) if begins else lists
        self.longest = self.program.longest()
        found = self.runs.find(self.lists)
        self.found = found if self.longest is not None and self.longest <= 1 and not begins and not self.program.loops else cut(found)
        slots = {rule: len(names) for rule, _, _, names, *_ in self.program.rules}
        self.edges = self.table([e[:5] + pg.settled(e[5], slots[e[0]], self.slots) + e[6:] for e in sorted(self.program.edges, key=str)], pg.EDGES.replace(pg.OPS, pg.SETTLED))

    def table(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def first_states(self) -> DataFrame:
        """The states behind the first run of each rule, and the empty ones of rules that begin with an ellipsis."""
        none = {"vis_start": F.lit(None).cast(_SPAN), "vis_end": F.lit(None).cast(_SPAN), "c_depth": F.lit(0), "c_scope": F.lit(0), "c_statement": F.lit(0), "caps": F.array_repeat(F.lit(None).cast("binary"), self.slots)}
        edges = F.broadcast(self.edges.where(f"node = 0 and kind = '{pg.NEXT}'").drop("node"))
        joined = self.found.join(edges, "run").where(F.array_contains("languages", F.col("lang")))
        states = self.after_run(joined.withColumns({**none, "origin": F.col("spans")[0]["start"], "lang_": F.col("lang")}))
        if self.program.begins:
            rules = F.broadcast(self.table(sorted({(r, tuple(langs)) for r, _, langs in self.program.begins}), "rule int, languages array<string>"))
            empty = self.runs.starts(self.lists).join(rules, F.array_contains("languages", F.col("lang"))).withColumns({**none, "node": F.lit(0)})
            states = states.unionByName(empty.select(*states.columns))
        return states

    def after_run(self, joined: DataFrame) -> DataFrame:
        """The states of joined(state, edge, run), whose captures fit, behind their runs."""
        source = lambda x: F.when(x >= 0, F.get("toks", x)).otherwise(F.get("caps", -1 - x))
        fit = F.forall("equal", lambda c: F.coalesce(F.get("toks", c[0]) == source(c[1]), F.lit(False)))
        done = joined.where((F.size("equal") == 0) | fit)
        caps = F.when(F.size("sources") > 0, F.transform("sources", source)).otherwise(F.col("caps"))
        return done.select(
            "file", "rule", F.col("target").alias("node"), F.col("behind").alias("pos"), "after", "stops", F.expr("get(spans, size - 1).end").alias("last"), "origin", "c_depth", "c_scope", "c_statement", caps.alias("caps"),
            F.expr("if(begin >= 0, get(spans, begin).start, vis_start)").alias("vis_start"), F.expr("if(finish >= 0, get(spans, finish).end, vis_end)").alias("vis_end"),
        )

    @cached_property
    def asked(self) -> tuple[Column, Column, Column, list[Column]]:
        """Of a state and an edge: the last place where the run may begin, the scale and value of the join's key, and the depths carried on."""
        kind = "kind"
        carry = "CASE kind WHEN 'scope' THEN c_scope WHEN 'statement' THEN c_statement ELSE c_depth END"
        within = "".join(f" WHEN '{b}' THEN coalesce(get(stops[{k}], {carry}), {FAR})" for k, b in enumerate(self.bounds))
        bound = F.expr(f"CASE {kind} WHEN '{pg.NEXT}' THEN pos{within} ELSE {FAR} END")
        scale = F.expr(f"CASE WHEN bound = pos THEN 0 WHEN bound = {FAR} THEN 31 ELSE int(ceil(log2(bound - pos))) END")
        value = F.expr("CASE WHEN back_k >= 0 THEN xxhash64(get(caps, back_slot)) ELSE 0L END")
        changed = {d: f"before[{k}] - from[{k}]" for k, d in enumerate(self.runs.depths)}
        brackets = "".join(f" WHEN '{d}' THEN c_depth + {x}" for d, x in changed.items() if d != "scope")
        scope = changed.get("scope", "0")
        depths = [
            F.expr(f"CASE kind WHEN '{pg.FREE}' THEN if(first > pos, 0, c_depth){brackets} ELSE c_depth END").alias("c_depth"),
            F.expr(f"CASE kind WHEN '{pg.FREE}' THEN if(first > pos, 0, c_scope) WHEN 'scope' THEN c_scope + {scope} ELSE c_scope END").alias("c_scope"),
            F.expr(f"CASE WHEN kind IN ('{pg.FREE}', 'scope') AND first > pos THEN 0 WHEN kind = 'statement' THEN c_statement + {scope} ELSE c_statement END").alias("c_statement"),
        ]
        return bound, scale, value, depths

    def advance(self, states: DataFrame) -> DataFrame:
        """The states one run further."""
        edges = F.broadcast(self.edges.where(f"not (node = 0 and kind = '{pg.NEXT}')").drop("languages"))
        asked = states.join(edges, ["rule", "node"])
        bound, scale, value, depths = self.asked
        asked = asked.withColumn("bound", bound).where("bound >= pos").withColumns({"scale": scale, "value": value})
        probes = asked.selectExpr("* except (after, stops, last)", "after AS from", "explode(array_distinct(array(shiftright(pos, scale), shiftright(bound, scale)))) AS bin")
        shapes = asked.select("run", "scale", "back_k").distinct()  # no more than 32 for each edge
        runs = self.found.join(F.broadcast(shapes), "run").selectExpr("* except (lang)", "shiftright(first, scale) AS bin", "CASE WHEN back_k >= 0 THEN xxhash64(get(toks, back_k)) ELSE 0L END AS value")
        joined = probes.join(runs, ["file", "run", "scale", "back_k", "bin", "value"]).where("first >= pos and first <= bound")
        carried = joined.select(*(c for c in joined.columns if not c.startswith("c_")), *depths)
        return self.after_run(carried.where("not closed or c_depth = 0"))

    def closed(self, states: DataFrame) -> DataFrame:
        """The states, and those after any number of turns of a repetition that is one node.

        Steps of 1, 2, 4, ... turns are joined with themselves, and states with them: n turns take log n rounds.
        """
        if not self.program.loops:
            return states
        inside = states.join(F.broadcast(self.table(self.program.loops, "rule int, node int, loop int")), ["rule", "node"])
        body = F.broadcast(self.table([(loop, run) for runs, loop in self.program.bodies.items() for run in runs], "loop int, run int"))
        keys = ["file", "loop", "pos"]
        steps = self.found.join(body, "run").selectExpr("file", "loop", "first AS pos", "behind AS to", "after AS a", "stops AS s", "spans[size(toks) - 1].end AS l")
        reached, all_ = cut(inside), [states]
        if reached.isEmpty():
            return states
        least = reached.groupBy("file", "loop").agg(F.min("pos").alias("least"))  # turns go forwards, so none before the first state is taken
        steps = cut(steps.join(least, ["file", "loop"]).where("pos >= least").drop("least"))
        columns = [c for c in reached.columns if c not in ("pos", "after", "stops", "last")]
        while not steps.isEmpty():
            further = cut(reached.join(steps, keys).select(*columns, F.col("to").alias("pos"), F.col("a").alias("after"), F.col("s").alias("stops"), F.col("l").alias("last")))
            all_.append(further.select(*states.columns))
            reached = reached.unionByName(further)
            second = steps.select("file", "loop", F.col("pos").alias("to"), F.col("to").alias("to2"), F.col("a").alias("a2"), F.col("s").alias("s2"), F.col("l").alias("l2"))
            steps = cut(steps.join(second, ["file", "loop", "to"]).selectExpr("file", "loop", "pos", "to2 AS to", "a2 AS a", "s2 AS s", "l2 AS l"))
        return reduce(DataFrame.unionByName, all_)

    def accepted(self, states: DataFrame) -> DataFrame:
        """The states that are matches, once for each way to leave the rule there."""
        ends = F.broadcast(self.table(self.program.accepted, pg.ACCEPTED))
        met = states.join(ends, ["rule", "node"]).withColumn("ways", F.explode(F.sequence(F.lit(1), "ways")))
        return met.select("file", "rule", "origin", "last", "vis_start", "vis_end", "caps")

    def matches(self) -> DataFrame:
        states = self.first_states()
        if self.longest == 1 and not self.program.loops and not self.program.begins:
            return self.named(self.accepted(states))
        found = []
        turn = 1
        while True:
            last = turn == self.longest
            states = states if last and not self.program.loops else self.closed(cut(states))
            found.append(self.accepted(states))
            if last or self.longest is None and states.isEmpty():
                return self.named(reduce(DataFrame.unionByName, found))
            states = self.advance(states)
            turn += 1

    def named(self, found: DataFrame) -> DataFrame:
        """Matches with their rule's names, spans the right way round, and captures that fit the rule's expressions."""
        rules = F.broadcast(self.table(self.program.rules, pg.RULES))
        rows = found.join(rules, "rule")
        values = F.transform("slots", lambda n, i: F.struct(n.alias("key"), as_text(F.get("caps", i)).alias("value")))
        captures = F.map_from_entries(F.filter(values, lambda e: e["value"].isNotNull()))
        start, end = F.coalesce("vis_start", "origin"), F.coalesce("vis_end", "last")
        rows = rows.select(
            "file", F.col("rule").alias("pattern_id"), "name", "grp", F.least(start, end).alias("start"), F.greatest(start, end).alias("end"), F.col("vis_start").isNotNull().alias("start_overridden"), F.col("vis_end").isNotNull().alias("end_overridden"),
            F.col("origin.offset").alias("actual_start"), F.col("last.offset").alias("actual_end"), captures.alias("captures"), "transforms", "out",
        )
        return transformed(rows, any(r[5] for r in self.program.rules), any(r[4] for r in self.program.rules))


def scan(lists: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """All matches of the patterns in token lists, each in the files of its languages, as a bag: one row for each way to match.

    lists: token_lists() with folded strings and the bounds of depths_needed(patterns).
    """
    return Scan(lists, patterns).matches()
