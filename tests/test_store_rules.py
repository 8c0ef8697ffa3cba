"""Files whatever their names, many rules at once, bounds of ellipses, and the rule files' regular expressions."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tokenloom import queries
from tokenloom.api import find, needs_of
from tokenloom.functions import structure
from tokenloom.functions.shared import cut
from tokenloom.functions.regex import RegexError, java_regex
from tokenloom.functions.tokenize import Needs, token_lists
from tokenloom.plans.pattern import PatternError, load, load_files
from tokenloom.plans.program import Program
from tokenloom.plans.scan import Scan, depths_needed
from tokenloom.sources.files import read_files
from tokenloom.sources.store import list_files, read_content, write_files


def test_every_regular_file_is_found(spark, tmp_path):
    names = ["__init__.py", "_util.js", "__tests__/a.js", ".d/b.py", "g[1]/c.go", "a b/{x}*?.rs", "é.c", "plain.ts", "deep/er/y.KT", "_metadata.cs", "x._COPYING_.java"]
    for n in [*names, "no_ending", "other.txt", ".hidden"]:
        (tmp_path / "in" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / n).write_bytes(b"call(\xff);")
    (tmp_path / "in/empty").mkdir()
    os.symlink(tmp_path / "nowhere.c", tmp_path / "in/gone.c")
    os.symlink(tmp_path / "in", tmp_path / "in/loop")
    os.symlink(tmp_path / "in/plain.ts", tmp_path / "in/link.ts")
    os.mkfifo(tmp_path / "in/pipe.c")
    got = read_files(spark, str(tmp_path / "in")).collect()
    assert sorted(r.file for r in got) == sorted(names) and {bytes(r.content) for r in got} == {b"call(\xff);"}
    assert len(list_files(spark, str(tmp_path / "in")).collect()) == len(names) + 3
    alone = read_files(spark, str(tmp_path / "in/__init__.py")).collect()
    assert [(r.file, r.lang) for r in alone] == [("", "py")]
    assert read_files(spark, str(tmp_path / "in/empty")).collect() == []
    with pytest.raises(FileNotFoundError):
        list_files(spark, str(tmp_path / "absent"))


def test_files_that_cannot_be_read_are_left_out(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"_{k}.c").write_text(f"x{k};")
    listed = list_files(spark, str(tmp_path)).select("file", "path", "length")
    listed = cut(listed)
    (tmp_path / "_3.c").unlink()
    (tmp_path / "_4.c").unlink()
    (tmp_path / "_4.c").mkdir()
    assert sorted(r.file for r in read_content(listed).collect()) == ["_0.c", "_1.c", "_2.c"]


def test_written_files_are_read_back(spark, tmp_path):
    rows = [(f"{'_.'[k % 2]}d{k % 3}/[{k}].c", f"text {k}") for k in range(20)] + [("gone.c", None)]
    assert write_files(spark.createDataFrame(rows, "file string, content string"), str(tmp_path)) == 20
    assert sorted((r.file, bytes(r.content).decode()) for r in read_files(spark, str(tmp_path)).collect()) == sorted(rows[:-1])


def test_rule_files_of_all_names(spark, tmp_path):
    for n in ("_a.yml", ".b.yaml", "__more__/[c].yml"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(f"patterns: [x]\nlanguages: [c]\nname: '{n}'")
    (tmp_path / "d.YML").write_text("not read")
    assert [p.name for p in load_files(spark, str(tmp_path))] == [".b.yaml", "__more__/[c].yml", "_a.yml"]
    (tmp_path / "_e.yml").write_text("patterns: [x]")
    with pytest.raises(PatternError, match="_e.yml"):
        load_files(spark, str(tmp_path))


# --- many rules


def test_rules_at_once_find_what_each_finds_alone(spark):
    """Rules of all kinds over texts put together at random; run as one and one by one."""
    r = random.Random(4)
    parts = ["a", "b", "c", "f(", ")", "{", "}", ";", "=", "[", "]", "<", ">", "1", '"s"', "+", ","]
    files = queries.snippets(spark, "c", [" ".join(r.choices(parts, k=60)) for _ in range(8)])
    texts = ["a $X", "f(... $X)", "$X ..} $X", "a ..! ;", "a ..* b ..| = $_ ..* ;", "..- a ..| $_ , ..- ..^ b ..$", "... a b", "$X = ..} ..* $Y = %X ; ..} ..* b"]
    rules = [load(f"patterns: ['{t}']\nlanguages: [c]\nname: 'r{k}'") for k, t in enumerate(texts)]
    flat = lambda rows: sorted((x.name, x.file, x.start.offset, x.end.offset, tuple(sorted(x.captures.items()))) for x in rows)
    together = flat(find(files, [p for r in rules for p in r]).collect())
    assert together == sorted(sum((flat(find(files, r).collect()) for r in rules), []))
    assert len({x[0] for x in together}) >= 6


def test_the_plan_does_not_grow_with_the_rules(spark):
    def plan(n):
        rules = [p for k in range(n) for p in load(f"patterns: ['w{k} (... $X) ..}} v{k}']\nlanguages: [js]\nname: r{k}")]
        return find(queries.pages(spark, "/root/testdata/sf0.001"), rules)._jdf.queryExecution().executedPlan().toString()

    assert len(re.findall("Join", plan(12))) == len(re.findall("Join", plan(300)))


def test_one_automaton_looks_for_the_words_of_all_rules():
    rules = sum((load(f"patterns: ['{t}']\nlanguages: [{lang}]") for t, lang in (("ab ... bc", "c"), ("größe", "c"), ("xyz", "py"), ("$X", "go"), ('"only a string"', "js"))), [])
    needs = Needs(needs_of(rules))
    assert needs.met(b"abc", "c") and needs.met("die größe".encode(), "c") and needs.met(b"bcab", "c")
    assert not needs.met(b"ab b c", "c") and not needs.met(b"xy z", "py") and needs.met(b"xyz", "py")
    assert needs.met(b"", "go") and needs.met(b"", "js") and not needs.met(b"ab bc", "java")


def test_graphs_of_rules():
    def graph(text):
        p = Program.of(load(f"patterns: ['{text}']\nlanguages: [c]"))
        return sorted((e[1], e[2], e[4]) for e in p.edges), sorted((n, w) for _, n, w in p.accepted), p.longest()

    assert graph("a ... b") == ([(0, "next", 1), (1, "free", 2)], [(2, 1)], 2)
    assert graph("a ..* b ..| c ..* d") == ([(0, "next", 1), (1, "next", 2), (1, "next", 2), (1, "next", 3), (2, "next", 3)], [(3, 1)], 3)
    assert graph("$X ..* b $X ..| c $X ..* d") == ([(0, "next", 1), *[(n, "next", t) for n in (1, 2, 3) for t in (2, 3, 4)]], [(4, 1)], None)
    assert graph("a ..- ..| ..- b") == ([(0, "next", 1), (1, "next", 2), (1, "next", 2)], [(2, 1)], 2)
    assert graph("a ..- b ..| ..-") == ([(0, "next", 1), (1, "next", 2)], [(1, 1), (2, 1)], 2)


# --- bounds


def test_next_falls_and_ends():
    r = np.random.default_rng(2)
    for n in (0, 1, 7, 60):
        step = r.choice([-2, -1, 0, 0, 1], n)
        depth = np.concatenate([[0], np.cumsum(step)]).astype(np.int64)
        kind, tok = np.full(n, 2), [b";" if x == 0 else b"x" for x in r.integers(0, 4, n)]
        falls, left = structure.next_falls(depth), structure.left_to_fall(depth)
        ends = structure.next_ends(depth, kind, tok, np.zeros(n, np.int32))
        for p in range(n + 1):
            below = [j for j in range(p, n) if depth[j + 1] < depth[p] <= depth[j]]
            assert falls[p] == (below[0] if below else -1)
            own = [j for j in range(p, n) if tok[j] == b";" and depth[j + 1] == depth[p]]
            assert ends[p] == min([*below[:1], *own[:1]], default=-1)
            assert left[p] == depth[p] - depth[p:].min()


def test_bounds_take_no_shuffle_of_their_own(spark):
    files = queries.snippets(spark, "c", ["f(a)"])
    rules = load("patterns: ['f(... $X']\nlanguages: [c]")
    lists = find(files, rules)
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and depths_needed(rules) == ("round",)


def test_one_file_with_many_starts_and_stops(spark):
    """100,000 short brackets in one file: each start meets the stops near it, not those of the whole file."""
    n = 100_000
    files = spark.createDataFrame([("one", "c", "f(a) ; " * n)], "file string, lang string, content string")
    rules = load("patterns: ['f(... a']\nlanguages: [c]")
    from tokenloom.functions.tokenize import token_lists

    scan = Scan(token_lists(files, languages=("c",), folded=True, bounds=depths_needed(rules)), rules)
    assert scan.advance(scan.first_states()).count() == n
    asked = scan.first_states().join(scan.edges.where("node = 1"), ["rule", "node"]).withColumn("bound", scan.asked[0])
    assert asked.selectExpr("max(bound - pos)").first()[0] == 1


def test_long_repetitions_take_few_rounds(spark, monkeypatch):
    """3,000 turns: steps are doubled, so the number of stored tables follows their logarithm; each way to match is a row."""
    from tokenloom.plans import scan

    stored = []
    monkeypatch.setattr(scan, "cut", lambda df: stored.append(1) or cut(df))
    text = "go " + "x = 1 ; " * 3000 + "end ; go y y z"
    files = queries.snippets(spark, "c", [text])
    rows = find(files, load("patterns: ['go ..* x = $_ ; ..* end', 'go ..* y ..| y ..| y y ..* z']\nlanguages: [c]")).collect()
    assert sorted((r.start.offset, r.end.offset) for r in rows) == [(0, len(text) - 11)] + [(len(text) - 8, len(text))] * 5
    assert len(stored) <= 2 * 13 + 10


def test_turns_before_the_first_state_are_left_out(spark, monkeypatch):
    """Of a repetition's turns those before the place where it can begin are not doubled."""
    from tokenloom.plans import scan

    sizes = []
    monkeypatch.setattr(scan, "cut", lambda df: sizes.append((out := cut(df)).count()) or out if "to" in df.columns else cut(df))
    files = queries.snippets(spark, "c", ["x = 1 ; " * 200 + "go x = 2 ; x = 3 ; end", "x = 1 ; end"])
    rows = find(files, load("patterns: ['go ..* x = $_ ; ..* end']\nlanguages: [c]")).collect()
    assert [(r.file, r.start.offset) for r in rows] == [("s0", 1600)]
    assert sizes and max(sizes) == 1  # the first turn follows `go`


def test_brackets_are_closed_without_a_join(spark, monkeypatch):
    """The place where an ellipsis in brackets ends is known in the file's row; before, states and runs were stored and joined for it. The results are the join's."""
    from tokenloom.plans import scan

    r = random.Random(5)
    files = queries.snippets(spark, "c", [" ".join(r.choices("a b c ; ( ( ) ) [ ] < > { }".split(), k=150)) for _ in range(40)])
    alone = ["$X [...] %X", "$X (...)", "$A < ..> > $B", "$A (...) (...) $A", "a (... ..^ ) ..$ $B"]
    joined = ["..- a (...) ..| b ..- $X", "$A (...) ... $B", "..* a (...) b ..* c"]

    def found(text):
        stored = []
        monkeypatch.setattr(scan, "cut", lambda df: stored.append(1) or cut(df))
        rows = find(files, load(f"patterns: ['{text}']\nlanguages: [c]")).collect()
        return sorted((x.file, x.start.offset, x.end.offset, sorted(x.captures.items())) for x in rows), len(stored)

    now = {text: found(text) for text in alone + joined}
    assert [now[text][1] for text in alone] == [0] * len(alone)
    monkeypatch.setattr(scan, "FEW", 0)
    for text, (rows, _) in now.items():
        assert rows and rows == found(text)[0], text


# --- regular expressions


@pytest.mark.parametrize(
    ("rx", "yes", "no"),
    [
        (r"^[[:alpha:]]+$", ["abc"], ["a1", "é", ":"]), (r"^[[:^digit:]x]$", ["a", "x"], ["5"]), (r"^[^[:space:]b]$", ["a"], ["b", " "]), (r"^\x{61}\x62c$", ["abc"], ["ab"]), (r"^a\z", ["a"], ["a\n"]), (r"^a$", ["a"], ["a\n", "a\r"]),
        (r"^[]a]+$", ["]a"], ["b"]), (r"^[^]a]$", ["b"], ["]", "a"]), (r"^[a-]$", ["-", "a"], ["b"]), (r"^(?i)straße$", ["STRAßE"], ["STRASSE"]), (r"^(?i:a)b$", ["Ab"], ["AB"]), (r"^\d\w\s$", ["1_ "], ["١a ", "1é "]), (r"\bx\b", ["a x", "éx"], ["ax", "x1"]), (r"a\Bb", ["ab"], ["a b"]),
        (r"^a{2,3}$", ["aa", "aaa"], ["a", "aaaa"]), (r"^(?:ab)*+$", ["", "abab"], ["aba"]), (r"^.$", ["a", "\r", " "], ["\n", ""]), (r"(?s)^.$", ["\n"], [""]), (r"(?m)^b$", ["a\nb\nc"], ["a\rb"]), (r"(?x) a b # not c", ["ab"], ["a b"]), (r"^}]$", ["}]"], [""]), (r"^\#\-\&$", ["#-&"], [""]), (r"^[\w.]+$", ["a.b"], ["a b"]), (r"\<a\>", ["b a"], ["ba"]), (r"^(a|)$", ["a", ""], ["b"]),
    ],
)
def test_regex_dialect(spark, rx, yes, no):
    java, _ = java_regex(rx)
    for texts, met in ((yes, True), (no, False)):
        found = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", f"t rlike r'{java}' AS met").collect()
        assert [(r.t, r.met) for r in found] == [(t, met) for t in texts], java


def test_regex_greed_is_swapped(spark):
    for rx, want in (("(?U)^(a+)(a*)$", ("a", "aa")), ("(?U)^(a+?)(a*)$", ("aaa", "")), ("^(a+?)(a*)$", ("a", "aa"))):
        java, _ = java_regex(rx)
        assert tuple(spark.sql(f"SELECT regexp_extract('aaa', r'{java}', 1), regexp_extract('aaa', r'{java}', 2)").first()) == want


def test_regex_groups_are_numbered():
    assert java_regex(r"(a)(?:b)(?P<n>c)(?<m.2>d)")[1] == {"n": 2, "m.2": 3}


@pytest.mark.parametrize("rx", ["[[]", "[a", "(", ")", "a)", "*", "a|*", "(?=a)", "(?!a)", "(?<=a)", r"\1", r"\p{L}", r"\q", "[a&&b]", "[a--b]", "[[a]]", "[[:no:]]", "a{", "a{x}", "a{3,2}", "{2}", "[b-a]", "(?z)", "(?<1>a)", "(?<a>x)(?<a>y)", r"\x{110000}", r"\x{D800}", r"\xg0", "(?-)", "\\", r"[\b]"])
def test_regex_errors_come_when_rules_are_loaded(rx):
    with pytest.raises(RegexError):
        java_regex(rx)
    quoted = rx.replace("'", "''")
    with pytest.raises(PatternError, match="regex compilation"):
        load(f"patterns: [$A]\nlanguages: [c]\ntransform: {{A: '{quoted}'}}")


# --- groups


def plain_groups(spans, keys):
    """Anchors and what each takes in, for non-unique matches (start, end, key or None) of one group: in order of end, then start from the last."""
    order = sorted(range(len(spans)), key=lambda i: (spans[i][1], -spans[i][0], i))
    used, out = set(), {}
    for a, i in enumerate(order):
        if i in used:
            continue
        held, key = [], keys[i]
        for j in order[a + 1 :]:
            if spans[j][0] <= spans[i][0] and spans[j][1] >= spans[i][1] and (key is None or keys[j] is None or keys[j] == key):
                held.append(j)
                key = keys[j] if keys[j] is not None else key
                used.add(j)
        out[i] = sorted(held)
    return out


def grouped(spark, spans, keys):
    from tokenloom.operators.grouping import group_matches

    place = lambda o: (o, 1, 1)
    rows = [("f", k, "r", ("g", False, False, ["K"]), place(s), place(e), False, False, s, e, {f"N{k}": str(k)} | ({"K": key} if key else {})) for k, ((s, e), key) in enumerate(zip(spans, keys, strict=True))]
    point = "struct<offset:bigint,column:bigint,line:bigint>"
    df = spark.createDataFrame(rows, f"file string, pattern_id int, name string, grp struct<name:string,unique:boolean,cancel:boolean,match:array<string>>, start {point}, end {point}, start_overridden boolean, end_overridden boolean, actual_start long, actual_end long, captures map<string,string>")
    return {r.pattern_id: sorted(int(v) for k, v in r.captures.items() if k != "K" and int(v) != r.pattern_id) for r in group_matches(df).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_are_those_of_an_ordered_fold(spark, seed):
    r = random.Random(seed)
    spans = [(a, a + r.choice((0, 1, 2, 5, 20))) for a in (r.randrange(30) for _ in range(60))]
    keys = [r.choice((None, "a", "b")) for _ in spans]
    assert grouped(spark, spans, keys) == plain_groups(spans, keys)


def test_many_nested_matches_of_a_group(spark):
    """3,000 matches inside each other: the innermost takes in all others in the first round, and they never meet."""
    n = 3000
    spans = [(n - k, n + k) for k in range(n)]
    assert grouped(spark, spans, [None] * n) == {0: list(range(1, n))}


# --- captures' expressions


def test_expressions_are_held_against_tokens_before_states_are_made(spark):
    """Before, each pair of words became a state with its captures, and was held against the expression at the end."""

    def states(text, *patterns, **fields):
        rules = queries.patterns(*patterns, language="c", **fields)
        lists = token_lists(queries.snippets(spark, "c", [text]), folded=True, bounds=depths_needed(rules))
        return Scan(lists, rules).first_states().count(), sorted(tuple(sorted(r.captures.items())) for r in find(queries.snippets(spark, "c", [text]), rules).collect())

    text = "a b _ab ab x 7 x"
    assert states(text, "$A $B", transform={"A": "(?<B>[a-z]+)$"}) == (1, [(("A", "_ab"), ("B", "ab"))])
    assert states(text, "$A $B", transform={"A": "(?<C>[0-9]+)$"}) == (1, [(("A", "7"), ("B", "x"), ("C", "7"))])
    # a capture that is overwritten is told at the end; of two rules over the same tokens one may want what the other does not
    assert states("1 y ; a", "$X $Y ; %X", transform={"X": "^[a-z]$"})[1] == [(("X", "a"), ("Y", "y"))]
    assert states(text, "$A $B", "$B $A", transform={"A": "^7$"}) == (4, [(("A", "7"), ("B", "x"))] * 2)


def test_a_task_cuts_small_slices_into_tokens(spark):
    """A worker's memory is that of a slice's tokens, which are some twenty times its text; before, a slice was 2 MB."""

    class Files:
        def where(self, *_):
            return self

        select = where

        def mapInArrow(self, f, _):  # noqa: N802
            return f

    batch = pa.RecordBatch.from_pydict({"file": [str(k) for k in range(100)], "lang": ["c"] * 100, "content": ["ab " * 5000] * 100})
    out = list(token_lists(Files())(iter([batch])))
    assert [x for b in out for x in b.column("file").to_pylist()] == [str(k) for k in range(100)]
    assert max(len(b.column("kind").flatten()) for b in out) <= (256 << 10) // 3 + 5000


def test_few_runs_are_looked_for_without_a_table_of_runs(spark):
    def plan(*texts):
        rules = queries.patterns(*texts, language="c")
        lists = token_lists(queries.snippets(spark, "c", [""]), folded=True, bounds=depths_needed(rules))
        return Scan(lists, rules).runs.find(lists)._jdf.queryExecution().analyzed().toString()

    assert "from_json" not in plan("$X [...] %X") and "from_json" in plan(*(f"a{k} ( $X )" for k in range(9)))
