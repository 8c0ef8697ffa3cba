"""Whole searches: rules and sources of the kinds that users write, with the findings that they have to give."""

import itertools
import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tokenloom import queries
from tokenloom.__main__ import main
from tokenloom.api import find
from tokenloom.functions.tokenize import as_text, token_lists
from tokenloom.plans.pattern import load, load_files
from tokenloom.sources.files import read_files
from tokenloom.streaming.chunks import Assemblies, Assembly, read_findings, scan_stream


def findings(spark, lang, text, *rules):
    rows = find(queries.snippets(spark, lang, [text]), [p for r in rules for p in load(r)]).collect()
    return sorted((r.start.offset, r.end.offset, r.name, tuple(sorted(r.captures.items()))) for r in rows)


def places(text, word):
    return [i for i in range(len(text)) if text.startswith(word, i)]


def test_a_handle_that_moves(spark):
    """A repetition of two branches hands a name on: by `to`, which pops the name it has just made, and by `join`, which overwrites."""
    text = "open a; to b a; join b c; shut c; shut a; to z y; shut b; shut z;"
    rule = "patterns: ['open $H ; ... ..* to $K %H ; ... ..| join $H %H ; ... ..* shut $H ;']\nlanguages: [kotlin]\nname: moved"
    ends = {h: text.index(f"shut {h};") + 7 for h in "abc"}
    assert findings(spark, "kotlin", text, rule) == sorted((0, e, "moved", (("H", h),)) for h, e in ends.items())


def test_a_handle_does_not_leave_its_block(spark):
    rule = "patterns: ['open $H ; ..} ..* to $K %H ; ..} ..* shut $H ;']\nlanguages: [go]\nname: kept"
    text = "{ open a; { to b a; shut b; } shut a; } shut a; shut b;"
    # b is bound inside the inner block only as far as the outer one reaches: the ellipsis carries the depth at which it began
    assert findings(spark, "go", text, rule) == [(2, text.index("shut b;") + 7, "kept", (("H", "b"),)), (2, text.index("shut a;") + 7, "kept", (("H", "a"),))]


def test_ways_that_are_closed_off_are_cancelled(spark):
    """Sends inside a `quiet` block are taken out by a rule of the same group, with all their other ways."""
    text = "send(1); quiet { send(2); { send(3); } } send(4); quiet { } send(5);"
    quiet = "patterns: ['quiet {... send ( $_N ) ;']\nlanguages: [ts]\nname: quiet\ngroup: {name: sends, cancel: true}"
    send = "patterns: ['send ( $N ) ;']\nlanguages: [ts]\nname: send\ngroup: {name: sends}"
    want = [(text.index(f"send({n})"), text.index(f"send({n})") + 8, "sends", (("N", n),)) for n in "145"]
    assert findings(spark, "ts", text, quiet, send) == want


def test_cancelling_only_equal_captures(spark):
    text = "lock p; use p; use q; free p; use p;"
    held = "patterns: ['lock $_L ; ..} use $_L ; ..} free $_L ;']\nlanguages: [csharp]\nname: held\ngroup: {name: uses, cancel: true}"
    use = "patterns: ['use $_L ;']\nlanguages: [csharp]\nname: use\ngroup: {name: uses, match: [_L]}"
    at = [text.index("use q"), text.rindex("use p")]
    assert findings(spark, "csharp", text, use, held) == [(a, a + 6, "uses", ()) for a in at]


def test_names_and_sizes_of_boxes(spark):
    """A box takes in its name, and gives one finding for each of its sides; a label is no finding of its own."""
    text = "box a; label a x; side a 1; side a 2; box b; label b y;"
    rules = [
        "patterns: ['box $B ;']\nlanguages: [js]\nname: box\ngroup: {name: boxes, match: [B]}",
        "patterns: ['box $B ; ..} label $B $L ;']\nlanguages: [js]\nname: label\ngroup: {name: boxes}",
        "patterns: ['box $B ; ..} side $B $S ;']\nlanguages: [js]\nname: side\ngroup: {name: boxes, unique: true}",
    ]
    side = lambda n: (0, text.index(f"side a {n};") + 9, "boxes", (("B", "a"), ("L", "x"), ("S", n)))
    assert findings(spark, "js", text, *rules) == [side("1"), side("2"), (text.index("box b"), len(text), "boxes", (("B", "b"), ("L", "y")))]


def test_values_of_two_templates(spark):
    """Each combination is a pattern of its own; a template that comes twice has one value."""
    text = "get a.b as a.b; put c as c; get d as e.f; put g.h as g.h;"
    rule = "patterns: ['{{DO}} {{WHAT}} as {{WHAT}} ;']\nlanguages: [go, rust]\ntemplates: {DO: [get, put], WHAT: [$N, $N . $M]}"
    at = places(text, "get")[:1] + places(text, "put")
    assert findings(spark, "go", text, rule) == [(at[0], 15, "", (("M", "b"), ("N", "a"))), (at[1], at[1] + 11, "", (("N", "c"),)), (at[2], len(text), "", (("M", "h"), ("N", "g")))]


def test_parts_of_a_path(spark):
    """Named groups become captures; a group whose name is taken has to agree; fixed values are added last."""
    text = 'route("/v1/users", users) route("/v2/items", users) route("plain", users)'
    rule = "patterns: ['route ( $_P , $LAST )']\nlanguages: [py]\nname: route\nout: {kind: web}\ntransform: {_P: '^\"/(?<V>v[0-9])/(?P<LAST>[a-z]+)\"$'}"
    assert findings(spark, "py", text, rule) == [(0, text.index(")") + 1, "route", (("LAST", "users"), ("V", "v1"), ("kind", "web")))]


def test_lines_of_a_loop(spark):
    """Python: a level's change is a token, and equal indentation ends a statement."""
    text = "for a in b:\n  x = a\n  y = a\nz = a\n"
    assert [x[:2] for x in findings(spark, "py", text, "patterns: ['$V in ..} $_ = $V']\nlanguages: [py]")] == [(4, i + 5) for i in (text.index("x ="), text.index("y ="), text.index("z ="))]
    assert [x[:2] for x in findings(spark, "py", "if c:\n  " + text.replace("\n", "\n  ") + "\nw = a", "patterns: ['$V in ..} $_ = $V']\nlanguages: [py]")] == [(12, i) for i in (29, 39, 47)]
    assert [x[:2] for x in findings(spark, "py", text, "patterns: ['$N = ..! a']\nlanguages: [py]")] == [(i, i + 5) for i in (text.index("x ="), text.index("y ="), text.index("z ="))]


def test_span_marks(spark):
    """They count at the top of a pattern only, and a span that ends before it begins is turned round."""
    plain = lambda p, text: findings(spark, "c", text, f"patterns: ['{p}']\nlanguages: [c]")
    assert plain("a ..- ..^ x ..$ ..| y ..- b", "a x b") == [(0, 5, "", ())]
    assert plain("a ..* ..^ x ..$ ..* b", "a x x b") == [(0, 7, "", ())]
    assert plain("a ..$ x ..^ b c", "a x b c") == [(1, 4, "", ())]
    assert plain("a ..- x ..| y ..- ..^ b ..$ c", "a y b c") == [(4, 5, "", ())]


def test_depths_are_carried_over_several_ellipses(spark):
    plain = lambda p, text, lang="c": [x[:2] for x in findings(spark, lang, text, f"patterns: ['{p}']\nlanguages: [{lang}]")]
    assert plain("f(... a ... b)", "f(a, g(b), b) b)") == [(0, 9), (0, 13)]
    assert plain("m[...][...] = x", "m[a[1]][b[2]] = x m[1] = x") == [(0, 17)]
    assert plain("x ..} y ..} z", "{ x; { y; } z; } z") == [(2, 13)]
    assert plain("x ..! y ..! ;", "x = { y; }; x = y + 1;") == [(0, 8), (0, 11), (12, 22)]


def test_literals_beyond_ascii(spark):
    assert findings(spark, "c", 'größe = "ä"; x', "patterns: ['größe = $V', 'größe = \"ä\"']\nlanguages: [c]") == [(0, 14, "", ()), (0, 14, "", (("V", '"ä"'),))]


def test_overlong_runs_of_strings(spark):
    lists = token_lists(queries.snippets(spark, "c", ['"abc" + "def" x "gh" "i" 1']), max_length=5, folded=True)
    row = lists.select("kind", F.transform("tok", as_text).alias("tok")).first()
    assert list(row.kind) == [4, 1, 0, 1] and row.tok == [None, "x", '"ghi"', "1"]
    rows = find(queries.snippets(spark, "c", ['f("abc" + "def") f("ab" "c")']), load("patterns: ['f($S)', 'f(...)']\nlanguages: [c]"), max_length=5).collect()
    assert sorted((r.start.offset, r.captures.get("S") or "") for r in rows) == [(0, ""), (17, ""), (17, '"abc"')]


def test_deep_indentation(spark):
    """Levels of thousands of nested lines, of which the outermost are forgotten."""
    text = "".join(" " * k + "x\n" for k in range(1500)) + "end"
    levels = [v for v in token_lists(queries.snippets(spark, "py", [text])).first().level if v is not None]
    assert levels == [1] * 1499 + [-1000]


def test_folders_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "rules/more").mkdir(parents=True)
    (tmp_path / "src/deep/er").mkdir(parents=True)
    (tmp_path / "rules/a.yml").write_text("patterns: ['call($N)']\nlanguages: [c++, golang, kotlin]\nname: a")
    (tmp_path / "rules/more/b.yaml").write_text("patterns: ['call(1)']\nlanguages: [javascript]\nname: b")
    (tmp_path / "rules/c.txt").write_text("not a rule")
    for name in ("x.cpp", "deep/y.go", "deep/er/z.KT", "w.mjs", "v.unknown", "noending"):
        (tmp_path / "src" / name).write_text("call(1);")
    os.symlink(tmp_path / "nowhere.c", tmp_path / "src/gone.c")
    patterns = load_files(spark, str(tmp_path / "rules"))
    assert [(p.name, p.languages) for p in patterns] == [("a", ("c", "go", "kotlin")), ("b", ("js",))]
    assert sorted((r.file, r.lang) for r in read_files(spark, str(tmp_path / "src")).collect()) == [("deep/er/z.KT", "kotlin"), ("deep/y.go", "go"), ("w.mjs", "js"), ("x.cpp", "c")]
    want = [("deep/er/z.KT", "a"), ("deep/y.go", "a"), ("w.mjs", "b"), ("x.cpp", "a")]
    assert main([str(tmp_path / "rules"), str(tmp_path / "src")]) == 0
    assert sorted((x["file"], x["name"]) for x in map(json.loads, capsys.readouterr().out.splitlines())) == want
    assert main([str(tmp_path / "rules"), str(tmp_path / "src"), "--out", str(tmp_path / "out"), "--compat"]) == 0
    assert sorted((x["file"], x["name"]) for x in (json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect())) == [("deep/er/z.KT", "b"), *want[1:]]
    (tmp_path / "rules/d.yml").write_text("patterns: ['$X ..* a']\nlanguages: [c]")
    assert main([str(tmp_path / "rules"), str(tmp_path / "src")]) == 1
    with pytest.raises(SystemExit):
        main(["a", "b", "--max-token-length", "0"])


def test_chunks_late_and_repeated(spark, tmp_path):
    """Four micro-batches: the last chunk first, chunks that come twice, one after its file is finished, and a file that never ends."""
    schema = "file string, lang string, seq int, content string, last boolean"
    batches = [
        [("a", "c", 2, "(2);", True), ("b", "c", 0, "call(3", False)],
        [("a", "c", 0, "call(1); c", False), ("b", "c", 1, "0);", True), ("b", "c", 0, "call(3", False)],
        [("a", "c", 1, "all", False), ("a", "c", 1, "all", False), ("b", "c", 1, "0);", True), ("n", "c", 0, "call(9);", False)],
        [("a", "c", 2, "(2);", True), ("b", "c", 0, "call(3", False), ("d", "c", 0, "call(4);", True)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        scan_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), load("patterns: ['call($N)']\nlanguages: [c]"), str(tmp_path / "out"), str(tmp_path / "staging")).awaitTermination()
    got = sorted((r.file, r.start.offset, r.captures["N"]) for r in read_findings(spark, str(tmp_path / "out")).collect())
    assert got == [("a", 0, "1"), ("a", 9, "2"), ("b", 0, "30"), ("d", 0, "4")]
    kept = spark.read.format("statestore").option("stateVarName", "chunks").load(str(tmp_path / "staging/progress"))
    assert {r.file for r in kept.select("key.file").collect()} == {"n"}  # the chunks of unfinished files only


class Store:
    """State of one key in plain Python."""

    def __init__(self):
        self.maps, self.values, self.timers = {}, {}, []

    def getMapState(self, name, *_):  # noqa: N802
        data = self.maps.setdefault(name, {})

        class Map:
            keys = lambda _: iter(list(data))
            getValue = lambda _, k: data[k]  # noqa: E731, N815
            containsKey = lambda _, k: k in data  # noqa: E731, N815
            updateValue = lambda _, k, v: data.__setitem__(k, v)  # noqa: E731, N815
            removeKey = lambda _, k: data.pop(k)  # noqa: E731, N815
            clear = lambda _: data.clear()

        return Map()

    def getValueState(self, name, *_):  # noqa: N802
        data = self.values

        class Value:
            exists = lambda _: name in data
            get = lambda _: data[name]
            update = lambda _, v: data.__setitem__(name, v)
            clear = lambda _: data.pop(name, None)

        return Value()

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


class Clock:
    getCurrentProcessingTimeInMs = lambda _: 1000  # noqa: E731, N815


def test_assembly_of_chunks():
    """Every order, with repeats and chunks beyond the end, gives the file once; a file without an end is given up at its time."""

    def run(batches, patience=None):
        store, assembly = Store(), Assembly(patience, None)
        assembly.init(store)
        out = [bytes(c) for b in batches for df in assembly.handleInputRows(("f", "c"), iter([pd.DataFrame(b, columns=["seq", "content", "last"])]), Clock()) for c in df["content"]]
        return out, store, assembly

    whole = [(0, b"ab", False), (1, b"", False), (2, b"c", True)]
    for order in itertools.permutations([*whole, (7, b"stray", False), (1, b"", False)]):
        assert run([[x] for x in order])[0] == [b"abc"] and run([order])[0] == [b"abc"]
    out, store, _ = run([whole, whole])
    assert out == [b"abc"] and not store.maps["chunks"] and set(store.values) == {"done"}
    out, store, assembly = run([[whole[0]], [whole[1]], [(3, b"late", False)]], patience=50)
    assert out == [] and store.timers == [1050]
    assert [bytes(df["content"][0]) for df in assembly.handleExpiredTimer(("f", "c"), Clock(), None)] == [b"ab"]
    assert list(assembly.handleExpiredTimer(("f", "c"), Clock(), None)) == [] and list(assembly.handleInputRows(("f", "c"), iter([]), Clock())) == []


def test_chunks_of_the_query_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """Before, one task wrote all chunks of a micro-batch, so it read the whole table."""
    texts = [(k, f"{'x ' * 700 * (k % 3)}token = s{k} ;") for k in range(160)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    folders = []
    monkeypatch.setattr(queries, "delete", lambda _, folder: folders.append(folder))
    found = queries.stream_equals_batch(spark, str(tmp_path)).collect()
    assert sorted(r.v for r in found) == sorted(f"s{k}" for k, _ in texts)
    folder = folders[0].removeprefix("file:")
    written = spark.read.parquet(f"{folder}/in").select("_metadata.file_path").distinct().count()
    assert written > 8 and len([x for x in os.listdir(f"{folder}/out") if x.startswith("batch=")]) == 4


class Counted(Store):
    """A Store that counts the exchanges with its map and value states."""

    def __init__(self):
        super().__init__()
        self.calls = 0

    def _counted(self, state):
        class Outer:
            def __getattr__(_, name):  # noqa: N805
                self.calls += 1
                return getattr(state, name)

        return Outer()

    def getMapState(self, name, *_):  # noqa: N802
        return self._counted(super().getMapState(name))

    def getValueState(self, name, *_):  # noqa: N802
        return self._counted(super().getValueState(name))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_of_files_are_assembled_as_files_are(seed):
    """In any order, with repeats, strays beyond the end and files that never end, each micro-batch gives what it gives when each file is a key."""
    r = random.Random(seed)
    rows = []
    for f in range(60):
        n = r.choice((1, 1, 2, 3, 9))
        mine = [(f"f{f}", "c", k, f"{f}.{k};".encode() if r.random() < 0.9 else b"", k == n - 1) for k in range(n)]
        rows += (mine[:-1] if r.random() < 0.1 else mine) + r.choices(mine, k=r.choice((0, 0, 2))) + [(f"f{f}", "c", n + 3, b"stray", False)] * (r.random() < 0.2)
    r.shuffle(rows)
    batches = [rows[k::5] for k in range(5)]
    frame = lambda x: pd.DataFrame(x, columns=["file", "lang", "seq", "content", "last"])
    one, group = Counted(), Assemblies(50, None)
    group.init(one)
    stores = {}
    for batch in batches:
        want = []
        for f in dict.fromkeys(x[0] for x in batch):
            store, single = stores.setdefault(f, (Counted(), Assembly(50, None)))
            single.init(store)
            want += [df for df in single.handleInputRows((f, "c"), iter([frame([x for x in batch if x[0] == f])]), Clock())]
        got = list(group.handleInputRows((0,), iter([frame(batch[:40]), frame(batch[40:])] if len(batch) > 40 else [frame(batch)]), Clock()))
        key = lambda frames: sorted((a, b, bytes(c)) for df in frames for a, b, c in zip(df["file"], df["lang"], df["content"], strict=True))
        assert key(got) == key(want)
    late = type("Late", (), {"getCurrentProcessingTimeInMs": lambda _: 1050})()
    want = [df for f, (store, single) in stores.items() if store.timers for df in single.handleExpiredTimer((f, "c"), late, None)]
    given_up = list(group.handleExpiredTimer((0,), late, None))
    assert key(given_up) == key([df for df in want if len(df)]) and set(one.timers) == {1050}
    assert not one.maps["chunks"] and not one.values and set(one.maps["done"]) == {x[:2] for x in rows}
    assert one.calls * 4 < sum(store.calls for store, _ in stores.values())


def test_chunks_of_groups_late_and_repeated(spark, tmp_path):
    """As test_chunks_late_and_repeated, with two keys for all files, over restarts."""
    schema = "file string, lang string, seq int, content string, last boolean"
    batches = [
        [("a", "c", 2, "(2);", True), ("b", "c", 0, "call(3", False)],
        [("a", "c", 0, "call(1); c", False), ("b", "c", 1, "0);", True), ("b", "c", 0, "call(3", False)],
        [("a", "c", 1, "all", False), ("a", "c", 1, "all", False), ("b", "c", 1, "0);", True), ("n", "c", 0, "call(9);", False)],
        [("a", "c", 2, "(2);", True), ("b", "c", 0, "call(3", False), ("d", "c", 0, "call(4);", True), ("e", "c", 0, "no", True)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        scan_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), load("patterns: ['call($N)']\nlanguages: [c]"), str(tmp_path / "out"), str(tmp_path / "staging"), groups=2).awaitTermination()
    got = sorted((r.file, r.start.offset, r.captures["N"]) for r in read_findings(spark, str(tmp_path / "out")).collect())
    assert got == [("a", 0, "1"), ("a", 9, "2"), ("b", 0, "30"), ("d", 0, "4")]
    state = spark.read.format("statestore")
    kept = state.option("stateVarName", "waiting").load(str(tmp_path / "staging/progress")).selectExpr("value.files AS f").collect()
    assert [[x[0] for x in json.loads(r.f)[1]] for r in kept] == [["n"]]
    assert spark.read.format("statestore").option("stateVarName", "chunks").load(str(tmp_path / "staging/progress")).count() == 1


def test_files_of_the_stream_query_share_keys(spark, tmp_path, monkeypatch):
    """Before, each file was a key of the state, with its own exchanges between worker and state."""
    texts = [(k, f"{'x ' * 700 * (k % 3)}token = s{k} ;") for k in range(400)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    folders = []
    monkeypatch.setattr(queries, "delete", lambda _, folder: folders.append(folder))
    found = queries.stream_equals_batch(spark, str(tmp_path)).collect()
    assert sorted(r.v for r in found) == sorted(f"s{k}" for k, _ in texts)
    done = spark.read.format("statestore").option("stateVarName", "done").load(f"{folders[0]}/staging/progress")
    assert done.count() == 400 and done.select("key").distinct().count() <= 16
