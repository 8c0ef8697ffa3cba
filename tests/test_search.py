"""Tokens, patterns and findings against hand-written results, and the queries against their SQL."""

import os

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom import queries
from tokenloom.api import find
from tokenloom.functions.regex import java_regex
from tokenloom.functions.tokenize import as_text, tokenize
from tokenloom.plans.pattern import PatternError, expand, load, parse
from tokenloom.sources.files import read_files, write_findings

SMALL = "/root/testdata/sf0.001"


def found(spark, lang, text, *patterns, **fields):
    rows = find(queries.snippets(spark, lang, [text]), queries.patterns(*patterns, language=lang, **fields)).collect()
    return sorted((r.start.offset, r.end.offset, tuple(sorted(r.captures.items()))) for r in rows)


def tokens(spark, lang, text, **options):
    rows = tokenize(queries.snippets(spark, lang, [text]), languages=(lang,), **options).withColumn("tok", as_text(F.col("tok"))).orderBy("idx").collect()
    return [(r.kind, r.level if r.kind == "level" else r.tok, r.start.offset, r.end.offset) for r in rows]


def test_c_tokens(spark):
    assert tokens(spark, "c", "a1 1_0.5 // x\n/*/ b */ 'it\\'s' \"x\ny\"+`") == [
        ("identifier", "a1", 0, 2), ("identifier", "1_0", 3, 6), ("byte", ".", 6, 7), ("identifier", "5", 7, 8), ("string", '"it\\\'s"', 23, 30), ("string", '"x\ny"', 31, 36), ("byte", "+", 36, 37), ("byte", "`", 37, 38)
    ]
    assert tokens(spark, "js", "`a` 'never ends") == [("string", '"a"', 0, 3)]
    assert tokens(spark, "c", "abcdef 'abc' ab", max_length=4) == [("overlong", None, 0, 6), ("overlong", None, 7, 12), ("identifier", "ab", 13, 15)]
    assert tokens(spark, "c", "") == []


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="a1é \n#$&'\"./{}*`()\\", max_size=14), min_size=30, max_size=30), st.sampled_from(["c", "js", "rust", "py"]))
def test_positions_grow(spark, texts, lang):
    rows = tokenize(queries.snippets(spark, lang, texts), languages=(lang,)).orderBy("file", "idx").collect()
    for a, b in zip(rows, rows[1:], strict=False):
        if a.file == b.file:
            assert b.idx == a.idx + 1 and a.end.offset <= b.start.offset and (a.start.line, a.start.column) <= (b.start.line, b.start.column)
    for r in rows:
        data = texts[int(r.file[1:])].encode()
        assert r.start.line == data[: r.start.offset].count(b"\n") + 1
        assert r.start.column == r.start.offset - (data.rfind(b"\n", 0, r.start.offset) + 1) + 1


def test_ellipses(spark):
    assert found(spark, "c", "f(a, (b), c) d)", "f(... $X)") == [(0, 8, (("X", "b"),)), (0, 12, (("X", "c"),))]
    assert found(spark, "c", "{ a; { b; } c; } d;", "a ..} $X ;") == [(2, 9, (("X", "b"),)), (2, 14, (("X", "c"),))]
    assert found(spark, "c", "x = { 1; 2 } 3; y;", "x = ..! ;") == [(0, 8, ()), (0, 15, ())]
    assert found(spark, "c", "a b a b", "a ... b") == [(0, 3, ()), (0, 7, ()), (4, 7, ())]
    assert found(spark, "c", "m[a[1]][2]", "m[...][...]") == [(0, 10, ())]
    assert found(spark, "py", "if a:\n  b\n  c\nd\n", "b ..} $X") == [(8, 13, (("X", "c"),))]


def test_composition(spark):
    assert found(spark, "c", "a x x b; a b", "a ..* x ..* b") == [(0, 7, ()), (9, 12, ())]
    assert found(spark, "c", "a x b a y b a b", "a ..- x ..| y ..- b") == [(0, 5, ()), (6, 11, ())]
    assert found(spark, "c", "k 1 2", "$K ..^ $V ..$ 2") == [(2, 3, (("K", "k"), ("V", "1")))]
    assert found(spark, "c", "$ x", "$ $X") == [(0, 3, (("X", "x"),))] and found(spark, "c", "$ x", "$  x") == [(0, 3, ())]


def test_transform(spark):
    assert found(spark, "c", 'f("a-1") f("b")', "f($S)", transform={"S": r'^"(?<L>[a-z])-(?<N>\d)"$'}, out={"rule": "r"}) == [(0, 8, (("L", "a"), ("N", "1"), ("S", '"a-1"'), ("rule", "r")))]
    assert found(spark, "c", "f(a, b) f(a, a)", "f($X, $_Y)", transform={"_Y": "^(?<X>.)$"}) == [(8, 15, (("X", "a"),))]


def test_templates():
    assert expand("{{A}} {{B}} {{A}}", {"A": ["1", "2"], "B": ["x"]}) == ["1 x 1", "2 x 2"]
    with pytest.raises(PatternError, match="missing template"):
        expand("{{A}}", {})
    with pytest.raises(PatternError, match="template expansions"):
        expand("{{A}}{{B}}", {"A": list("123456789"), "B": list("12345678")})


@pytest.mark.parametrize(
    ("pattern", "message"),
    [("a ..* b", "unclosed repitition"), ("..- a", "unclosed alternation"), ("a ..| b", "only allowed"), ("..* $X ..*", "zero captures"), ("..* ..- a ..- ..*", "not allowed"), ("..- $X ..-", "not allowed"), ("%X", "existing capture"), ("a ..* ... b ..*", "first"), ("a ... ..} b", "incompatible")],
)
def test_pattern_errors(pattern, message):
    with pytest.raises(PatternError, match=message):
        parse(pattern, "c")


def test_pattern_file_errors():
    for text in ("patterns: [a]", "patterns: [a]\nlanguages: [c]\nmore: 1", "patterns: [a]\nlanguages: [cobol]", "patterns: [a]\nlanguages: [c]\ngroup: {unique: true}"):
        with pytest.raises(PatternError, match="YAML load"):
            load(text)
    with pytest.raises(PatternError, match="regex compilation"):
        load("patterns: [$A]\nlanguages: [c]\ntransform: {A: '('}")


def test_groups(spark):
    rules = queries.patterns("go($N)", language="c", name="a", group={"name": "g", "match": ["N"]}) + queries.patterns("$V = go($N) ;", language="c", name="b", group={"name": "g"})
    rows = find(queries.snippets(spark, "c", ["x = go(1); go(2);"]), rules).collect()
    assert sorted((r.start.offset, r.end.offset, r.name, tuple(sorted(r.captures.items()))) for r in rows) == [(0, 10, "g", (("N", "1"), ("V", "x"))), (11, 16, "g", (("N", "2"),))]


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/a.C").write_bytes(b"call(\xff1);")
    (tmp_path / "in/b.txt").write_text("call(2);")
    files = read_files(spark, str(tmp_path / "in"))
    assert [(r.file, r.lang) for r in files.collect()] == [("sub/a.C", "c")]
    write_findings(find(files, queries.patterns("call($N)", language="c", name="n")), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"file":"sub/a.C","start":{"offset":0,"column":1,"line":1},"end":{"offset":8,"column":9,"line":1},"name":"n","captures":{"N":"�1"}}']


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    want = db.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*(F.col(c) for c in columns)).collect()))) == sorted(map(repr, want.fetchall()))


def test_tokens_in_sql(spark):
    from tokenloom.sql import register

    register(spark)
    rows = spark.sql("""SELECT t.* FROM VALUES ('x = "a" + ''b'';\n y', 'c'), (null, 'c'), ('z', 'cobol') AS v(text, lang), LATERAL tokens(text, lang) t""").collect()
    assert [tuple(r) for r in rows] == [(0, "identifier", "x", None, 0, 1, 1, 1), (1, "byte", "=", None, 2, 3, 1, 3), (2, "string", '"ab"', None, 4, 13, 1, 5), (3, "byte", ";", None, 13, 14, 1, 14), (4, "identifier", "y", None, 16, 17, 2, 2)]
    assert [(r.kind, r.level, r.tok) for r in spark.sql("SELECT * FROM tokens('a\\n  bcd', 'py', false, 2)").collect()] == [("identifier", None, "a"), ("level", 1, None), ("overlong", None, None)]


def test_tokens_in_sql_come_in_arrays(spark):
    """Rows of tokens are not pickled one by one, and only the columns asked for leave their arrays; long inputs are answered in slices."""
    import pyarrow as pa

    from tokenloom import sql

    sql.register(spark)
    plan = spark.sql("SELECT t.idx FROM VALUES ('x y', 'c') AS v(text, lang), LATERAL tokens(text, lang) t")._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDTF" not in plan and "ArrowEvalPython" in plan
    rows = spark.sql("SELECT t.kind, t.tok, t.start, t.line FROM VALUES (X'ff200a27412720', 'c'), (X'41', null) AS v(text, lang), LATERAL tokens(text, lang, null, null) t").collect()
    assert [tuple(r) for r in rows] == [("identifier", "�", 0, 1), ("string", '"A"', 3, 2)]
    texts = pa.array([b"a b " * 30_000] * 5)
    found = list(sql.token_rows(iter([(texts, pa.array(["js"] * 5), pa.array([None] * 5, pa.bool_()), pa.array([None] * 5, pa.int32()))])))
    assert len(found) > 1 and [len(x) for f in found for x in f] == [60_000] * 5


def test_tokens_side_by_side_are_those_of_the_expression():
    import random

    from tokenloom.functions import spans
    from tokenloom.functions.tokenize import QUOTES, lex

    pieces = ["a1", "_é", " ", "\n", "12_3", "x.5", '"s\\"t"', "'c'", '"', "'", "`", "/", "//", "/*", "*/", "*", "\\", "/**/", "/*/", "日本", "0x1F", "+", "(", "9", "_", "\x7f", "// c\n", "word" * 3]
    r = random.Random(3)
    for _ in range(1500):
        files = [("".join(r.choices(pieces, k=r.randrange(12))).encode(), r.choice(["c", "js"])) for _ in range(3)]
        data = b"".join(f for f, _ in files)
        ends = [sum(len(f) for f, _ in files[: k + 1]) for k in range(3)]
        starts = [e - len(f) for e, (f, _) in zip(ends, files, strict=True)]
        kind, start, end, count = spans.tokens_in(data, list(zip(starts, ends, strict=True)), [QUOTES[lang] for _, lang in files])
        kind, tok = spans.texts(data, kind, start, end, 5)
        got = list(zip(kind.tolist(), tok.to_pylist(), start.tolist(), end.tolist(), strict=True))
        want = [[(k, t, s + a, e + a) for k, t, _, s, e in zip(*(x if isinstance(x, list) else x.tolist() for x in lex(f, lang, 5)), strict=True)] for (f, lang), a in zip(files, starts, strict=True)]
        assert got == sum(want, []) and count.tolist() == [len(w) for w in want]
