"""The library's own queries: (spark, sf_dir) -> DataFrame, and independent SQL for them.

Pages count as JavaScript, documents as C, conversations as Python. Where the tables lack a construct, it is put into their whole texts
by a replacement, in Spark and in SQL alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.api import find
from tokenloom.functions.segments import tokenize_segments
from tokenloom.functions.shared import cut, new_folder, release
from tokenloom.functions.tokenize import as_text, tokenize
from tokenloom.plans.pattern import expand, load, load_files
from tokenloom.sources.files import finding_json, read_files
from tokenloom.sources.languages import language_of
from tokenloom.sources.store import delete, write_files
from tokenloom.sql import findings_view, register
from tokenloom.streaming.chunks import read_findings, scan_stream

FLAGSHIP = "lit_capture_track"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("file"), F.lit("js").alias("lang"), F.col("html").alias("content"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("file"), F.lit("c").alias("lang"), F.col("text").alias("content"))


def snippets(spark: SparkSession, lang: str, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(f"s{i}", lang, t) for i, t in enumerate(texts)], "file string, lang string, content string")


def patterns(*texts: str, language: str = "js", **fields):
    import yaml

    return load(yaml.safe_dump({"patterns": list(texts), "languages": [language], **fields}))


def flat(findings: DataFrame, *captures: str) -> DataFrame:
    """Findings in scalar columns."""
    return findings.select("file", F.col("start.offset").alias("s"), F.col("end.offset").alias("e"), *(F.element_at("captures", F.lit(c)).alias(c.lower()) for c in captures))


def tokens_sql(table: str, key: str, text: str, quotes: str) -> str:
    """CTEs `pieces` and `tokens` (file, idx, kind, tok, s, e, line, col) of a text column, C-like, in DuckDB SQL."""
    strings = "|".join(rf"{q}(?:[^{q}\\]|\\[\s\S])*{q}" for q in quotes)
    rx = rf"//[^\n]*|/\*[\s\S]*?\*/|/\*[\s\S]*|[\x00-\x20\x7f]+|{strings}|[{quotes}][\s\S]*|[A-Za-z_\x{{80}}-\x{{10FFFF}}][A-Za-z0-9_\x{{80}}-\x{{10FFFF}}]*|[0-9][0-9_]*|[\s\S]".replace("'", "''")
    q = quotes.replace("'", "''")
    return rf"""
raw AS (SELECT {key}::VARCHAR AS file, regexp_extract_all({text}, '{rx}') AS l FROM {table} WHERE {text} IS NOT NULL),
pieces AS (SELECT file, unnest(l) AS piece, unnest(range(len(l))) AS pos FROM raw),
sized AS (SELECT file, pos, piece, coalesce(sum(strlen(piece)) OVER w, 0) AS s, 1 + coalesce(sum(length(piece) - length(replace(piece, chr(10), ''))) OVER w, 0) AS line FROM pieces WINDOW w AS (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT file, pos, piece, s, line, CASE WHEN regexp_matches(piece, '^[A-Za-z0-9_\x{{80}}-\x{{10FFFF}}]') THEN 'identifier' WHEN length(piece) > 1 AND regexp_full_match(piece, '{strings.replace("'", "''")}') THEN 'string'
  WHEN regexp_matches(piece, '^(?://|/\*|[\x00-\x20\x7f])') THEN NULL WHEN contains('{q}', piece[1:1]) THEN NULL ELSE 'byte' END AS kind,
  s - coalesce(max(CASE WHEN contains(piece, chr(10)) THEN s + strlen(piece) - strlen(list_last(string_split(piece, chr(10)))) END) OVER w, 0) + 1 AS col FROM sized WINDOW w AS (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tokens AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY pos) - 1 AS idx, kind, CASE WHEN kind = 'string' THEN '"' || piece[2:-2] || '"' ELSE piece END AS tok, s::BIGINT AS s, (s + strlen(piece))::BIGINT AS e, line::BIGINT AS line, col::BIGINT AS col FROM marked WHERE kind IS NOT NULL)"""


_QUOTES = "\"'"
C_TOKENS = tokens_sql("documents", "doc_id", "text", _QUOTES)
JS_TOKENS = tokens_sql("pages", "page_id", "html", "\"'`")
DEPTHS = """,
deep AS (SELECT *, sum(CASE WHEN kind = 'byte' AND tok = '(' THEN 1 WHEN kind = 'byte' AND tok = ')' THEN -1 ELSE 0 END) OVER w AS d_round, sum(CASE WHEN kind = 'byte' AND tok = '{' THEN 1 WHEN kind = 'byte' AND tok = '}' THEN -1 ELSE 0 END) OVER w AS d_curly,
  sum(CASE WHEN kind = 'byte' AND tok = '<' THEN 1 WHEN kind = 'byte' AND tok = '>' THEN -1 ELSE 0 END) OVER w AS d_corner FROM tokens WINDOW w AS (PARTITION BY file ORDER BY idx))"""


@query
def tokenize_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1-T4, T14."""
    return tokenize(documents(spark, sf_dir), languages=("c",)).select("file", "idx", "kind", as_text(F.col("tok")).alias("tok"), F.col("start.offset").alias("s"), F.col("end.offset").alias("e"))


ORACLES["tokenize_c"] = f"WITH {C_TOKENS} SELECT file, idx, kind, tok, s, e FROM tokens"


@query
def token_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and columns."""
    return tokenize(pages(spark, sf_dir), languages=("js",)).select("file", "idx", F.col("start.line").alias("line"), F.col("start.column").alias("col"), F.col("start.offset").alias("s"))


ORACLES["token_positions"] = f"WITH {JS_TOKENS} SELECT file, idx, line, col, s FROM tokens"


@query
def token_counts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(documents(spark, sf_dir), languages=("c",)).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("tok").alias("different"))


ORACLES["token_counts_by_kind"] = f"WITH {C_TOKENS} SELECT kind, count(*) AS n, count(DISTINCT tok) AS different FROM tokens GROUP BY kind"


@query
def lit_capture_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P2, P11, S2, R1."""
    return flat(find(pages(spark, sf_dir), patterns("track($N)")), "N")


_TRACK = f"""WITH {JS_TOKENS}, runs AS (SELECT file, s, idx, tok, kind, line, col, lead(line, 3) OVER w AS l3, lead(col, 3) OVER w AS c3, lead(tok) OVER w AS t1, lead(tok, 2) OVER w AS t2, lead(kind, 2) OVER w AS k2, lead(tok, 3) OVER w AS t3, lead(e, 3) OVER w AS e, lead(s, 2) OVER w AS s2, lead(e, 2) OVER w AS e2 FROM tokens WINDOW w AS (PARTITION BY file ORDER BY idx)),
hits AS (SELECT * FROM runs WHERE tok = 'track' AND kind = 'identifier' AND t1 = '(' AND t3 = ')' AND k2 IN ('string', 'identifier'))"""
ORACLES["lit_capture_track"] = f"{_TRACK} SELECT file, s, e, t2 AS n FROM hits"


@query
def set_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9."""
    return flat(find(pages(spark, sf_dir), patterns("track(..^ $N ..$)")), "N")


ORACLES["set_span"] = f"{_TRACK} SELECT file, s2 AS s, e2 AS e, t2 AS n FROM hits"


@query
def suppressed_and_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as JSON lines."""
    found = find(pages(spark, sf_dir), patterns("$_ ( $_N )", out={"rule": "call"}, name="calls"))
    return found.select("file", finding_json(found).alias("line"))


ORACLES["suppressed_and_out"] = f"""{_TRACK} SELECT file, '{{"file":"' || file || '","start":{{"offset":' || s || ',"column":' || col || ',"line":' || line || '}},"end":{{"offset":' || e || ',"column":' || (c3 + 1) || ',"line":' || l3 || '}},"name":"calls","captures":{{"rule":"call"}}}}' AS line
FROM runs WHERE kind IN ('string', 'identifier') AND t1 = '(' AND t3 = ')' AND k2 IN ('string', 'identifier')"""


@query
def secret_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, R2, R3."""
    found = find(documents(spark, sf_dir), patterns("token = $V", language="c", transform={"V": r'^"(?<HEAD>[A-Za-z0-9]{4})[^"]*"$'}))
    return flat(found, "V", "HEAD")


ORACLES["secret_assign"] = f"""WITH {C_TOKENS}, runs AS (SELECT file, s, tok, lead(tok) OVER w AS t1, lead(tok, 2) OVER w AS v, lead(e, 2) OVER w AS e FROM tokens WINDOW w AS (PARTITION BY file ORDER BY idx))
SELECT file, s, e, v, regexp_extract(v, '^"([A-Za-z0-9]{{4}})', 1) AS head FROM runs WHERE tok = 'token' AND t1 = '=' AND regexp_matches(v, '^"[A-Za-z0-9]{{4}}[^"]*"$')"""


@query
def backref_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word said twice."""
    return flat(find(documents(spark, sf_dir), patterns("$A $A", language="c")), "A")


ORACLES["backref_same"] = f"WITH {C_TOKENS}, runs AS (SELECT file, s, tok, kind, lead(tok) OVER w AS t1, lead(kind) OVER w AS k1, lead(e) OVER w AS e FROM tokens WINDOW w AS (PARTITION BY file ORDER BY idx)) SELECT file, s, e, tok AS a FROM runs WHERE kind = 'identifier' AND k1 = 'identifier' AND tok = t1"


@query
def ellipsis_uncontained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1."""
    return flat(find(pages(spark, sf_dir), patterns("title ... track ( $N")), "N")


ORACLES["ellipsis_uncontained"] = f"{_TRACK}, calls AS (SELECT * FROM runs WHERE tok = 'track' AND t1 = '(' AND k2 IN ('string', 'identifier')) SELECT a.file, a.s, c.e2 AS e, c.t2 AS n FROM runs a JOIN calls c ON a.file = c.file AND c.idx > a.idx WHERE a.tok = 'title'"


@query
def ellipsis_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a bracket to its own end."""
    return flat(find(pages(spark, sf_dir), patterns("$F (...)")), "F")


def _bracket_sql(depth: str, first: str, last: str) -> str:
    """From each pair of tokens before a bracket and the bracket to the first token at which the depth falls below that after it."""
    return f"""WITH {JS_TOKENS}{DEPTHS}, opens AS (SELECT * FROM (SELECT file, s, tok AS word, kind AS wk, lead(tok) OVER w AS t1, lead(kind) OVER w AS k1, lead(idx) OVER w AS i1, lead({depth}) OVER w AS d1 FROM deep WINDOW w AS (PARTITION BY file ORDER BY idx)) WHERE t1 = '{first}' AND k1 = 'byte' AND wk IN ('string', 'identifier'))
SELECT o.file, o.s, arg_min(d.e, d.idx) AS e, o.word AS f FROM opens o JOIN deep d ON d.file = o.file AND d.idx > o.i1 AND d.{depth} < o.d1 GROUP BY o.file, o.s, o.word"""


ORACLES["ellipsis_round"] = _bracket_sql("d_round", "(", ")")


@query
def ellipsis_curly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4."""
    return flat(find(pages(spark, sf_dir), patterns("$F {...}")), "F")


ORACLES["ellipsis_curly"] = _bracket_sql("d_curly", "{", "}")


@query
def ellipsis_corner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5."""
    return flat(find(pages(spark, sf_dir), patterns("$F < ..> >")), "F")


ORACLES["ellipsis_corner"] = _bracket_sql("d_corner", "<", ">")


@query
def scope_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From `var` to a call of track that is not outside its scope."""
    return flat(find(pages(spark, sf_dir), patterns("var ..} track ( $N")), "N")


ORACLES["scope_block"] = f"""{_TRACK}{DEPTHS}, calls AS (SELECT * FROM runs WHERE tok = 'track' AND t1 = '(' AND k2 IN ('string', 'identifier'))
SELECT a.file, a.s, c.e2 AS e, c.t2 AS n FROM deep a JOIN calls c ON a.file = c.file AND c.idx > a.idx WHERE a.tok = 'var' AND NOT EXISTS (SELECT 1 FROM deep d WHERE d.file = a.file AND d.idx > a.idx AND d.idx < c.idx AND d.d_curly < a.d_curly)"""


@query
def statement_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement to its semicolon."""
    return flat(find(pages(spark, sf_dir), patterns("var $V = ..! ;")), "V")


ORACLES["statement_block"] = f"""WITH {JS_TOKENS}{DEPTHS}, heads AS (SELECT * FROM (SELECT file, s, tok, d_curly, lead(tok) OVER w AS v, lead(kind) OVER w AS vk, lead(tok, 2) OVER w AS t2, lead(idx, 2) OVER w AS i2 FROM deep WINDOW w AS (PARTITION BY file ORDER BY idx)) WHERE tok = 'var' AND t2 = '=' AND vk IN ('string', 'identifier'))
SELECT h.file, h.s, z.e, h.v FROM heads h JOIN deep z ON z.file = h.file AND z.idx > h.i2 AND z.tok = ';' AND z.kind = 'byte'
WHERE NOT EXISTS (SELECT 1 FROM deep d WHERE d.file = h.file AND d.idx > h.i2 AND d.idx < z.idx AND (d.d_curly < h.d_curly OR d.d_curly = h.d_curly AND d.tok = ';' AND d.kind = 'byte'))"""


@query
def alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of two words, or none, before a call."""
    return flat(find(pages(spark, sf_dir), patterns("..- ; ..| ..- track ( $N")), "N")


ORACLES["alternation"] = f"{_TRACK}, calls AS (SELECT *, lag(s) OVER (PARTITION BY file ORDER BY idx) AS before, lag(tok) OVER (PARTITION BY file ORDER BY idx) AS tok0 FROM runs) SELECT file, unnest(CASE WHEN tok0 = ';' THEN [s, before] ELSE [s] END) AS s, e2 AS e, t2 AS n FROM calls WHERE tok = 'track' AND t1 = '(' AND k2 IN ('string', 'identifier')"


@query
def repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any number of closing tags between the end of the call and the beginning of the page's body."""
    return flat(find(pages(spark, sf_dir), patterns("$N ) ; ..* < / $_ > ..* < body >")), "N")


ORACLES["repetition"] = f"""WITH RECURSIVE {JS_TOKENS}, runs AS (SELECT file, idx, s, tok, kind, lead(tok) OVER w AS t1, lead(tok, 2) OVER w AS t2, lead(kind, 2) OVER w AS k2, lead(tok, 3) OVER w AS t3, lead(e, 2) OVER w AS e2 FROM tokens WINDOW w AS (PARTITION BY file ORDER BY idx)),
part(file, s, n, pos) AS (SELECT file, s, tok, idx + 3 FROM runs WHERE kind IN ('string', 'identifier') AND t1 = ')' AND t2 = ';' UNION ALL SELECT p.file, p.s, p.n, p.pos + 4 FROM part p JOIN runs r ON r.file = p.file AND r.idx = p.pos WHERE r.tok = '<' AND t1 = '/' AND k2 IN ('string', 'identifier') AND t3 = '>')
SELECT p.file, p.s, r.e2 AS e, p.n FROM part p JOIN runs r ON r.file = p.file AND r.idx = p.pos WHERE r.tok = '<' AND t1 = 'body' AND t2 = '>'"""


@query
def template_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6."""
    return flat(find(pages(spark, sf_dir), patterns("{{F}} ( {{G}} )", templates={"F": ["track", "load"], "G": ["$N", "$N , $M"]})), "N")


ORACLES["template_expand"] = f"{_TRACK} SELECT file, s, e, t2 AS n FROM runs WHERE tok IN ('track', 'load') AND t1 = '(' AND t3 = ')' AND k2 IN ('string', 'identifier')"


@query
def group_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call takes in the statements around it that agree on N."""
    rules = patterns("track($N)", name="call", group={"name": "g", "match": ["N"]}) + patterns("var $V = ..} track($N);", name="outer", group={"name": "g"})
    return flat(find(pages(spark, sf_dir), rules), "N", "V")


_GROUP = f"""{_TRACK}{DEPTHS}, outer_ AS (SELECT a.file, a.s, z.e, c.t2 AS n, v.tok AS v FROM deep a JOIN tokens v ON v.file = a.file AND v.idx = a.idx + 1 AND v.kind IN ('string', 'identifier') JOIN tokens q ON q.file = a.file AND q.idx = a.idx + 2 AND q.tok = '='
JOIN hits c ON c.file = a.file AND c.idx > a.idx + 2 JOIN tokens z ON z.file = c.file AND z.idx = c.idx + 4 AND z.tok = ';'
WHERE a.tok = 'var' AND NOT EXISTS (SELECT 1 FROM deep d WHERE d.file = a.file AND d.idx > a.idx AND d.idx < c.idx AND d.d_curly < a.d_curly))"""
ORACLES["group_merge"] = f"{_GROUP} SELECT h.file, coalesce(min(o.s), h.s) AS s, coalesce(max(o.e), h.e) AS e, h.t2 AS n, max(o.v) AS v FROM hits h LEFT JOIN outer_ o ON o.file = h.file AND o.s <= h.s AND o.e >= h.e AND o.n = h.t2 GROUP BY h.file, h.s, h.e, h.t2"


@query
def group_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening brackets but for those in a statement that begins with var."""
    rules = patterns("$F ( $N )", name="call", group={"name": "g"}) + patterns("var $V = ..} track($N);", name="outer", group={"name": "g", "cancel": True})
    return flat(find(pages(spark, sf_dir), rules), "F", "N")


ORACLES["group_cancel"] = f"{_GROUP}, calls AS (SELECT * FROM runs WHERE kind IN ('string', 'identifier') AND t1 = '(' AND t3 = ')' AND k2 IN ('string', 'identifier')) SELECT h.file, h.s, h.e, h.tok AS f, h.t2 AS n FROM calls h WHERE NOT EXISTS (SELECT 1 FROM outer_ o WHERE o.file = h.file AND o.s <= h.s AND o.e >= h.e)"


@query
def group_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding for each member of a unique rule."""
    rules = patterns("track($N)", name="call", group={"name": "g"}) + patterns("$T > ..} track($_) ;", name="tag", group={"name": "g", "unique": True})
    return flat(find(pages(spark, sf_dir), rules), "N", "T")


ORACLES["group_unique"] = f"""{_TRACK}{DEPTHS}, tags AS (SELECT a.file, a.s, z.e, a.tok AS t FROM deep a JOIN deep g ON g.file = a.file AND g.idx = a.idx + 1 AND g.tok = '>' AND g.kind = 'byte' JOIN hits c ON c.file = a.file AND c.idx > a.idx + 1 JOIN tokens z ON z.file = c.file AND z.idx = c.idx + 4 AND z.tok = ';'
WHERE a.kind IN ('string', 'identifier') AND NOT EXISTS (SELECT 1 FROM deep d WHERE d.file = a.file AND d.idx > g.idx AND d.idx < c.idx AND d.d_curly < g.d_curly)),
combos AS (SELECT h.file, h.s AS hs, coalesce(t.s, h.s) AS s, coalesce(t.e, h.e) AS e, h.t2 AS n, t.t, row_number() OVER (PARTITION BY h.file, h.s ORDER BY t.e, t.s DESC) AS k FROM hits h LEFT JOIN tags t ON t.file = h.file AND t.s <= h.s AND t.e >= h.e) SELECT file, s, e, n, t FROM combos WHERE k <= 64"""


@query
def tokenize_py_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Python, each turn a line, indented by turn: changes of indentation, none inside round brackets."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    line = F.concat(F.repeat(F.lit(" "), (F.col("turn") * 3 % 4).cast("int")), F.coalesce("text", F.lit("")))
    files = turns.groupBy(F.col("conv_id").cast("string").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("content"))
    found = tokenize(files.withColumn("lang", F.lit("py")), languages=("py",))
    return found.select("file", "idx", "kind", as_text(F.col("tok")).alias("tok"), "level", F.col("start.offset").alias("s"))


# A level is the change of the number of different indentations above 0 that are open: those that no later line was less indented than.
ORACLES["tokenize_py_levels"] = r"""WITH lines_ AS (SELECT conv_id::VARCHAR AS file, turn, repeat(' ', (turn * 3 % 4)::INT) || coalesce(text, '') AS line FROM conversations),
files AS (SELECT file, string_agg(line, chr(10) ORDER BY turn, line) AS content FROM lines_ GROUP BY file),
raw AS (SELECT file, regexp_extract_all(content, '#[^\n]*|\n[ \t]*|[\x00-\x09\x0b-\x20\x7f]+|"{3}[\s\S]*?"{3}|''{3}[\s\S]*?''{3}|"(?:[^"\\]|\\[\s\S])*"|''(?:[^''\\]|\\[\s\S])*''|["''][\s\S]*|[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*|[0-9][0-9_]*|[\s\S]') AS l FROM files),
pieces AS (SELECT file, unnest(l) AS piece, unnest(range(len(l))) AS pos, len(l) AS n FROM raw),
sized AS (SELECT *, coalesce(sum(strlen(piece)) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, sum(CASE piece WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pos) AS up FROM pieces),
open_ AS (SELECT *, up - least(0, min(up) OVER (PARTITION BY file ORDER BY pos)) AS depth FROM sized),
lines AS (SELECT file, pos, row_number() OVER (PARTITION BY file ORDER BY pos) AS ln, strlen(piece) - 1 AS a FROM open_ WHERE piece[1:1] = chr(10) AND depth = 0 AND pos < n - 1),
kept AS (SELECT i.file, i.ln, count(DISTINCT j.a) AS d FROM lines i JOIN lines j ON j.file = i.file AND j.ln <= i.ln AND j.a > 0 AND NOT EXISTS (SELECT 1 FROM lines k WHERE k.file = i.file AND k.ln > j.ln AND k.ln <= i.ln AND k.a < j.a) GROUP BY i.file, i.ln),
changes AS (SELECT l.file, l.pos, (coalesce(k.d, 0) - coalesce(b.d, 0))::INT AS level FROM lines l LEFT JOIN kept k ON k.file = l.file AND k.ln = l.ln LEFT JOIN kept b ON b.file = l.file AND b.ln = l.ln - 1),
marked AS (SELECT p.*, c.level, CASE WHEN c.level IS NOT NULL THEN 'level' WHEN regexp_matches(piece, '^[A-Za-z0-9_\x{80}-\x{10FFFF}]') THEN 'identifier' WHEN regexp_matches(piece, '^[#\x00-\x20\x7f]') THEN NULL WHEN length(piece) > 1 AND piece[1:1] IN ('"', '''') AND piece[-1:] = piece[1:1] THEN 'string' WHEN piece[1:1] IN ('"', '''') THEN NULL ELSE 'byte' END AS kind FROM open_ p LEFT JOIN changes c ON c.file = p.file AND c.pos = p.pos)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY pos) - 1 AS idx, kind, CASE kind WHEN 'string' THEN '"' || piece[2:-2] || '"' WHEN 'level' THEN NULL ELSE piece END AS tok, level, (s + (kind = 'level')::INT)::BIGINT AS s FROM marked WHERE kind IS NOT NULL"""


@query
def tokenize_rust_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Rust, in which some words begin with a lifetime's quotation mark and some letters are characters."""
    files = documents(spark, sf_dir).withColumns({"lang": F.lit("rust"), "content": F.replace(F.replace("content", F.lit(" th"), F.lit(" 't' h")), F.lit(" e"), F.lit(" 'e"))})
    return tokenize(files, languages=("rust",)).select("file", "idx", "kind", as_text(F.col("tok")).alias("tok"), F.col("start.offset").alias("s"))


ORACLES["tokenize_rust_quotes"] = r"""WITH raw AS (SELECT doc_id::VARCHAR AS file, regexp_extract_all(replace(replace(text, ' th', ' ''t'' h'), ' e', ' ''e'), '//[^\n]*|/\*[\s\S]*?\*/|/\*[\s\S]*|[\x00-\x20\x7f]+|"(?:[^"\\]|\\[\s\S])*"|''[A-Za-z_\x{80}-\x{10FFFF}]''|''''|''[^A-Za-z_\x{80}-\x{10FFFF}''][^'']*''|"[\s\S]*|''[A-Za-z_\x{80}-\x{10FFFF}]\z|''\z|''[^A-Za-z_\x{80}-\x{10FFFF}''][\s\S]*|[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*|[0-9][0-9_]*|[\s\S]') AS l FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT file, unnest(l) AS piece, unnest(range(len(l))) AS pos FROM raw),
sized AS (SELECT *, coalesce(sum(strlen(piece)) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, max(pos) OVER (PARTITION BY file) AS top FROM pieces),
marked AS (SELECT *, CASE WHEN regexp_matches(piece, '^[A-Za-z0-9_\x{80}-\x{10FFFF}]') THEN 'identifier' WHEN regexp_matches(piece, '^(?://|/\*|[\x00-\x20\x7f])') THEN NULL WHEN length(piece) > 1 AND piece[1:1] IN ('"', '''') AND piece[-1:] = piece[1:1] THEN 'string' WHEN length(piece) > 1 AND piece[1:1] IN ('"', '''') OR piece = '"' OR piece = '''' AND pos = top THEN NULL ELSE 'byte' END AS kind FROM sized)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY pos) - 1 AS idx, kind, CASE kind WHEN 'string' THEN '"' || piece[2:-2] || '"' ELSE piece END AS tok, s FROM marked WHERE kind IS NOT NULL"""


@query
def string_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence of a document as strings to be joined; very long ones are no strings any more."""
    words = F.replace(F.replace(F.replace("content", F.lit('"'), F.lit("")), F.lit(". "), F.lit('" ; "')), F.lit(" "), F.lit('" + "'))
    files = documents(spark, sf_dir).withColumn("content", F.concat(F.lit('"'), words, F.lit('"')))
    found = tokenize(files, languages=("c",), folded=True)
    return found.select("file", "idx", "kind", as_text(F.col("tok")).alias("tok"), F.col("start.offset").alias("s"), F.col("end.offset").alias("e"))


ORACLES["string_concat"] = f"""WITH quoted AS (SELECT doc_id, '"' || replace(replace(replace(text, '"', ''), '. ', '" ; "'), ' ', '" + "') || '"' AS text FROM documents WHERE text IS NOT NULL), {tokens_sql("quoted", "doc_id", "text", _QUOTES)},
near AS (SELECT *, kind = 'string' AS str, coalesce(lag(kind) OVER w = 'string', false) AS ps, coalesce(lead(kind) OVER w = 'string', false) AS ns FROM tokens WINDOW w AS (PARTITION BY file ORDER BY idx)),
signs AS (SELECT *, NOT str AND kind = 'byte' AND tok IN ('+', '\\') AND ps AND ns AS sign FROM near),
inside AS (SELECT *, sign OR str AND (ps OR coalesce(lag(sign) OVER (PARTITION BY file ORDER BY idx), false)) AS ins FROM signs),
runs AS (SELECT *, sum((NOT ins)::INT) OVER (PARTITION BY file ORDER BY idx) - 1 AS run FROM inside),
joined AS (SELECT file, run, count(*) AS n, arg_min(kind, idx) AS kind, arg_min(tok, idx) AS first_tok, string_agg(CASE WHEN str THEN tok[2:-2] END, '' ORDER BY idx) AS text, min(s) AS s, max(e) AS e, max(strlen(tok)) AS longest FROM runs GROUP BY file, run),
named AS (SELECT *, n > 1 AND strlen(text) > 5000 OR n = 1 AND kind IN ('string', 'identifier') AND longest > 5000 AS overlong FROM joined)
SELECT file, run::BIGINT AS idx, CASE WHEN overlong THEN 'overlong' ELSE kind END AS kind, CASE WHEN overlong THEN NULL WHEN n > 1 THEN '"' || text || '"' ELSE first_tok END AS tok, s, e FROM named"""


@query
def pop_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value followed through as many assignments as a page has list items, in front of the page."""
    chain = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), "n")), lambda i: F.concat(F.lit("n"), i.cast("string"), F.lit(" = n"), (i - 1).cast("string"), F.lit(" ; "))), "")
    files = pages(spark, sf_dir).withColumn("n", F.size(F.split("content", "<li>")) - 1)
    text = F.concat(F.lit("n0 = read ( ) ; "), chain, F.lit("write ( n"), F.greatest(F.lit(1), "n").cast("string"), F.lit(" ) ; write ( n0 ) ; "), F.col("content"))
    rules = patterns("$X = read ( ) ; ..} ..* $Y = %X ; ..} ..* write ( $X )", language="c")
    return flat(find(files.select("file", F.lit("c").alias("lang"), text.alias("content")), rules), "X")


ORACLES["pop_replace"] = """WITH p AS (SELECT page_id::VARCHAR AS file, greatest(1, len(string_split(html, '<li>')) - 1) AS n FROM pages WHERE html IS NOT NULL),
c AS (SELECT file, n, 16 + (SELECT sum(strlen('n' || i || ' = n' || (i - 1) || ' ; ')) FROM range(1, 1000) r(i) WHERE i <= n) + strlen('write ( n' || n || ' )') AS e FROM p)
SELECT file, 0::BIGINT AS s, e::BIGINT AS e, 'n' || n AS x FROM c UNION ALL SELECT file, 0, (e + 15)::BIGINT, 'n0' FROM c"""


@query
def create_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture that any token overwrites; E3: documents in which commas are indices."""
    files = documents(spark, sf_dir).withColumn("content", F.replace("content", F.lit(", "), F.lit(" [ i [ 1 ] ] ")))
    return flat(find(files, patterns("$X [...] %X", language="c")), "X")


# Outer brackets only: the inner one is followed by a bracket.
ORACLES["create_replace"] = f"""WITH indexed AS (SELECT doc_id, replace(text, ', ', ' [ i [ 1 ] ] ') AS text FROM documents), {tokens_sql("indexed", "doc_id", "text", _QUOTES)},
runs AS (SELECT file, s, kind, tok, lead(tok) OVER w AS t1, lead(tok, 2) OVER w AS t2, lead(tok, 3) OVER w AS t3, lead(tok, 4) OVER w AS t4, lead(tok, 5) OVER w AS t5, lead(tok, 6) OVER w AS t6, lead(tok, 7) OVER w AS t7, lead(kind, 7) OVER w AS k7, lead(e, 7) OVER w AS e7 FROM tokens WINDOW w AS (PARTITION BY file ORDER BY idx))
SELECT file, s, e7 AS e, t7 AS x FROM runs WHERE kind IN ('string', 'identifier') AND t1 = '[' AND t2 = 'i' AND t3 = '[' AND t4 = '1' AND t5 = ']' AND t6 = ']' AND k7 IN ('string', 'identifier')"""


@query
def lang_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of file names: the pages' addresses with endings of our own."""
    endings = F.array(*map(F.lit, ["RS", "c", "kts", "html", "tar.ts", "unknown", "mjs", "Py", "go", "java", "CS", "hpp"]))
    names = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat("url", F.lit("."), F.get(endings, (F.col("page_id") % 12).cast("int"))).alias("file"))
    return names.select("file", language_of(F.col("file")).alias("lang"), language_of(F.col("file"), compat=True).alias("compat")).where("lang is not null")


ORACLES["lang_route"] = """WITH n AS (SELECT url || '.' || (['RS', 'c', 'kts', 'html', 'tar.ts', 'unknown', 'mjs', 'Py', 'go', 'java', 'CS', 'hpp'])[page_id % 12 + 1] AS file, (['rust', 'c', 'kotlin', NULL, 'ts', NULL, 'js', 'py', 'go', 'java', 'csharp', 'c'])[page_id % 12 + 1] AS lang FROM pages)
SELECT file, lang, CASE lang WHEN 'kotlin' THEN 'js' ELSE lang END AS compat FROM n WHERE lang IS NOT NULL"""


@query
def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive in chunks of 1000 characters, in four micro-batches in no order, some chunks twice."""
    size = 1000
    table = documents(spark, sf_dir)
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("content") / size).cast("int") - 1, F.lit(0)))
    places = table.where("content is not null").select("file", "lang", "content", F.explode(cuts).alias("seq"))
    times = lambda k: sum((F.pmod(F.xxhash64("file", "seq"), F.lit(n)) == k).cast("int") for n in (4, 29))
    chunk = ("file", "lang", "seq", F.col("content").substr(F.col("seq") * size + 1, F.lit(size)).alias("content"), ((F.col("seq") + 1) * size >= F.length("content")).alias("last"))
    parts = [places.select("*", F.explode(F.array_repeat(F.lit(k), times(k))).alias("k")).select(*chunk) for k in range(4)]
    groups = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), table.count() // 256)
    folder = new_folder(spark, "stream")
    for part in parts:  # as many files as the table has parts; the stream goes on where it has stopped and takes them as one micro-batch
        part.write.mode("append").option("compression", "zstd").parquet(f"{folder}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
        scan_stream(stream, patterns("token = $S", language="c"), f"{folder}/out", f"{folder}/staging", groups=groups).awaitTermination()
        release(spark)
    found = cut(read_findings(spark, f"{folder}/out").select("file", F.col("start.offset").alias("s"), F.col("end.offset").alias("e"), F.col("captures")["S"].alias("v")))
    delete(spark, folder)
    return found


ORACLES["stream_equals_batch"] = f"WITH {C_TOKENS}, runs AS (SELECT file, s, tok, lead(tok) OVER w AS t1, lead(tok, 2) OVER w AS v, lead(kind, 2) OVER w AS k, lead(e, 2) OVER w AS e FROM tokens WINDOW w AS (PARTITION BY file ORDER BY idx)) SELECT file, s, e, v FROM runs WHERE tok = 'token' AND t1 = '=' AND k IN ('string', 'identifier')"


@query
def template_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of a template text, and how many documents hold each."""
    values = spark.createDataFrame([(x,) for x in expand("{{A}}{{B}}{{A}}", {"A": ["a", "e"], "B": ["n", "r"]})], "pattern string")
    met = documents(spark, sf_dir).join(F.broadcast(values), F.contains("content", "pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    return values.join(met, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n"))


ORACLES["template_values"] = "SELECT pattern, (SELECT count(*) FROM documents WHERE contains(text, pattern)) AS n FROM (VALUES ('ana'), ('ara'), ('ene'), ('ere')) AS v(pattern)"


@query
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a file, under names and folders that begin with `_` or `.` or have brackets, and rules in a folder of such names."""
    folder = new_folder(spark, "files")
    part = lambda names, n: F.get(F.array(*map(F.lit, names)), (F.col("file").cast("long") % n).cast("int"))
    name = F.concat(part(_FOLDERS, len(_FOLDERS)), part(_BEGINNINGS, len(_BEGINNINGS)), F.col("file"), part(_ENDINGS, len(_ENDINGS)))
    write_files(pages(spark, sf_dir).withColumn("file", name), f"{folder}/in")
    rules = spark.createDataFrame([(".rules/_a.yml", "patterns: ['track($N)']\nlanguages: [js]"), ("b.yaml", "patterns: ['nowhere $X']\nlanguages: [ts]"), ("c.YML", "no rule")], "file string, content string")
    write_files(rules, f"{folder}/rules")
    found = cut(flat(find(read_files(spark, f"{folder}/in"), load_files(spark, f"{folder}/rules")), "N"))
    delete(spark, folder)
    return found


_FOLDERS, _BEGINNINGS, _ENDINGS = ["", ".d/", "__tests__/", "g[1]/", "deep/er er/"], ["__init__", ".p", "p", "_q?", "é*", "{r}", "s"], [".js", ".mjs", ".txt"]
ORACLES["folder_scan"] = f"{_TRACK} SELECT ({_FOLDERS})[file::BIGINT % {len(_FOLDERS)} + 1] || ({_BEGINNINGS})[file::BIGINT % {len(_BEGINNINGS)} + 1] || file || ({_ENDINGS})[file::BIGINT % {len(_ENDINGS)} + 1] AS file, s, e, t2 AS n FROM hits WHERE file::BIGINT % 3 < 2"


@query
def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 rules, one for each name of a tag, most of which no page has."""
    rules = [p for w in _TAGS for p in patterns(f"< {w} $A = $V", name=w)]
    found = find(pages(spark, sf_dir), rules)
    return found.select("file", "name", F.col("start.offset").alias("s"), F.col("end.offset").alias("e"), F.col("captures")["A"].alias("a"), F.col("captures")["V"].alias("v"))


_TAGS = ["a", "body", "div", "form", "head", "html", "img", "input", "li", "link", "main", "meta", "nav", "p", "script", "section", "span", "style", "ul", "article"] + [f"tag{k}" for k in range(180)]
ORACLES["many_rules"] = f"""WITH {JS_TOKENS}, runs AS (SELECT file, s, tok, lead(tok) OVER w AS t1, lead(tok, 2) OVER w AS t2, lead(kind, 2) OVER w AS k2, lead(tok, 3) OVER w AS t3, lead(tok, 4) OVER w AS t4, lead(kind, 4) OVER w AS k4, lead(e, 4) OVER w AS e FROM tokens WINDOW w AS (PARTITION BY file ORDER BY idx))
SELECT file, t1 AS name, s, e, t2 AS a, t4 AS v FROM runs WHERE tok = '<' AND list_contains({_TAGS}, t1) AND k2 IN ('string', 'identifier') AND t3 = '=' AND k4 IN ('string', 'identifier')"""


@query
def repetition_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any number of opening or closing tags without attributes, and the tag that follows."""
    return flat(find(pages(spark, sf_dir), patterns("track ( $N ) ; ..* < / $_ > ..| < $_ > ..* < $W")), "N", "W")


ORACLES["repetition_branches"] = f"""WITH RECURSIVE {JS_TOKENS}, runs AS (SELECT file, idx, s, lead(e) OVER w AS e1, tok, kind, lead(tok) OVER w AS t1, lead(kind) OVER w AS k1, lead(tok, 2) OVER w AS t2, lead(kind, 2) OVER w AS k2, lead(tok, 3) OVER w AS t3, lead(tok, 4) OVER w AS t4 FROM tokens WINDOW w AS (PARTITION BY file ORDER BY idx)),
part(file, s, n, pos) AS (SELECT file, s, t2, idx + 5 FROM runs WHERE tok = 'track' AND t1 = '(' AND k2 IN ('string', 'identifier') AND t3 = ')' AND t4 = ';' UNION ALL SELECT p.file, p.s, p.n, p.pos + CASE WHEN t1 = '/' THEN 4 ELSE 3 END FROM part p JOIN runs r ON r.file = p.file AND r.idx = p.pos
  WHERE r.tok = '<' AND (t1 = '/' AND k2 IN ('string', 'identifier') AND t3 = '>' OR k1 IN ('string', 'identifier') AND t2 = '>'))
SELECT p.file, p.s, r.e1 AS e, p.n, r.t1 AS w FROM part p JOIN runs r ON r.file = p.file AND r.idx = p.pos WHERE r.tok = '<' AND r.k1 IN ('string', 'identifier')"""


@query
def group_equals_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named group of a capture's expression has the name of another capture: only equal values are kept."""
    return flat(find(documents(spark, sf_dir), patterns("$A $B", language="c", transform={"A": "(?<B>[a-z]+)$"})), "A", "B")


ORACLES["group_equals_capture"] = f"WITH {C_TOKENS}, runs AS (SELECT file, s, tok, kind, lead(tok) OVER w AS b, lead(kind) OVER w AS kb, lead(e) OVER w AS e FROM tokens WINDOW w AS (PARTITION BY file ORDER BY idx)) SELECT file, s, e, tok AS a, b FROM runs WHERE kind IN ('string', 'identifier') AND kb IN ('string', 'identifier') AND regexp_extract(tok, '([a-z]+)$', 1) = b AND b <> ''"


@query
def span_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: a span that ends before it begins is turned round."""
    return flat(find(pages(spark, sf_dir), patterns("track ..$ ( ..^ $N )")), "N")


ORACLES["span_reversed"] = f"{_TRACK} SELECT file, s + 5 AS s, s2 AS e, t2 AS n FROM hits"


@query
def group_unique_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No more than two results for the unique members of a finding."""
    rules = patterns("track($N)", name="call", group={"name": "g"}) + patterns("$T > ..} track($_) ;", name="tag", group={"name": "g", "unique": True})
    return flat(find(pages(spark, sf_dir), rules, max_unique=2), "N", "T")


ORACLES["group_unique_limited"] = ORACLES["group_unique"].replace("k <= 64", "k <= 2")


@query
def sql_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1-T4 by the table function: tokens of pages, in SQL."""
    register(spark)
    view = f"pages_{new_folder(spark, 'x')[-32:]}"
    pages(spark, sf_dir).createOrReplaceTempView(view)
    return spark.sql(f"SELECT file, idx, line, column AS col, start AS s FROM {view}, LATERAL tokens(content, 'js', false)")


ORACLES["sql_tokens"] = ORACLES["token_positions"]


@query
def sql_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1, K3 in SQL: a view of the findings of the rules in a table."""
    mark = new_folder(spark, "x")[-32:]
    pages(spark, sf_dir).createOrReplaceTempView(f"pages_{mark}")
    spark.createDataFrame([("patterns: ['track($N)']\nlanguages: [js]",), ("patterns: ['nowhere $N']\nlanguages: [js]",)], "yaml string").createOrReplaceTempView(f"rules_{mark}")
    findings_view(spark, f"hits_{mark}", f"SELECT file, lang, content FROM pages_{mark}", f"rules_{mark}")
    return spark.sql(f"SELECT file, start.offset AS s, end.offset AS e, captures['N'] AS n FROM hits_{mark}")


ORACLES["sql_findings"] = ORACLES["lit_capture_track"]


@query
def tokenize_in_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in segments of 1,000 bytes, each cut into tokens by itself."""
    size = 1000
    whole = documents(spark, sf_dir).where("content is not null").withColumn("content", F.encode("content", "UTF-8"))
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("content") / size).cast("int") - 1, F.lit(0)))
    segments = whole.select("file", "lang", "content", F.explode(cuts).alias("seq")).select("file", "lang", "seq", F.substring("content", F.col("seq") * size + 1, F.lit(size)).alias("content"))
    return tokenize_segments(segments).select("file", "idx", "kind", as_text(F.col("tok")).alias("tok"), F.col("start").alias("s"), F.col("end").alias("e"))


ORACLES["tokenize_in_segments"] = ORACLES["tokenize_c"]
