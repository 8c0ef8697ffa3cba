"""Tokens and findings in SQL.

register(spark) adds a table function: SELECT p.page_id, t.* FROM pages p, LATERAL tokens(p.html, 'js') t. A scan is many
joins over a whole table, so it is a view instead: findings_view(spark, "hits", "SELECT ... AS file, ... AS lang, ... AS content",
"rules", "yaml") with the texts of rule files in a column of a table; each use of the view runs on stored findings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udf

from tokenloom.api import find
from tokenloom.functions.shared import cut
from tokenloom.functions.tokenize import KINDS, LANGUAGES, LEVEL, MAX_LENGTH, SLICE_BYTES, lex_arrays, places
from tokenloom.plans.pattern import load

_NAMES = ["idx", "kind", "tok", "level", "start", "end", "line", "column"]
TOKENS = ", ".join(f"`{n}` {'string' if n in ('kind', 'tok') else 'int' if n == 'level' else 'bigint'}" for n in _NAMES)


def _text(tok: pa.Array) -> pa.Array:
    try:
        return tok.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        return pa.array([None if t is None else t.decode("utf-8", "replace") for t in tok.to_pylist()], pa.string())


def _rows(content: pa.Array, lang: pa.Array, folded: pa.Array, max_length: pa.Array) -> pa.Array:
    """The tokens of each text, as a list of rows."""
    parts: list[list[pa.Array]] = [[] for _ in _NAMES]
    count = [0]
    for data, name, fold, most in zip(content, *(x.to_pylist() for x in (lang, folded, max_length)), strict=True):
        known = data.is_valid and name in LANGUAGES
        data = data.as_py() if known else b""
        kind, tok, level, start, end = lex_arrays(data, name if known else LANGUAGES[0], MAX_LENGTH if most is None else most, fold is None or fold)
        line, column = places(data, start)
        columns = [pa.array(np.arange(len(kind))), pa.array(KINDS).take(pa.array(kind)), _text(tok), pa.array(level.astype(np.int32), mask=kind != LEVEL), *(pa.array(x, pa.int64()) for x in (start, end, line, column))]
        count.append(len(kind))
        for p, c in zip(parts, columns, strict=True):
            p.append(c)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(count).astype(np.int32)), pa.StructArray.from_arrays([pa.concat_arrays(p) for p in parts], _NAMES))


def token_rows(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """The rows of tokens() for (content, lang, folded, max_length), a slice of texts at a time."""
    for columns in batches:
        part = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(columns[0]), 0), np.int64)) // SLICE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                yield _rows(*(c.slice(a, b - a) for c in columns))


def register(spark: SparkSession) -> None:
    """Add the table function to the session: tokens(content, lang [, folded [, max_length]]), the tokens of one text, with folded strings by default; none for a null text or another language."""
    spark.udf.register("token_rows", arrow_udf(token_rows, f"array<struct<{TOKENS.replace('` ', '`:')}>>"))
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION tokens(content BINARY, lang STRING, folded BOOLEAN DEFAULT true, max_length INT DEFAULT {MAX_LENGTH}) RETURNS TABLE ({TOKENS}) "
        "RETURN SELECT x.* FROM (SELECT explode(token_rows(content, lang, folded, max_length)) AS x)"
    )


def findings_view(spark: SparkSession, name: str, files: str | DataFrame, rules: str, column: str = "yaml", **options) -> DataFrame:
    """A temporary view of the findings of rules (a table or query, with rule file texts in `column`) in files(file, lang, content), computed once."""
    source = files if isinstance(files, DataFrame) else spark.sql(files) if " " in files.strip() else spark.table(files)
    texts = spark.sql(rules) if " " in rules.strip() else spark.table(rules)
    patterns = [p for r in texts.select(column).orderBy(column).collect() for p in load(r[0], f"{rules}.{column}")]
    found = cut(find(source, patterns, **options))
    found.createOrReplaceTempView(name)
    return found
