"""Source text to tokens, by one regular expression a language that covers every byte.

A file's tokens are worked out in one pass inside the task that reads it, piece by piece in C and side by side in numpy, and stay together as parallel
arrays in the file's row (token_lists), so that nothing is shuffled or sorted to number them; tokenize() gives a row for each.
White space, control bytes and comments give no token, nor do strings that never end.

Kinds: `string` (its quotes made plain double quotes), `identifier` (numbers too), `byte`, `level` (Python: change of
indentation at a line's start), and `overlong` for strings and identifiers of more than max_length bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.canonical import fold, folds
from tokenloom.functions.spans import texts, tokens_in
from tokenloom.functions.structure import BOUNDS, DEPTHS, depths, left_to_fall, next_ends, next_falls

C_LIKE = ("c", "csharp", "java")
BACKTICK = ("go", "js", "ts", "kotlin")
LANGUAGES = (*C_LIKE, *BACKTICK, "rust", "py")
#: What quotes strings in languages with C's comments.
QUOTES = {lang: b"\"'`" if lang in BACKTICK else b"\"'" for lang in (*C_LIKE, *BACKTICK)}
MAX_LENGTH = 5000
#: Bytes of text that a task cuts into tokens before it sends them on.
SLICE_BYTES = 256 << 10
KINDS = ("string", "identifier", "byte", "level", "overlong")
STRING, IDENTIFIER, BYTE, LEVEL, OVERLONG = range(5)

_IDENT = rb"[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*+|[0-9][0-9_]*+"
_SKIP = rb"//[^\n]*+|/\*[\s\S]*?\*/|/\*[\s\S]*+|[\x00-\x20\x7f]++"


def _quoted(q: bytes) -> bytes:
    return rb"%b[^%b\\]*+(?:\\[\s\S][^%b\\]*+)*+%b" % (q, q, q, q)


def _parts(lang: str) -> tuple[bytes, ...]:
    """Expressions of: a line end with its indentation (Python), a Python string in three quotes, a string, a string that never ends, what is left out."""
    line, triple, skip = rb"(?!)", rb"(?!)", _SKIP
    if lang == "py":
        line, skip = rb"\n[ \t]*+", rb"#[^\n]*+|[\x00-\x09\x0b-\x20\x7f]++"
        triple = rb'"""[\s\S]*?"""|' + rb"'''[\s\S]*?'''"
        string = rb"(?!\"\"\"|''')(?:" + _quoted(b'"') + b"|" + _quoted(b"'") + b")"
        dead = rb"[\"'][\s\S]*+"
    elif lang == "rust":
        start = rb"A-Za-z_\x80-\xff"
        string = _quoted(b'"') + rb"|'[%b]'|''|'[^%b'][^']*+'" % (start, start)
        dead = rb'"[\s\S]*+' + rb"|'[%b]\Z|'\Z|'[^%b'][\s\S]*+" % (start, start)
    else:
        quotes = (b'"', b"'", b"`") if lang in BACKTICK else (b'"', b"'")
        string = b"|".join(map(_quoted, quotes))
        dead = b"[" + b"".join(quotes) + rb"][\s\S]*+"
    return line, triple, string, dead, skip


@lru_cache(maxsize=16)
def expression(lang: str) -> re.Pattern[bytes]:
    """Every byte of a text lies in one match."""
    line, triple, string, dead, skip = _parts(lang)
    return re.compile(b"(?:" + b"|".join((skip, line, triple, string, dead, _IDENT, rb"[\s\S]")) + b")")


@lru_cache(maxsize=16)
def never_ends(lang: str) -> re.Pattern[bytes]:
    """Matches the last piece of a text if it is no string, but the beginning of one."""
    _, triple, string, dead, _ = _parts(lang)
    return re.compile(b"(?!(?:" + triple + b"|" + string + rb")\Z)(?:" + dead + b")")


#: By a piece's first byte: the kind of token, or what its length has to tell.
_LEFT_OUT, _COMMENT, _QUOTE = -1, 5, 6


@lru_cache(maxsize=16)
def _first_bytes(lang: str) -> np.ndarray:
    table = np.full(256, BYTE, np.int8)
    table[:33] = table[127] = _LEFT_OUT
    table[128:] = table[65:91] = table[97:123] = table[48:58] = table[95] = IDENTIFIER
    table[ord("#" if lang == "py" else "/")] = _LEFT_OUT if lang == "py" else _COMMENT
    table[ord('"')] = table[ord("'")] = _QUOTE
    if lang in BACKTICK:
        table[ord("`")] = _QUOTE
    if lang == "py":
        table[10] = LEVEL
    return table


def _level_changes(found: list[tuple[int, int]]) -> list[int]:
    """For the indentations of a file's lines, the change of level at each: +1 for a deeper one, -1 for each that ends."""
    stack: list[int] = []
    out = []
    for a in found:
        change = 0
        while stack and stack[-1] > a:
            stack.pop()
            change -= 1
        if not stack or stack[-1] < a:
            change += bool(stack) or a > 0
            stack.append(a)
            del stack[:-1000]
        out.append(int(change))
    return out


def _indent(space: bytes) -> int:
    width = 0
    for c in space:
        width = (width // 8 + 1) * 8 if c == 9 else width + 1
    return width


def lex(data: bytes, lang: str, max_length: int) -> tuple[np.ndarray, list[bytes | None], np.ndarray, np.ndarray, np.ndarray]:
    """(kind, text, level, start, end) of the tokens of one file; levels are 0 but for Python's.

    The expression cuts the text into pieces; their kinds are told from their first bytes and lengths, side by side.
    """
    pieces = expression(lang).findall(data)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    end = np.cumsum(size)
    start = end - size
    first = np.frombuffer(data, np.uint8)[start]
    kind = _first_bytes(lang)[first]
    kind[kind == _COMMENT] = np.where(size[kind == _COMMENT] > 1, _LEFT_OUT, BYTE)
    kind[kind == _QUOTE] = np.where(size[kind == _QUOTE] > 1, STRING, BYTE)  # one alone: a lifetime's
    if pieces and first[-1] in b"\"'`" and never_ends(lang).match(pieces[-1]):
        kind[-1] = _LEFT_OUT
    if lang == "py":
        if len(kind) and kind[-1] == LEVEL:  # an indentation that the file ends in gives nothing
            kind[-1] = _LEFT_OUT
        step = ((kind == BYTE) & (first == 40)).astype(np.int64) - ((kind == BYTE) & (first == 41))
        up = np.cumsum(step)
        kind[(kind == LEVEL) & (up > np.minimum(np.minimum.accumulate(up), 0))] = _LEFT_OUT  # inside round brackets
    kept = np.flatnonzero(kind >= 0)
    kind, first, size, start, end = kind[kept], first[kept], size[kept], start[kept], end[kept]
    texts: list[bytes | None] = [pieces[i] for i in kept.tolist()]
    level = np.zeros(len(kept), np.int32)
    lines = np.flatnonzero(kind == LEVEL)
    if len(lines):
        level[lines] = _level_changes([_indent(texts[i][1:]) for i in lines.tolist()])
        start[lines] += 1
        for i in lines.tolist():
            texts[i] = None
    for i in np.flatnonzero(kind == STRING).tolist():
        text = texts[i]
        width = 3 if lang == "py" and len(text) >= 6 and text[:3] in (b'"""', b"'''") else 1
        if width > 1 or first[i] != 34:
            texts[i] = b'"%b"' % text[width:-width]
    overlong = (kind <= IDENTIFIER) & (size > max_length)
    for i in np.flatnonzero(overlong).tolist():
        texts[i] = None
    kind[overlong] = OVERLONG
    return kind, texts, level, start, end


def lex_arrays(data: bytes, lang: str, max_length: int, folded: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """lex(), or that with neighbouring strings joined, with the texts as an Arrow array; without an object for each token where the language has C's comments."""
    if lang in QUOTES:
        kind, start, end, _ = tokens_in(data, [(0, len(data))], [QUOTES[lang]])
        kind, tok = texts(data, kind, start, end, max_length)
        found = kind, tok, np.zeros(len(kind), np.int32), start, end
        if not (folded and folds(kind)):
            return found
        found = fold(kind, tok.to_pylist(), *found[2:], max_length)
    else:
        found = lex(data, lang, max_length)
        found = fold(*found, max_length) if folded else found
    return found[0], pa.array(found[1], pa.binary()), *found[2:]


def places(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of offsets, from 1."""
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    line = np.searchsorted(breaks, at)
    return line + 1, at - np.concatenate([[0], breaks + 1])[line] + 1


def as_text(column: Column) -> Column:
    """Bytes as UTF-8 text; invalid bytes become U+FFFD."""
    return F.make_valid_utf8(column.cast("string"))


#: Arrays of a file's tokens besides `tok`: numbers from 0 are offsets, from 1 lines and columns.
POSITIONS = ("s", "e", "line", "col", "eline", "ecol")


def list_schema(bounds: tuple[str, ...]) -> str:
    """Of token_lists(): kind, tok, level, POSITIONS, and for bounds the depths before each place, the next places where they fall, and by how much."""
    ints = [*POSITIONS, *(f"{p}{d}" for d in bounds for p in (("", "next_", "left_") if d in DEPTHS else ("next_",)))]
    return ", ".join(["file string", "lang string", "kind array<tinyint>", "tok array<binary>", "level array<int>", *(f"{p} array<int>" for p in ints)])


def bounds_of(kind: np.ndarray, first: np.ndarray, level: np.ndarray, bounds: tuple[str, ...]) -> list[np.ndarray]:
    """The arrays of a file that list_schema() has for bounds. first: the first byte of each token."""
    out = []
    for d in bounds:
        depth = depths(kind, first, level, d if d in DEPTHS else "scope")
        out += [depth, next_falls(depth), left_to_fall(depth)] if d in DEPTHS else [next_ends(depth, kind, first, level)]
    return out


class Needs:
    """Whether a file holds what some rule needs: one automaton looks for the words of all rules at once.

    needs: for each language the sets of words (as bytes) of its rules. A language with an empty set keeps all files.
    """

    def __init__(self, needs: dict[str, list[frozenset[bytes]]]):
        import ahocorasick

        self.all = {lang for lang, sets in needs.items() if frozenset() in sets}
        self.sets: dict[str, list[set[str]]] = {lang: [{w.decode("latin-1") for w in x} for x in sets] for lang, sets in needs.items()}
        self.automaton = ahocorasick.Automaton()
        for w in {w for sets in self.sets.values() for x in sets for w in x}:
            self.automaton.add_word(w, w)
        self.automaton.make_automaton()

    def met(self, data: bytes, lang: str) -> bool:
        if lang in self.all:
            return True
        waiting: dict[str, list[int]] = {}
        missing = []
        for k, x in enumerate(self.sets.get(lang, ())):
            missing.append(len(x))
            for w in x:
                waiting.setdefault(w, []).append(k)
        if waiting:
            for _, word in self.automaton.iter(data.decode("latin-1")):
                for k in waiting.pop(word, ()):
                    missing[k] -= 1
                    if not missing[k]:
                        return True
        return False


def token_lists(
    files: DataFrame, content: str = "content", max_length: int = MAX_LENGTH, languages: tuple[str, ...] | None = None, folded: bool = False, bounds: tuple[str, ...] = (), needs: dict[str, list[frozenset[bytes]]] | None = None
) -> DataFrame:
    """A row for each of files(file, lang, content) that has a text and is of the languages, with arrays of its tokens.

    content is a string or binary column. folded: with neighbouring strings joined. bounds: those of BOUNDS to give. needs:
    only files that hold all words of one of their language's sets.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Needs(needs) if needs is not None else None
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column("content")), np.int64)
            part = np.cumsum(sizes) // SLICE_BYTES
            for p in np.unique(part):
                rows = np.flatnonzero(part == p)
                if (out := one(batch.slice(rows[0], len(rows)), wanted)) is not None:
                    yield out

    def one(batch: pa.RecordBatch, wanted: Needs | None) -> pa.RecordBatch | None:
        columns: list[list[np.ndarray]] = [[] for _ in schema_names]
        toks: list[pa.Array] = []
        count, kept = [0], []
        for i, (content_, lang) in enumerate(zip(batch.column("content"), batch.column("lang").to_pylist(), strict=True)):
            data = content_.as_py()
            data = data.encode() if isinstance(data, str) else data
            if wanted is not None and not wanted.met(data, lang):
                continue
            kept.append(i)
            kind, tok, level, start, end = lex_arrays(data, lang, max_length, folded)
            (line, col), (eline, ecol) = places(data, start), places(data, end)
            values = [kind, level, start, end, line, col, eline, ecol]
            if bounds:
                first = np.append(np.frombuffer(data, np.uint8), 0)[start]
                values += bounds_of(kind, first, level if lang == "py" else np.zeros(len(level), np.int32), bounds)
            for c, v in zip(columns, values, strict=True):
                c.append(v)
            toks.append(tok)
            count.append(len(tok))
        if not kept:
            return None
        offsets = np.cumsum(count).astype(np.int32)
        one_longer = pa.array(offsets + np.arange(len(count), dtype=np.int32))  # one more than tokens
        offsets = pa.array(offsets)
        flat = [np.concatenate(c) for c in columns]
        level = pa.array(flat[1].astype(np.int32), mask=flat[0] != LEVEL)
        lists = [pa.array(flat[0]), pa.concat_arrays(toks), level, *(pa.array(c.astype(np.int32)) for c in flat[2:])]
        one_more = len(lists) - (len(schema_names) - 2 - len(POSITIONS))
        arrays = [pa.ListArray.from_arrays(one_longer if k >= one_more else offsets, x) for k, x in enumerate(lists)]
        rows = pa.array(kept, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("file").take(rows), batch.column("lang").take(rows), *arrays], names)

    schema = list_schema(bounds)
    names = [x.split()[0] for x in schema.split(", ")]
    schema_names = ["kind", "level", *names[5:]]
    base = files.where(F.col(content).isNotNull() & F.col("lang").isin(*(languages or LANGUAGES))).select(F.col("file").cast("string").alias("file"), "lang", F.col(content).alias("content"))
    return base.mapInArrow(cut, schema)


def spread(files: DataFrame) -> DataFrame:
    """files over all cores, if they come in fewer partitions (a small table in one row group); larger inputs stay as they are."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(cores) if files.rdd.getNumPartitions() < cores else files


def tokenize(files: DataFrame, content: str = "content", max_length: int = MAX_LENGTH, languages: tuple[str, ...] | None = None, folded: bool = False) -> DataFrame:
    """(file, lang, idx, kind, tok, level, start, end) for files(file, lang, content); tok holds bytes.

    Null contents have no tokens; files of languages not asked for are left out. idx counts a file's tokens from 0.
    """
    lists = token_lists(spread(files), content, max_length, languages, folded)
    rows = lists.select("file", "lang", F.posexplode(F.arrays_zip("kind", "tok", "level", *POSITIONS)).alias("idx", "x"))
    place = lambda *c: F.struct(*(F.col(f"x.{a}").cast("long").alias(n) for a, n in zip(c, ("offset", "column", "line"), strict=True)))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("x.kind").cast("int") + 1)
    return rows.select("file", "lang", F.col("idx").cast("long").alias("idx"), kind.alias("kind"), F.col("x.tok").alias("tok"), F.col("x.level").alias("level"), place("s", "col", "line").alias("start"), place("e", "ecol", "eline").alias("end"))


__all__ = ["BOUNDS", "DEPTHS", "KINDS", "LANGUAGES", "as_text", "lex", "lex_arrays", "places", "spread", "token_lists", "tokenize"]
