"""Words that differ by one inserted, deleted or replaced character, and the most frequent form of each.

Counting: each task turns its texts into counts of distinct words, which one shuffle by word adds up.

Neighbours, by the pigeonhole principle over even partitions: one edit leaves one half of the shorter word as it is. Every word
of length l is indexed under its two halves (l // 2 characters, and the rest); every word probes, for its own length and
the one below, the halves of that length at its beginning and its end, where the second half has moved by the
difference of lengths. What both halves' keys have in common is a candidate; candidates are verified, and pairs found by
both halves counted once.

A key with more than BUCKET indexed words does not give its pairs: they agree in that half, so their edit lies in the
rest, and each word goes on with longer keys: one half of the rest besides. This ends when the rest has one character
(or, for words one longer, none): all words of such a key are neighbours of each other. So candidates stay in proportion to words
and results, and none is lost.

Defined cases: null texts have no words; repeated rows count as often as they occur; ties of forms go to the first in
code-point order; very long words are words like others; an empty table gives an empty result; other columns of the
input are ignored. A null id hashes as the empty text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import cut, slices, utf8

#: Share of runs that lose a character (one in so many), the fewest characters of a word and its fewest occurrences.
EVERY, SHORTEST, FEWEST = 97, 5, 3
#: Indexed words of a key beyond which it is made longer.
BUCKET = 32
#: Distinct words that a task collects before it sends their counts on.
COUNTS = 400_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3] = True  # U+00C0 to U+00FF are 0xC3 and one byte more
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes up to which checksums of runs are worked out side by side.
_SIDE = 48


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The CRC-32 of each run of bytes, going on from the checksum `before`."""
    out = before ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-sizes, kind="stable")
    register, at, size = out[order], starts[order], sizes[order]
    for k in range(min(int(size[0]) if len(size) else 0, _SIDE)):
        n = int(np.searchsorted(-size, -k, side="left"))  # runs of more than k bytes
        register[:n] = register[:n] >> np.uint32(8) ^ _CRC[(register[:n] ^ data[at[:n] + k]) & np.uint32(255)]
    out[order] = register
    out ^= np.uint32(0xFFFFFFFF)
    for i in order[: int(np.searchsorted(-size, -_SIDE, side="left"))]:
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]].tobytes(), int(before[i]))
    return out


def slice_words(ids: list, column: pa.Array, every: int, shortest: int) -> tuple[pa.Array, list[str]]:
    """The words of some rows: those that are whole runs, and those that have lost a character."""
    data, offsets = utf8(column)
    low = _LOWER[data]
    inside = _LETTER[data]
    lead = data == 0xC3
    inside[1:] |= lead[:-1]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.append(inside[1:], False)
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    sizes = ends - starts
    row = np.searchsorted(offsets, starts, side="right") - 1
    prefix = np.asarray([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    crc = checksums(low, starts, sizes, prefix[row]) if len(starts) else np.zeros(0, np.uint32)
    leads = np.concatenate([[0], np.cumsum(lead)])
    length = sizes - (leads[ends] - leads[starts])
    cut_ = crc % np.uint32(every) == 0
    whole = ~cut_ & (length >= shortest)
    kept = low[inside][np.repeat(whole, sizes)]
    bounds = np.concatenate([[0], np.cumsum(sizes[whole])]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(kept))])
    short = []
    for i in np.flatnonzero(cut_ & (length > shortest)):
        word = low[starts[i] : ends[i]].tobytes().decode()
        k = int(crc[i]) % len(word)
        short.append(word[:k] + word[k + 1 :])
    return words, short


def word_counts(docs: DataFrame, every: int = EVERY, shortest: int = SHORTEST, fewest: int = FEWEST, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): distinct words of docs with at least `shortest` characters that occur at least `fewest` times.

    Words are runs of Latin letters with A-Z lower-cased; a run whose CRC-32 with its document's id `every` divides has lost one character.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        size = 0

        def added() -> pa.Table:
            table = pa.concat_tables(waiting).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
            waiting[:] = [table]
            return table

        for batch in slices(batches, "text"):
            words, short = slice_words(batch.column("id").to_pylist(), batch.column("text"), every, shortest)
            for found in (words, pa.array(short, pa.string())):
                counts = pc.value_counts(found)
                waiting.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
                size += len(counts)
            if size > COUNTS:
                size = len(added())
                if size > COUNTS // 2:
                    yield from waiting.pop().to_batches(50_000)
                    size = 0
        if waiting:
            yield from added().to_batches(50_000)

    rows = docs.where(F.col(text).isNotNull()).select(F.col(id_column).cast("string").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def part(word: Column, a: Column, b: Column) -> Column:
    """Characters a to b - 1 of a word."""
    return word.substr(a + 1, b - a)


def halves(words: DataFrame) -> DataFrame:
    """(probe, word, n, longer, a, b, key): the keys of the halves; a to b is the part of the shorter word in which the edit then lies."""
    w = F.col("word")
    size = F.length("word")
    sides = [(False, False, size), (False, True, size), (True, False, size), (True, True, size - 1)]  # probe, one longer, length of the indexed word
    entries = []
    for probe, longer, length in sides:
        half, shift = F.floor(length / 2).cast("int"), int(longer and probe)
        for number, (low, high, a, b) in enumerate(((F.lit(0), half, half, length), (half, length, F.lit(0), half))):
            moved = shift if number else 0
            key = F.concat_ws("\t", F.lit(int(longer)), length, F.lit(number), part(w, low + moved, high + moved))
            entries.append(F.when(length >= 0, F.struct(F.lit(probe).alias("probe"), F.lit(longer).alias("longer"), a.cast("int").alias("a"), b.cast("int").alias("b"), key.alias("key"))))
    return words.select("word", "n", F.explode(F.array_compact(F.array(*entries))).alias("x")).select("word", "n", "x.*")


def lengthened(rows: DataFrame) -> DataFrame:
    """The rows with one half of the rest added to their keys, each half in turn.

    An inserted character lies between two others, so for words one longer both halves may have the middle character.
    """
    w, a, b, longer = (F.col(c) for c in ("word", "a", "b", "longer"))
    shift = (longer & F.col("probe")).cast("int")
    second = a + F.floor((b - a) / 2).cast("int")
    first = F.when(longer, a + F.ceil((b - a) / 2).cast("int")).otherwise(second)
    left = F.struct(first.alias("a"), b.alias("b"), F.concat_ws("\t", "key", F.lit("0"), part(w, a, first)).alias("key"))
    right = F.struct(a.alias("a"), second.alias("b"), F.concat_ws("\t", "key", F.lit("1"), part(w, second + shift, b + shift)).alias("key"))
    return rows.select("word", "n", "probe", "longer", F.explode(F.array(left, right)).alias("x")).select("word", "n", "probe", "longer", "x.*")


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(word, n, other, other_n): pairs of words(word, n) that differ by one edit, each pair in one row."""
    rows = cut(halves(words))
    found = []
    while True:
        crowded = rows.where("not probe").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > bucket).select("key", F.lit(True).alias("crowded"))
        ends = F.col("b") - F.col("a") <= F.when(F.col("longer"), 0).otherwise(1)
        marked = cut(rows.join(crowded, "key", "left").withColumn("more", F.coalesce("crowded", F.lit(False)) & ~ends).drop("crowded"))
        ready = marked.where("not more")
        index = ready.where("not probe").select("key", "longer", F.col("word").alias("other"), F.col("n").alias("other_n"))
        probes = ready.where("probe").select("key", "word", "n")
        one = F.levenshtein("word", "other", 1) == 1
        found.append(cut(probes.join(index, "key").where((F.col("longer") | (F.col("word") < F.col("other"))) & one).select("word", "n", "other", "other_n").distinct()))
        more = marked.where("more")
        if more.isEmpty():
            break
        rows = cut(lengthened(more.drop("more")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct() if len(found) > 1 else out


def forms(words: DataFrame, bucket: int = BUCKET, factor: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n) for words(word, n): form is the most frequent neighbour, if it is `factor` times as frequent."""
    pairs = near_pairs(words, bucket)
    none = F.lit(None)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    rows = both.unionByName(words.select("word", "n", none.cast("string").alias("other"), none.cast("long").alias("other_n")))
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("m"), "other"))).alias("best")
    met = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), best)
    fits = -F.col("best.m") >= factor * F.col("n")
    return met.select("word", "n", "n_near", F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n"))


def with_roots(found: DataFrame) -> DataFrame:
    """found(word, form, ...) with root: the word that its forms lead to. Steps are doubled, so a chain of n takes log n rounds."""
    up = cut(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        joined = cut(up.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        up = joined.drop("moved")
        if joined.where("moved").isEmpty():
            break
    return found.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, every: int = EVERY, shortest: int = SHORTEST, fewest: int = FEWEST, bucket: int = BUCKET, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of docs."""
    words = cut(word_counts(docs, every, shortest, fewest, id_column, text))
    return with_roots(cut(forms(words, bucket))).select("word", "form", "root", "n", "n_near", "form_n")


#: spelling_variants() on documents with its defaults, as DuckDB SQL.
ORACLE = r"""
WITH RECURSIVE crc_table AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce([b] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM (SELECT range::BIGINT AS b FROM range(256)))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents WHERE text IS NOT NULL),
bytes AS (SELECT run, list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: unicode(c)::BIGINT) AS points FROM runs WHERE length(run) >= 5),
hashed AS (SELECT run, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [p] ELSE [195::BIGINT, p - 64] END)), lambda crc, b: xor(crc >> 8, t[(xor(crc & 255, b) + 1)::BIGINT])), 4294967295) AS h FROM bytes, crc_table),
words AS (SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN run[1:(h % length(run))::BIGINT] || run[(h % length(run) + 2)::BIGINT:] ELSE run END AS word FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
cuts AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 2 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 2 * w.n THEN b.other_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
climb(word, root) AS (SELECT word, word FROM formed UNION ALL SELECT c.word, f.form FROM climb c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
tops AS (SELECT c.word, c.root FROM climb c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, t.root, f.n::BIGINT AS n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM formed f JOIN tops t ON t.word = f.word
"""
