"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (n = 1 to 3, words padded by one space) of a text or of a
language. A document is given the language whose profile has the least out-of-place distance: the sum, over the
document's n-grams, of the difference between the two ranks, or of PROFILE where the language's profile lacks the
n-gram. Language profiles are counted over about SAMPLE_DOCS documents a language, chosen by a hash of the id; every language that
occurs has one. Documents are held against an inverted list of the profiles' entries, ENTRIES at a time, so that memory
does not grow with the number of languages.

Defined cases: null texts and texts without letters are `und` with score 0; with no language learned, every text is
`und`; ties go to the language first in alphabetical order; equal texts get equal results; very long texts are
counted whole; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import cut, remainder, slices

PROFILE = 400
#: Labelled documents a language that its profile is counted over, about.
SAMPLE_DOCS = 2000
#: Entries of the language profiles that are held against documents at a time.
ENTRIES = 2_000_000
#: Languages up to which their numbers of documents are broadcast.
BROADCAST_LANGUAGES = 100_000
UNKNOWN = "und"
_BITS = 21


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of each n-gram of each text, sorted by row; a code holds up to three code points."""
    lowered = [f" {(t or '').lower()} " for t in texts]
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    chars = np.where(letters()[np.minimum(chars, 0x10FFFF)], chars, 32)
    seen = np.zeros(0x110000, bool)
    seen[chars] = True
    alphabet = np.flatnonzero(seen)
    number = np.zeros(0x110000, np.uint32)
    number[alphabet] = np.arange(1, len(alphabet) + 1)
    space = number[32]
    bits, row_bits = int(len(alphabet)).bit_length(), max(1, len(texts).bit_length())
    kind = np.uint32 if 3 * bits + row_bits <= 32 else np.uint64
    dense = number[chars].astype(kind)
    row = np.repeat(np.arange(len(texts), dtype=kind), [len(t) for t in lowered])
    word = dense != space
    row <<= kind(3 * bits)
    one = (row | dense)[word]
    two = (row[:-1] | (dense[:-1] << kind(bits)) | dense[1:])[word[:-1] | word[1:]]
    three = (row[:-2] | (dense[:-2] << kind(2 * bits)) | (dense[1:-1] << kind(bits)) | dense[2:])[word[1:-1]] if len(dense) > 2 else one[:0]
    keys = np.concatenate([one, two, three])
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(keys)))
    keys = keys[first].astype(np.uint64)
    code, mask = np.zeros(len(keys), np.int64), np.uint64((1 << bits) - 1)
    points = np.concatenate([[0], alphabet]).astype(np.int64)
    for k in (2, 1, 0):
        code = (code << _BITS) | points[((keys >> np.uint64(k * bits)) & mask).astype(np.int64)]
    return (keys >> np.uint64(3 * bits)).astype(np.int64), code, count


def top_ngrams(row: np.ndarray, code: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, rank) of each row's most frequent n-grams; equally frequent ones by code."""
    order = np.lexsort((code, -count, row))
    row, code = row[order], code[order]
    begin = np.searchsorted(row, row, side="left")
    rank = np.arange(len(row)) - begin
    keep = rank < most
    return row[keep], code[keep], rank[keep]


def learn_profiles(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", id_column: str = "doc_id") -> list[tuple[str, list[int]]]:
    """The codes of each language's profile, most frequent first, from the rows for which train holds."""
    known = docs.where(train & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(id_column).alias("id"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = cut(sizes)
    if sizes.count() <= BROADCAST_LANGUAGES:
        sizes = F.broadcast(sizes)  # beyond that the texts are shuffled by language
    share = F.lit(float(SAMPLE_DOCS)) / F.col("n")
    chance = F.pmod(F.xxhash64(F.lit("language sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(sizes, "lang").where(chance < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            langs = np.asarray(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for lang_ in sorted(set(langs)):
                row, code, n = ngram_counts([t for t, x in zip(texts, langs, strict=True) if x == lang_])
                codes, at = np.unique(code, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(codes), pa.string()), pa.array(codes), pa.array(np.bincount(at, n, len(codes)).astype(np.int64))], ["lang", "code", "n"])

    grams = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = grams.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= PROFILE)
    profiles: dict[str, list[int]] = {}
    for r in ranked.orderBy("lang", "rank").collect():
        profiles.setdefault(r.lang, []).append(r.code)
    return sorted(profiles.items())


def inverted(profiles: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, begin, language, rank): the entries of codes[i] in the profiles are language[begin[i]:begin[i + 1]], with their ranks."""
    code = np.asarray([c for codes in profiles for c in codes], np.int64)
    language = np.repeat(np.arange(len(profiles)), [len(codes) for codes in profiles])
    rank = np.asarray([k for codes in profiles for k in range(len(codes))], np.int64)
    order = np.argsort(code, kind="stable")
    codes, begin = np.unique(code[order], return_index=True)
    return codes, np.append(begin, len(code)), language[order], rank[order]


def nearest(index: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], n: int, row: np.ndarray, code: np.ndarray, rank: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, its distance, the second least distance) for each of n documents with n-grams (row, code, rank); with one language, the second is that of a profile with none of the n-grams."""
    codes, begin, language, place = index
    at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
    known = codes[at] == code if len(codes) else np.zeros(len(code), bool)
    entries = np.where(known, begin[at + 1] - begin[at], 0) if len(codes) else np.zeros(len(code), np.int64)
    size = np.bincount(row, minlength=n)
    per_row = np.bincount(row, entries, minlength=n)
    part = (np.cumsum(per_row + languages) // ENTRIES).astype(np.int64)
    best, least, second = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    for p in np.unique(part):
        first, stop = np.searchsorted(part, [p, p + 1])
        here = slice(*np.searchsorted(row, [first, stop]))
        k = entries[here]
        which = np.repeat(np.arange(len(k)), k)
        entry = begin[at[here]][which] + np.arange(len(which)) - np.repeat(np.cumsum(k) - k, k)
        saved = PROFILE - np.abs(place[entry] - rank[here][which])
        cell = (row[here][which] - first) * languages + language[entry]
        distance = size[first:stop, None] * PROFILE - np.bincount(cell, saved, minlength=(stop - first) * languages).reshape(-1, languages)
        best[first:stop] = distance.argmin(axis=1)
        low = np.partition(distance, min(1, languages - 1), axis=1)
        least[first:stop] = low[:, 0]
        second[first:stop] = low[:, 1] if languages > 1 else size[first:stop] * PROFILE
    return best, least, second


def identify(docs: DataFrame, profiles: list[tuple[str, list[int]]], text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score); score is near 1 if the second best language is much farther away than the best, 0.5 if both are as near."""
    names = [name for name, _ in profiles]
    index = inverted([codes for _, codes in profiles])
    id_type = dict(docs.dtypes)[id_column]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n = batch.num_rows
            row, code, rank = top_ngrams(*ngram_counts(batch.column("text").to_pylist()), PROFILE)
            size = np.bincount(row, minlength=n)
            best, least, second = nearest(index, n, row, code, rank, max(1, len(names)))
            score = second / np.maximum(least + second, 1e-9)
            some = (size > 0) & bool(names)
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array([names[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], pa.string()), pa.array(np.where(some, score, 0.0))], [id_column, "lang_pred", "score"])

    return docs.select(F.col(id_column), F.col(text).alias("text")).mapInArrow(predict, f"{id_column} {id_type}, lang_pred string, score double")


def language_id(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held_out: int = 2) -> DataFrame:
    """(id, held_out, lang_pred, score), learned from the rows outside the held-out fold."""
    fold = remainder(id_column, folds)
    profiles = learn_profiles(docs, fold != held_out, text, lang, id_column)
    return identify(docs, profiles, text, id_column).select(id_column, (remainder(id_column, folds) == held_out).alias("held_out"), "lang_pred", "score")
