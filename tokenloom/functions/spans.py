"""Tokens of languages with C's comments and strings, side by side in numpy for all texts of a buffer.

Comments and strings are found by one expression; between them a token is a run of letters and digits or one byte, told
from the classes of neighbouring bytes. Texts are cut out of the buffer as one Arrow array. The tokens are those of tokenize.expression().
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

STRING, IDENTIFIER, BYTE, OVERLONG = 0, 1, 2, 4
#: What special() has found, as the number of its last group.
LINE, BLOCK, OPEN_BLOCK, CLOSED, OPEN = range(1, 6)

_ALL = np.arange(256)
_DIGIT = (_ALL >= 48) & (_ALL <= 57)
_LETTER = (_ALL >= 128) | (_ALL >= 65) & (_ALL <= 90) | (_ALL >= 97) & (_ALL <= 122)
_WORD = _DIGIT | _LETTER | (_ALL == 95)
_OTHER = ~_WORD & (_ALL > 32) & (_ALL != 127)
#: A number goes on over digits and `_`; what else is in a word begins an identifier.
_KIND = np.where(_WORD, IDENTIFIER, BYTE).astype(np.int8)


@lru_cache(maxsize=4)
def special(quotes: bytes) -> re.Pattern[bytes]:
    """The comments and strings of a text; what each is its (empty) last group tells. Every alternative begins with a literal, so that the rest is skipped fast."""
    each = [quotes[i : i + 1] for i in range(len(quotes))]
    closed = [rb"%b[^%b\\]*+(?:\\[\s\S][^%b\\]*+)*+%b()" % (q, q, q, q) for q in each]
    return re.compile(b"|".join([rb"//[^\n]*+()", rb"/\*[\s\S]*?\*/()", rb"/\*[\s\S]*+()", *closed, *(rb"%b[\s\S]*+()" % q for q in each)]))


def kind_of(found: re.Match[bytes], quotes: bytes) -> int:
    """LINE, BLOCK, OPEN_BLOCK, CLOSED or OPEN, for a match of special()."""
    k = found.lastindex
    return k if k < CLOSED else CLOSED if k < CLOSED + len(quotes) else OPEN


def bounds_in(buf: np.ndarray, free: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a token begins, and whether one ends, at each of the bytes that are free; one may begin in the midst of a word at begins."""
    word = _WORD[buf] & free
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    met = begins[(begins > 0) & (begins < len(buf))]
    met = met[word[met] & word[met - 1]]
    first[met], last[met - 1] = True, True
    run = np.flatnonzero(first)
    digits = _DIGIT[buf[run]]
    if digits.any():  # numbers end where a letter comes
        run, stop = run[digits], np.flatnonzero(last)[digits]
        letters = np.append(np.flatnonzero(_LETTER[buf] & word), len(buf))
        at = letters[np.searchsorted(letters, run)]
        at = at[at <= stop]
        first[at], last[at - 1] = True, True
    other = _OTHER[buf] & free
    return first | other, last | other


def tokens_in(data: bytes, spans: Sequence[tuple[int, int]], quotes: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind, start, end, count) of the tokens in spans of data that do not overlap, in order; each by its own quotes, in the midst of nothing at its beginning. count: tokens of each span."""
    buf = np.frombuffer(data, np.uint8)
    begins, stops = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
    found = [(*m.span(), kind_of(m, q)) for (a, b), q in zip(spans, quotes, strict=True) for m in special(q).finditer(data, a, b)]
    left, right, what = np.array(found, np.int64).reshape(-1, 3).T
    free = np.zeros(len(buf) + 1, np.int8)  # what is in a span and in nothing special
    np.add.at(free, np.concatenate([begins, right]), 1)
    np.add.at(free, np.concatenate([stops, left]), -1)
    first, last = bounds_in(buf, np.cumsum(free[:-1], dtype=np.int8).astype(bool), begins)
    closed = what == CLOSED
    first[left[closed]], last[right[closed] - 1] = True, True
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    kind = _KIND[buf[start]]
    kind[np.searchsorted(start, left[closed])] = STRING
    return kind, start, end, np.searchsorted(start, stops) - np.searchsorted(start, begins)


def texts(data: bytes, kind: np.ndarray, start: np.ndarray, end: np.ndarray, max_length: int) -> tuple[np.ndarray, pa.Array]:
    """(kind, text) of tokens in order: strings in plain double quotes; strings and identifiers of more than max_length bytes are `overlong` and have none."""
    buf, size = np.frombuffer(data, np.uint8), end - start
    long = (kind <= IDENTIFIER) & (size > max_length)
    string = kind == STRING
    if string.any():
        buf = buf.copy()
        buf[start[string]] = buf[end[string] - 1] = 34
    valid = None
    if long.any():
        kind, valid = np.where(long, OVERLONG, kind).astype(np.int8), pa.py_buffer(np.packbits(~long, bitorder="little"))
        start, end, size = start[~long], end[~long], np.where(long, 0, size)
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    values = buf[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return kind, pa.Array.from_buffers(pa.binary(), len(kind), [valid, pa.py_buffer(offsets), pa.py_buffer(values)])


__all__ = ["BLOCK", "CLOSED", "LINE", "OPEN", "OPEN_BLOCK", "bounds_in", "kind_of", "special", "texts", "tokens_in"]
