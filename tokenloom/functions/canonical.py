"""Folding of neighbouring strings: `"a" "b"`, `"a" + "b"` and `"a" \\ "b"` become `"ab"`.

A token belongs to the run of the one before it if both are strings, or if it is `+` or a backslash between two
strings. A run whose joined text is longer than max_length bytes is one `overlong` token.
"""

from __future__ import annotations

import numpy as np

_STRING, _BYTE, _OVERLONG = 0, 2, 4


def folds(kind: np.ndarray) -> bool:
    """False if fold() leaves tokens of these kinds as they are."""
    string = kind == _STRING
    return bool((string[:-1] & string[1:]).any() or (string[:-2] & string[2:] & (kind[1:-1] == _BYTE)).any())


def fold(kind: np.ndarray, tok: list[bytes | None], level: np.ndarray, start: np.ndarray, end: np.ndarray, max_length: int) -> tuple[np.ndarray, list[bytes | None], np.ndarray, np.ndarray, np.ndarray]:
    """A file's tokens with each run of strings as one, from the start of its first to the end of its last."""
    string = kind == _STRING
    before, after = np.zeros_like(string), np.zeros_like(string)
    before[1:], after[:-1] = string[:-1], string[1:]
    sign = before & after & (kind == _BYTE)
    for i in np.flatnonzero(sign):
        sign[i] = tok[i] in (b"+", b"\\")
    after_sign = np.zeros_like(sign)
    after_sign[1:] = sign[:-1]
    inside = sign | (string & (before | after_sign))
    if not inside.any():
        return kind, tok, level, start, end
    first = np.flatnonzero(~inside)
    stop = np.append(first[1:], len(kind))
    kept_kind, kept_end = kind[first].copy(), end[stop - 1]
    kept = [tok[i] for i in first]
    for k in np.flatnonzero(stop - first > 1):
        text = b"".join(tok[i][1:-1] for i in range(first[k], stop[k]) if string[i])
        kept[k], kept_kind[k] = (None, _OVERLONG) if len(text) > max_length else (b'"%b"' % text, _STRING)
    return kept_kind, kept, level[first], start[first], kept_end
