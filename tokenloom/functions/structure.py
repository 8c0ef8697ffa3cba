"""Bracket depths of a file's tokens as running sums, and for each place the next one at which a depth falls."""

from __future__ import annotations

import numpy as np

#: Depths and the bytes that open and close them; `scope` also follows the levels of Python.
DEPTHS = {"round": b"()", "square": b"[]", "curly": b"{}", "corner": b"<>", "scope": b"{}"}
#: What bounds an ellipsis: a depth that falls, or (`statement`) that or the end of a statement in the same scope.
BOUNDS = (*DEPTHS, "statement")
_BYTE, _LEVEL = 2, 3


def depths(kind: np.ndarray, first: np.ndarray, level: np.ndarray, name: str) -> np.ndarray:
    """The depth before each of a file's tokens, whose first bytes are `first`, and after the last one."""
    up, down = DEPTHS[name]
    step = np.where(kind == _BYTE, (first == up).astype(np.int32) - (first == down), 0)
    return np.concatenate([[0], np.cumsum(step + level if name == "scope" else step)]).astype(np.int64)


def _first(depth: np.ndarray, levels: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each place p the first of the events (level, place) at p or later whose level is depth[p]; -1 if there is none."""
    low, width = min(int(depth.min()), int(levels.min()) if len(levels) else 0), len(depth) + 1
    keys = np.sort((levels - low) * width + places)
    wanted = (depth - low) * width + np.arange(len(depth))
    at = np.searchsorted(keys, wanted)
    found = np.append(keys, np.iinfo(np.int64).max)[at]
    return np.where(found // width == depth - low, found % width, -1)


def _falls(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Events (level, token): the token at which the depth falls below the level."""
    by = depth[:-1] - depth[1:]
    at = np.flatnonzero(by > 0)
    many = by[at]
    places = np.repeat(at, many)
    return np.repeat(depth[1:][at], many) + 1 + np.arange(len(places)) - np.repeat(np.cumsum(many) - many, many), places


def next_falls(depth: np.ndarray) -> np.ndarray:
    """For each place the first token there or later at which the depth falls below that before the place; -1: never."""
    return _first(depth, *_falls(depth))


def next_ends(depth: np.ndarray, kind: np.ndarray, first: np.ndarray | list[bytes | None], level: np.ndarray) -> np.ndarray:
    """As next_falls(), or the first token that ends a statement at that depth: a semicolon, or a line that is not indented otherwise."""
    first = first if isinstance(first, np.ndarray) else np.array([t[0] if t else 0 for t in first], np.uint8)
    ends = np.flatnonzero((kind == _LEVEL) & (level == 0))
    ends = np.concatenate([ends, np.flatnonzero((kind == _BYTE) & (first == ord(";")))])
    levels, places = _falls(depth)
    return _first(depth, np.concatenate([levels, depth[ends + 1]]), np.concatenate([places, ends]))


def left_to_fall(depth: np.ndarray) -> np.ndarray:
    """For each place how many levels the depth still falls below that before the place."""
    return depth - np.minimum.accumulate(depth[::-1])[::-1]
