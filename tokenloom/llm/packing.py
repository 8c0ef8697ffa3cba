"""Packing documents into windows of a fixed length: sum-of-squares placement over an array of fill levels.

Each task packs the documents that it reads, so nothing is shuffled. A document's ids are those of the tokenizer and an
end id. Longer documents give whole windows from their start first; what is left is placed whole: into an open window of
that level h for which the sum of the squared numbers of open windows at each level grows least (a new window is level
0). `Levels` keeps these numbers in one array and the windows of each level in a list. Windows that become full are
closed. When more than `most_open` windows are open, and at the end of the task, the documents of the emptiest windows
are cut into the gaps of the fullest ones, and the last window is cut at powers of two, so that no sequence is padded.

The library encodes each distinct piece of text once and its ids are remembered: no part of this tokenizer (its
normalisation, its splitting, its special strings) looks across ASCII white space.

Memory: open windows (most_open * length ids at most), the remembered pieces (MEMO) and the document at hand.

Defined cases: null and empty texts are the end id alone; very long texts are encoded whole; repeated rows and rows with
the same or a null id are packed as often as they occur; an empty table gives no sequence; other columns of the input,
also with the names of the result, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import slices

LENGTH = 4096
#: Windows that a task keeps open.
OPEN = 512
#: Id after each document.
END = 2
#: Pieces whose ids a task remembers, and the characters up to which it does.
MEMO, MEMO_LENGTH = 400_000, 48
#: Rows of the result that a task sends on at a time.
ROWS = 20_000
#: Pieces that are encoded in one text.
TOGETHER = 2000
#: How the vocabulary marks the end of a piece, and the expression by which the tokenizer splits lower-cased text, for Latin-1.
WORD_END = "</w>"
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-zß-öø-ÿ0-9]+")
_WORD = re.compile(r"[^ \t-\r]+")
_PLAIN = re.compile(r"[\x00-\x7fÀ-ÿ]*").fullmatch
_NUMBER_BITS = 40


class Words:
    """A tokenizer's ids of texts, from the remembered ids of their pieces.

    In words of ASCII and U+00C0 to U+00FF, which the normalisation only lower-cases, a piece is what the tokenizer's own
    expression splits off; other words, and those with a special string, are pieces as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        names = self.library.get_vocab(with_added_tokens=False)
        self.last = np.zeros(self.library.get_vocab_size(), bool)
        self.last[[i for name, i in names.items() if name.endswith(WORD_END)]] = True
        self.known: dict[str, bytes] = {}

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, pieces: list[str]) -> list[bytes]:
        """The ids of split pieces: encoded in one text, whose ids tell where each piece ends."""
        if not pieces:
            return []
        ids = np.asarray(self.library.encode(" ".join(pieces), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces):
            return self._alone(pieces)
        data, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        """The ids (little-endian uint32) of each text, then `end`."""
        split, whole, cut = set(), set(), []
        for t in texts:
            if not t:
                cut.append([])
            elif _PLAIN(t) and "<|" not in t:
                cut.append(_PIECE.findall(t.lower()))
                split.update(cut[-1])
            else:
                cut.append(pieces := [])
                for w in _WORD.findall(t):
                    if _PLAIN(w) and "<|" not in w:
                        pieces += (found := _PIECE.findall(w.lower()))
                        split.update(found)
                    else:
                        pieces.append(w)
                        whole.add(w)
        known = self.known
        new = list(split - known.keys())
        for k in range(0, len(new), TOGETHER):
            known.update(zip(new[k : k + TOGETHER], self._together(new[k : k + TOGETHER]), strict=True))
        alone = list(whole - known.keys())
        known.update(zip(alone, self._alone(alone), strict=True))
        last = np.asarray([end], "<u4").tobytes()
        out = [np.frombuffer(b"".join(map(known.__getitem__, pieces)) + last, "<u4") for pieces in cut]
        if len(known) > MEMO:
            known.clear()
        else:
            for w in (*new, *alone):
                if len(w) > MEMO_LENGTH:
                    del known[w]
        return out


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


class Piece:
    """Ids of a document from `start` on."""

    __slots__ = ("doc_id", "ids", "start", "total")

    def __init__(self, doc_id, start: int, ids: np.ndarray, total: int):
        self.doc_id, self.start, self.ids, self.total = doc_id, start, ids, total

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.total), Piece(self.doc_id, self.start + n, self.ids[n:], self.total)


Window = list[Piece]


class Levels:
    """Open windows by fill level."""

    def __init__(self, length: int, most_open: int = OPEN):
        self.length, self.most_open = length, most_open
        self.counts = np.zeros(length + 1, np.int64)
        self.windows: dict[int, list[Window]] = {}
        self.open = 0

    def choose(self, size: int) -> int:
        """The level (0: a new window) at which `size` more ids cost least; of equal ones the fullest."""
        counts = self.counts
        levels = np.flatnonzero(counts[: self.length - size + 1])
        if not len(levels):
            return 0
        after = levels + size
        cost = np.where(after == self.length, 1 - 2 * counts[levels], 2 * (counts[after] - counts[levels]) + 2)
        best = len(cost) - 1 - int(np.argmin(cost[::-1]))
        return int(levels[best]) if cost[best] <= 2 * counts[size] + 1 else 0

    def put(self, level: int, window: Window) -> None:
        self.counts[level] += 1
        self.windows.setdefault(level, []).append(window)
        self.open += 1

    def take(self, level: int) -> Window:
        self.counts[level] -= 1
        self.open -= 1
        return self.windows[level].pop()

    def place(self, piece: Piece) -> list[Window]:
        """Put a piece shorter than a window into the best level; returns the windows that became full."""
        level = self.choose(len(piece.ids))
        window = self.take(level) if level else []
        window.append(piece)
        level += len(piece.ids)
        if level == self.length:
            return [window]
        self.put(level, window)
        return self.settle(self.most_open // 2) if self.open > self.most_open else []

    def settle(self, keep: int) -> list[Window]:
        """Close windows until `keep` are open: the emptiest ones' pieces are cut into the gaps of the fullest ones."""
        levels = [h for h, found in sorted(self.windows.items()) for _ in found]
        rest = [w for _, found in sorted(self.windows.items()) for w in found]
        closed = []
        low, high = 0, len(rest) - 1
        while low < high and high - low + 1 > keep:
            gap = self.length - levels[high]
            piece = rest[low].pop()
            if len(piece.ids) > gap:
                piece, left = piece.split(gap)
                rest[low].append(left)
            rest[high].append(piece)
            levels[high] += len(piece.ids)
            levels[low] -= len(piece.ids)
            if not levels[low]:
                low += 1
            if levels[high] == self.length:
                closed.append(rest[high])
                high -= 1
        self.counts[:] = 0
        self.windows, self.open = {}, 0
        for level, window in zip(levels[low : high + 1], rest[low : high + 1], strict=True):
            self.put(level, window)
        return closed

    def finish(self) -> list[Window]:
        """Close all windows; the last one is cut at powers of two."""
        closed = self.settle(1)
        for level in [h for h, found in self.windows.items() if found]:
            rest = self.take(level)[::-1]
            while level:
                size = 1 << (level.bit_length() - 1)
                level -= size
                window: Window = []
                while size:
                    piece = rest.pop()
                    if len(piece.ids) > size:
                        piece, left = piece.split(size)
                        rest.append(left)
                    window.append(piece)
                    size -= len(piece.ids)
                closed.append(window)
        return closed


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, most_open: int = OPEN, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: (id, start, ids, doc_tokens, sequence_id, offset); ids are little-endian uint32.

    sequence_id: the task and the number of the sequence in it; offset: where the piece begins in its sequence.
    """
    id_type = dict(docs.dtypes)[id_column]
    names = [id_column, "start", "ids", "doc_tokens", "sequence_id", "offset"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, levels = words_of(path), Levels(length, most_open)
        number = TaskContext.get().partitionId() << _NUMBER_BITS
        rows: list[tuple] = []
        kind = None

        def close(windows: list[Window]) -> None:
            nonlocal number
            for window in windows:
                at = 0
                for p in window:
                    rows.append((p.doc_id, p.start, p.ids.tobytes(), p.total, number, at))
                    at += len(p.ids)
                number += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            types = (kind, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in slices(batches, "text"):
            kind = batch.schema.field(0).type
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column("text").to_pylist(), end), strict=True):
                whole = len(ids) // length * length
                close([[Piece(doc_id, at, ids[at : at + length], len(ids))] for at in range(0, whole, length)])
                if whole < len(ids):
                    close(levels.place(Piece(doc_id, whole, ids[whole:].copy(), len(ids))))
                if len(rows) >= ROWS:
                    yield out()
        close(levels.finish())
        if rows:
            yield out()

    return docs.select(F.col(id_column), F.col(text).alias("text")).mapInArrow(packed, f"{id_column} {id_type}, start long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(sequence_id, n_tokens, ids, pieces) of each sequence, from pack(); a group holds one window's pieces."""
    part = F.struct("offset", F.col(id_column), "start", (F.octet_length("ids") / 4).cast("int").alias("length"), "ids")
    grouped = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part), lambda a, b: (a["offset"] - b["offset"]).cast("int")).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return grouped.select("sequence_id", F.aggregate("p", F.lit(0), lambda a, x: a + x["length"]).alias("n_tokens"), ids.alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("pieces"))
