"""Helpers that the corpus operators share: checkpoint folder, Arrow batches in bounded slices, word and shingle hashes."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset and all is one process (tests), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tokenloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle and checkpoint files of tables that are no longer in use: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`: the fold of a labelled row."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text (one row at least), so that work arrays stay small."""
    for batch in batches:
        column = batch.column(text)
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        total = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_rng = np.random.default_rng(20240607)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ORDER = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, radix: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        steps = np.full(max(n, SLICE_BYTES + (1 << 18)), radix, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word of the rows that lie end to end in data."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(_SPACE[data], out=inside[:-1])
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-2]
    before &= ~first[:-1]
    starts = np.flatnonzero(inside[:-1] & ~before)
    ends = np.flatnonzero(inside[:-1] & ~(inside[1:] & ~first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", _RADIX, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power("down", _INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct `width`-word shingles of row i are hashes[bounds[i]:bounds[i + 1]], sorted.

    A row with fewer words has its whole word sequence as one shingle; a row without words has none.
    """
    data, offsets = utf8(column)
    starts, ends, row = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    count = np.bincount(row, minlength=len(column))
    begin = np.concatenate([[0], np.cumsum(count)])
    windows = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        windows += words[k : k + len(windows)] * _ORDER[k]
    at = np.flatnonzero(row[: len(windows)] == row[width - 1 :]) if len(windows) else np.zeros(0, np.int64)
    hashes, owner = [mix(windows[at])], [row[at]]
    for n in range(1, width):
        short = np.flatnonzero(count == n)
        if len(short):
            whole = np.full(len(short), n, np.uint64)
            for k in range(n):
                whole += words[begin[short] + k] * _ORDER[k]
            hashes.append(mix(whole))
            owner.append(short)
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[keep], owner[keep]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(column)))])
