"""Scans of files that arrive in chunks, in any order and over any number of micro-batches.

A file is scanned, as a batch would, in the micro-batch that completes it: all of its chunks from 0 to the one marked
`last` have come, early or late, once or several times; a token may lie across chunks. The chunks of unfinished files are
keyed state (one map a file, in RocksDB), so a micro-batch costs what its own chunks cost, however many files have
been finished before. Of a finished file a mark is left, so that chunks that come again are left out; `remember` lets marks
go after a time. `patience` gives up files whose last chunk does not come: they are scanned as far as they have come without a gap.

Each exchange between a Python worker and the state takes its time, and so does each key. With `groups`, files are dealt by hash to so many keys, and a
group's chunks of a micro-batch are kept together: some exchanges a group, and two a file for its mark. That is for many small files; the state of a group
is some bytes a chunk that is waited for, and what came together with chunks of a file that is finished now is read again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tokenloom.api import find, prefiltered
from tokenloom.functions.shared import cut
from tokenloom.plans.pattern import Pattern

WHOLE = "file string, lang string, content binary"
#: Bytes of contents that a group of files hands on at once.
HAND_ON = 8 << 20
#: Read when a query starts. Without the second, each partition's store takes 4 MB of disk before it holds anything, again after each restart.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


class Assembly(StatefulProcessor):
    """The chunks of one (file, lang): kept until all are there, then given as one content.

    patience, remember: milliseconds, or None for ever.
    """

    def __init__(self, patience: int | None, remember: int | None):
        self.patience, self.remember = patience, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "seq long", "content binary")
        self.wanted = handle.getValueState("wanted", "n long")
        self.count = handle.getValueState("count", "n long")
        self.done = handle.getValueState("done", "yes boolean", self.remember)

    def _joined(self, n: int) -> bytes:
        return b"".join(bytes(self.chunks.getValue((k,))[0]) for k in range(n))

    def _end(self, key, content: bytes) -> pd.DataFrame:
        for state in (self.chunks, self.wanted, self.count):
            state.clear()
        self.done.update((True,))
        return pd.DataFrame({"file": [key[0]], "lang": [key[1]], "content": [content]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.done.exists():
            return
        count = self.count.get()[0] if self.count.exists() else 0
        wanted = self.wanted.get()[0] if self.wanted.exists() else None
        before = count
        for batch in rows:
            for seq, content, last in zip(batch["seq"], batch["content"], batch["last"], strict=True):
                if last and wanted is None:
                    wanted = int(seq) + 1
                    self.wanted.update((wanted,))
                    for k in [k for (k,) in self.chunks.keys() if k >= wanted]:  # strays beyond the end
                        self.chunks.removeKey((k,))
                        count -= 1
                if seq >= 0 and (wanted is None or seq < wanted) and not self.chunks.containsKey((int(seq),)):
                    self.chunks.updateValue((int(seq),), (bytes(content),))
                    count += 1
        if count == wanted:
            yield self._end(key, self._joined(wanted))
            return
        self.count.update((count,))
        if self.patience is not None and not before and count:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.done.exists():
            return
        n = 0
        while self.chunks.containsKey((n,)):
            n += 1
        yield self._end(key, self._joined(n))

    def close(self) -> None:
        pass


@dataclass
class Waiting:
    """A file whose chunks have not all come. seqs: the chunks that have, and the entry that holds each; entries: all that hold, or held, some."""

    wanted: int | None
    since: int
    seqs: dict[int, int] = field(default_factory=dict)
    entries: set[int] = field(default_factory=set)


class Assemblies(StatefulProcessor):
    """Assembly for a group of files at once. What a micro-batch brings of files that it does not finish is one entry of the group's state."""

    def __init__(self, patience: int | None, remember: int | None):
        self.patience, self.remember = patience, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "files string")
        self.chunks = handle.getMapState("chunks", "entry long", "rows binary")
        self.done = handle.getMapState("done", "file string, lang string", "yes boolean", self.remember)

    def _load(self) -> tuple[int, dict[tuple[str, str], Waiting]]:
        """The number of the next entry, and the files that wait."""
        entry, files = json.loads(self.waiting.get()[0]) if self.waiting.exists() else (0, [])
        return entry, {(file, lang): Waiting(wanted, since, dict(seqs), set(entries)) for file, lang, wanted, since, seqs, entries in files}

    def _save(self, entry: int, files: dict[tuple[str, str], Waiting]) -> None:
        if files:
            self.waiting.update((json.dumps([entry, [[*f, w.wanted, w.since, [*w.seqs.items()], [*w.entries]] for f, w in files.items()]]),))
        else:
            self.waiting.clear()

    def _put(self, entry: int, rows: list[tuple[str, str, int, bytes]]) -> None:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.large_string(), pa.large_string(), pa.int64(), pa.large_binary()), strict=True)], ["file", "lang", "seq", "content"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        self.chunks.updateValue((entry,), (sink.getvalue().to_pybytes(),))

    def _rows(self, entry: int) -> Iterator[tuple[str, str, int, bytes]]:
        table = pa.ipc.open_stream(bytes(self.chunks.getValue((entry,))[0])).read_all()
        return zip(*(table.column(c).to_pylist() for c in ("file", "lang", "seq", "content")), strict=True)

    def _end(self, ends: dict[tuple[str, str], int], files: dict[tuple[str, str], Waiting], fresh: dict[tuple[str, str], dict[int, bytes]]) -> Iterator[pd.DataFrame]:
        """The first `ends` chunks of some files, which wait no longer, from the state and from what is fresh."""
        parts = {f: fresh.pop(f, {}) for f in ends}
        ended = {f: files.pop(f) for f in ends}
        for entry in sorted({e for w in ended.values() for e in w.entries}):
            kept = []
            for file, lang, seq, content in self._rows(entry):
                f = file, lang
                if f in ended:
                    if ended[f].seqs.get(seq) == entry:
                        parts[f][seq] = content
                elif f in files and files[f].seqs.get(seq) == entry:
                    kept.append((file, lang, seq, content))
            if kept:
                self._put(entry, kept)
            else:
                self.chunks.removeKey((entry,))
                for w in files.values():
                    w.entries.discard(entry)
        out, size = [], 0
        for f, n in ends.items():
            self.done.updateValue(f, (True,))
            content = b"".join(parts[f][k] for k in range(n))
            del parts[f]
            out.append((*f, content))
            size += len(content)
            if size >= HAND_ON:
                yield pd.DataFrame(out, columns=["file", "lang", "content"])
                out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=["file", "lang", "content"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        entry, files = self._load()
        known = set(files)
        fresh: dict[tuple[str, str], dict[int, bytes]] = {}
        finished: dict[tuple[str, str], bool] = {}
        for batch in rows:
            for file, lang, seq, content, last in zip(batch["file"], batch["lang"], batch["seq"].tolist(), batch["content"], batch["last"], strict=True):
                f = file, lang
                if f not in files:
                    if f not in finished:
                        finished[f] = self.done.containsKey(f)
                    if finished[f]:
                        continue
                    files[f] = Waiting(None, now)
                w, new = files[f], fresh.setdefault(f, {})
                if last and w.wanted is None:
                    w.wanted = seq + 1
                    for held in (w.seqs, new):
                        for k in [k for k in held if k >= w.wanted]:  # strays beyond the end
                            del held[k]
                if seq >= 0 and (w.wanted is None or seq < w.wanted) and seq not in w.seqs:
                    new.setdefault(seq, bytes(content))
        yield from self._end({f: w.wanted for f in fresh if len((w := files[f]).seqs) + len(fresh[f]) == w.wanted}, files, fresh)
        if left := [(*f, seq, content) for f, new in fresh.items() for seq, content in new.items()]:
            self._put(entry, left)
            for file, lang, seq, _ in left:
                files[file, lang].seqs[seq] = entry
                files[file, lang].entries.add(entry)
            entry += 1
        files = {f: w for f, w in files.items() if w.seqs or w.wanted is not None}
        if self.patience is not None and not files.keys() <= known:
            self.handle.registerTimer(now + self.patience)
        self._save(entry, files)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        entry, files = self._load()
        due = {f: next(n for n in range(len(w.seqs) + 1) if n not in w.seqs) for f, w in files.items() if w.since + self.patience <= now}
        if due:
            yield from self._end(due, files, {})
            self._save(entry, files)

    def close(self) -> None:
        pass


def assembled(chunks: DataFrame, patience: int | None = None, remember: int | None = None, groups: int | None = None) -> DataFrame:
    """A stream of files(file, lang, content) from a stream of chunks(file, lang, seq, content, last).

    groups: keys of state to which files are dealt, the same as long as a stream goes on; None: each file is a key.
    """
    content = F.col("content") if dict(chunks.dtypes)["content"] == "binary" else F.encode("content", "UTF-8")
    rows = chunks.where("file is not null and lang is not null").select("file", "lang", F.col("seq").cast("long").alias("seq"), content.alias("content"), F.coalesce("last", F.lit(False)).alias("last"))
    rows = rows.where("seq is not null and content is not null")
    timed = patience is not None or remember is not None
    keyed = rows.groupBy("file", "lang") if groups is None else rows.withColumn("part", F.pmod(F.xxhash64("file", "lang"), F.lit(groups)).cast("int")).groupBy("part")
    return keyed.transformWithStateInPandas((Assembly if groups is None else Assemblies)(patience, remember), WHOLE, "Append", "ProcessingTime" if timed else "None")


def scan_stream(chunks: DataFrame, patterns: list[Pattern], out: str, staging: str, patience: int | None = None, remember: int | None = None, groups: int | None = None, **trigger) -> StreamingQuery:
    """Start a query that writes the findings of chunks(file, lang, seq, content, last) to `out`, a folder of Parquet files for each batch.

    staging: a folder for the query's progress and state. A repeated micro-batch replaces its own folder.
    """
    spark = chunks.sparkSession
    trigger = trigger or {"availableNow": True}

    def batch(files: DataFrame, number: int) -> None:  # stored first: each further reading would go through the state again
        find(cut(prefiltered(files, patterns)), patterns).write.mode("overwrite").parquet(f"{out}/batch={number}")

    old = {name: spark.conf.get(name, None) for name in _STATE}
    for name, value in _STATE.items():
        spark.conf.set(name, value)
    try:
        return assembled(chunks, patience, remember, groups).writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", f"{staging}/progress").trigger(**trigger).start()
    finally:
        for name, value in old.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def read_findings(spark, out: str) -> DataFrame:
    """What a stream has found so far."""
    return spark.read.parquet(out).drop("batch")
