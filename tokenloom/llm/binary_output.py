"""Token ids as fixed-stride binary shards in training order.

Each task joins its documents, an end token after each, into sequences of LENGTH ids; the last one of a task is padded
with end tokens. The sequences are stored once, compressed, so that their number and every sequence's place among
them are fixed. A keyed Feistel permutation of the places, walked along its cycle until it falls below the number of
sequences, gives each sequence its global slot. Partitions by ranges of slots, SHARD_ROWS each, write the shards: slot s
lies in shard s // SHARD_ROWS at byte (s % SHARD_ROWS) * width * LENGTH, as little-endian unsigned numbers of `width` bytes: two, or
four where a vocabulary has ids beyond 65,535. The end token is the first id that the vocabulary leaves free. A reader goes on from any slot by seeking.
Shards are written under a temporary name and renamed, so a repeated task leaves one whole file.

Defined cases: null and empty texts give an end token only; an empty table gives no sequence and no shard; repeated rows
are written as often as they occur; very long texts go over as many sequences as they need; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import cut, mix, shared_dir

LENGTH = 8192
SHARD_ROWS = 512
KEY = 20240607
#: Tasks up to which the number of sequences of each is broadcast; beyond it the join shuffles.
BROADCAST_PARTS = 100_000
ROUNDS = 6


def feistel(places: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0..n-1 at the given places, or its inverse."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask, half_ = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % (1 << 64)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half_, x & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mix(left + k) & mask), left
            else:
                left, right = right, left ^ (mix(right + k) & mask)
        return left << half_ | right

    out = once(places.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


@lru_cache(maxsize=2)
def encoding(path: str):
    """The byte-level BPE of a file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def layout(path: str) -> tuple[int, str]:
    """(end token, type of ids) for a file of ranks."""
    with open(path, "rb") as f:
        end = 1 + max(int(line.split()[1]) for line in f if line.strip())
    return end, "<u2" if end < 1 << 16 else "<u4"


PACKED = "part int, number long, n_tokens int, doc_ids array<long>, starts array<int>, tokens binary"


def pack(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The sequences of each task's documents, numbered in the task; tokens are zstd-compressed ids."""

    end, kind = layout(path)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, codec = encoding(path), pa.Codec("zstd", compression_level=6)
        part, number, fill = TaskContext.get().partitionId(), 0, 0
        tokens, owners = [], []  # of the sequence that is being filled; (id, start)
        rows: list[tuple] = []

        def close() -> None:
            nonlocal number, fill
            data = np.concatenate(tokens)
            full = np.full(length, end, kind)
            full[: len(data)] = data
            rows.append((number, len(data), [a for a, _ in owners], [b for _, b in owners], codec.compress(full.tobytes(), asbytes=True)))
            number, fill = number + 1, 0
            tokens.clear()
            owners.clear()

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array([part] * len(rows), pa.int32()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()), strict=True))]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, ["part", "number", "n_tokens", "doc_ids", "starts", "tokens"])

        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(model.encode_to_numpy(t.as_py() or "", disallowed_special=()), end).astype(kind)
                at = 0
                while at < len(ids):
                    piece = ids[at : at + length - fill]
                    owners.append((i, fill))
                    tokens.append(piece)
                    fill += len(piece)
                    at += len(piece)
                    if fill == length:
                        close()
                if len(rows) >= 256:
                    yield out()
        if fill:
            close()
        if rows:
            yield out()

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(packed, PACKED)


# Hadoop's names of stores that Arrow has another name for.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfss", "abfs": "abfs", "gs": "gs", "hdfs": "hdfs", "file": "file", "s3": "s3", "viewfs": "viewfs"}


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the session's default file system, if it has none."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system for a qualified path, and the path in it."""
    scheme, _, rest = path.partition(":/")
    if not rest or "/" in scheme:
        raise ValueError(f"{path} has no scheme; use qualified()")
    if scheme not in _SCHEMES:
        raise ValueError(f"no file system for {path}")
    return pa.fs.FileSystem.from_uri(f"{_SCHEMES[scheme]}:/{rest if rest.startswith('/') else '//' + rest}")


def shard_name(k: int) -> str:
    return f"shard-{k:08d}.bin"


MANIFEST = "slot long, shard int, byte_offset long, n_tokens int, sha256 string, doc_ids array<long>, starts array<int>"


def materialise(docs: DataFrame, path: str, out: str, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, shard_rows: int = SHARD_ROWS, key: int = KEY) -> DataFrame:
    """Write the shards to the folder `out`, once; returns one row for each sequence."""
    spark = docs.sparkSession
    width = np.dtype(layout(path)[1]).itemsize
    out = qualified(spark, out)
    file_system(out)  # an unknown store is an error before any work
    stage = f"{shared_dir(spark).rstrip('/')}/sequences-{uuid.uuid4().hex}"
    pack(docs, path, id_column, text, length).write.option("compression", "none").parquet(stage)
    sequences = spark.read.schema(PACKED).parquet(stage)
    sizes = sequences.groupBy("part").agg(F.count("*").alias("n")).withColumn("first", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    sizes = cut(sizes.select("part", "n", F.coalesce("first", F.lit(0)).alias("first")))
    parts = sizes.agg(F.count("*").alias("parts"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    total = parts.total
    places = sequences.join(F.broadcast(sizes.drop("n")) if parts.parts <= BROADCAST_PARTS else sizes.drop("n"), "part").withColumn("place", F.col("first") + F.col("number"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = feistel(batch.column("place").to_numpy(), total, key)
            kept = [batch.column(c) for c in ("n_tokens", "doc_ids", "starts", "tokens")]
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array((slot // shard_rows).astype(np.int32)), *kept], ["slot", "shard", "n_tokens", "doc_ids", "starts", "tokens"])

    dealt = places.select("place", "n_tokens", "doc_ids", "starts", "tokens").mapInArrow(slots, "slot long, shard int, n_tokens int, doc_ids array<long>, starts array<int>, tokens binary")
    dealt = dealt.repartitionById(max(1, -(-total // shard_rows)), F.col("shard")).sortWithinPartitions("slot")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(out)
        codec = pa.Codec("zstd")
        fs.create_dir(folder, recursive=True)
        file = shard = temporary = None

        def close() -> None:
            if file is not None:
                file.close()
                fs.move(temporary, f"{folder}/{shard_name(shard)}")

        done = False
        try:
            for batch in batches:
                digests = []
                for k, tokens in zip(batch.column("shard").to_pylist(), batch.column("tokens"), strict=True):
                    if k != shard:
                        close()
                        shard, temporary = k, f"{folder}/_writing-{k}-{uuid.uuid4().hex}"
                        file = fs.open_output_stream(temporary)
                    data = codec.decompress(tokens.as_py(), decompressed_size=width * length, asbytes=True)
                    file.write(data)
                    digests.append(hashlib.sha256(data).hexdigest())
                slot = batch.column("slot").to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column("slot"), batch.column("shard"), pa.array(slot % shard_rows * width * length), batch.column("n_tokens"), pa.array(digests, pa.string()), batch.column("doc_ids"), batch.column("starts")], ["slot", "shard", "byte_offset", "n_tokens", "sha256", "doc_ids", "starts"])
            close()
            done = True
        finally:
            if file is not None and not done:  # a task that was stopped leaves no half shard; one whose executor was lost leaves a name that readers skip
                file.close()
                fs.delete_file(temporary)

    return cut(dealt.mapInArrow(write, MANIFEST))  # stored, so that reading the rows again does not write again


def token_shards(docs: DataFrame, path: str, out: str | None = None, **options) -> DataFrame:
    """materialise() into `out`, by default a new folder in the shared one."""
    return materialise(docs, path, out or f"{shared_dir(docs.sparkSession).rstrip('/')}/shards-{uuid.uuid4().hex}", **options)


def read_sequences(out: str, first: int, count: int, length: int = LENGTH, shard_rows: int = SHARD_ROWS, kind: str = "<u2") -> Iterator[np.ndarray]:
    """The sequences of slots first, first + 1, ...: what a trainer reads when it goes on from slot `first`. kind: as layout() gives it."""
    width = np.dtype(kind).itemsize
    fs, folder = file_system(out if ":/" in out else f"file://{out}")
    slot = first
    while slot < first + count:
        k = slot // shard_rows
        name = f"{folder}/{shard_name(k)}"
        if fs.get_file_info(name).type == pa.fs.FileType.NotFound:
            return
        with fs.open_input_file(name) as f:
            f.seek(slot % shard_rows * width * length)
            while slot < first + count and slot // shard_rows == k:
                if not (data := f.read(width * length)):
                    return
                yield np.frombuffer(data, kind)
                slot += 1


def read_shards(spark: SparkSession, out: str, length: int = LENGTH, shard_rows: int = SHARD_ROWS, kind: str = "<u2") -> DataFrame:
    """(slot, tokens) of all shards."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(out)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                tokens = np.frombuffer(content.as_py(), kind).reshape(-1, length)
                first = int(path.rpartition("-")[2].removesuffix(".bin")) * shard_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(tokens))), pa.array(list(tokens.astype(np.int64)), pa.list_(pa.int64()))], ["slot", "tokens"])

    return files.select("path", "content").mapInArrow(records, "slot long, tokens array<long>")
