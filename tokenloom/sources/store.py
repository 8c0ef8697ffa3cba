"""All regular files of a folder, whatever their names: listed folder by folder in tasks, dealt by bytes and read in tasks.

Spark's own file readers leave out names that begin with `_` or `.`, which source code is full of, and take brackets
in folder names as patterns; so folders are listed and files opened through Arrow's file systems instead. A
store that Arrow cannot open is listed through Hadoop and read by Spark's reader; where that reader would leave out
files, an error names one of them. Links, pipes and other entries that are no regular files are left out; so are files and
folders that cannot be read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.shared import cut

#: Bytes of files, and number of files, that one task reads.
TASK_BYTES, TASK_FILES = 64 << 20, 20_000
#: Bytes that a task reads before it sends them on.
BATCH_BYTES = 8 << 20
#: Bytes of the largest file; a value in a row cannot be longer.
LARGEST = (1 << 31) - 1024
# Hadoop's names of stores that Arrow can open, and Arrow's names of them.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}
LISTED = "path string, folder boolean, length long"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and store of the session's default file system, where it has none."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString().rstrip("/")


def parts_of(path: str) -> tuple[str, str, str]:
    """(scheme, store, path in it) of a qualified path."""
    scheme, _, rest = path.partition(":")
    if not rest.startswith("//"):
        return scheme, "", rest
    store, _, inside = rest[2:].partition("/")
    return scheme, store, f"/{inside}"


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system of a qualified path, and the path in it."""
    scheme, store, inside = parts_of(path)
    if scheme == "file":
        return pa.fs.LocalFileSystem(), inside
    fs, root = pa.fs.FileSystem.from_uri(f"{SCHEMES[scheme]}://{store}")
    return fs, f"{root.rstrip('/')}{inside}" if root.strip("/") else inside


def _entries(path: str) -> Iterator[tuple[str, bool, int]]:
    """(path, is a folder, length) of what lies in a folder, or of the file itself."""
    scheme, store, inside = parts_of(path)
    if scheme == "file":
        if not os.path.isdir(inside):
            if os.path.isfile(inside):
                yield path, False, os.path.getsize(inside)
            return
        with os.scandir(inside) as found:
            for e in found:
                child = f"{path}/{e.name}"
                if e.is_dir(follow_symlinks=False):
                    yield child, True, 0
                elif e.is_file(follow_symlinks=False):
                    yield child, False, e.stat(follow_symlinks=False).st_size
        return
    fs, inside = opened(path)
    if fs.get_file_info(inside).type == pa.fs.FileType.File:
        yield path, False, fs.get_file_info(inside).size
        return
    for e in fs.get_file_info(pa.fs.FileSelector(inside, allow_not_found=True)):
        if e.type in (pa.fs.FileType.File, pa.fs.FileType.Directory):
            yield f"{path}/{e.base_name}", e.type == pa.fs.FileType.Directory, e.size or 0


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            rows = []
            try:
                for row in _entries(folder):
                    rows.append(row)
            except OSError:  # of a folder that cannot be read, what was listed so far
                pass
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64()), strict=True)], ["path", "folder", "length"])


def _through_hadoop(spark: SparkSession, root: str) -> DataFrame:
    found = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = found.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(found, True)
    rows = []
    while files.hasNext():
        status = files.next()
        rows.append((status.getPath().toString(), False, status.getLen()))
        if hidden := next((n for n in rows[-1][0][len(root) :].split("/") if n.startswith(("_", "."))), None):
            raise ValueError(f"{rows[-1][0]}: {hidden} is a name that Spark's reader leaves out, and Arrow has no file system for {parts_of(root)[0]}")
    return spark.createDataFrame(rows, LISTED)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, length) of every regular file under path; `file` is relative to it, and empty if path is a file itself.

    A round of tasks lists all folders of one depth.
    """
    root = qualified(spark, path)
    exists = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not exists.getFileSystem(spark._jsc.hadoopConfiguration()).exists(exists):
        raise FileNotFoundError(path)
    file = F.when(F.startswith("path", F.lit(root + "/")), F.substring("path", len(root) + 2, 1 << 30)).otherwise("")
    if parts_of(root)[0] not in SCHEMES:
        return _through_hadoop(spark, root).select("path", file.alias("file"), "length")
    cores = spark.sparkContext.defaultParallelism
    folders, found, n = spark.createDataFrame([(root,)], "path string"), None, 1
    while n:
        here = cut(folders.repartition(max(1, min(n, 8 * cores))).mapInArrow(_listed, LISTED))
        files = here.where("not folder")
        found = files if found is None else found.unionByName(files)
        folders = here.where("folder").select("path")
        n = folders.count()
    return found.select("path", file.alias("file"), "length")


def read_content(files: DataFrame) -> DataFrame:
    """files(path, length, ...) with `content` in place of path and length; those that cannot be read are left out."""
    spark = files.sparkSession
    kept = [c for c in files.columns if c not in ("path", "length")]
    size = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.max("length").alias("most"), F.min("path").alias("any")).first()
    if not size.n:
        return files.select(*kept, F.lit(None).cast("binary").alias("content"))
    if size.most > LARGEST:
        raise ValueError(f"a file of {size.most} bytes is too large for a row")
    if parts_of(size.any)[0] not in SCHEMES:
        contents = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load([r.path for r in files.select("path").toLocalIterator()])
        return files.join(contents.select("path", "content"), "path").select(*kept, "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, contents, total = [], [], 0

            def out(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                rows = batch.take(pa.array(at, pa.int64()))
                return pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(contents, pa.binary())], [*kept, "content"])

            for i, path in enumerate(batch.column("path").to_pylist()):
                try:
                    fs, inside = opened(path)
                    with fs.open_input_file(inside) as f:
                        contents.append(f.read())
                except OSError:
                    continue
                at.append(i)
                total += len(contents[-1])
                if total > BATCH_BYTES:
                    yield out()
                    at, contents, total = [], [], 0
            if at:
                yield out()

    tasks = max(-(-size.bytes // TASK_BYTES), -(-size.n // TASK_FILES), min(size.n, spark.sparkContext.defaultParallelism))
    types = dict(files.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "content binary"])
    return files.repartition(int(tasks), "path").mapInArrow(read, schema)


def write_files(files: DataFrame, path: str, name: str = "file", content: str = "content") -> int:
    """Write a file for each row of files(file, content) under path; returns how many. A repeated task writes the same files again."""
    root = qualified(files.sparkSession, path)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                fs, inside = opened(f"{root}/{file}")
                fs.create_dir(inside.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(inside) as f:
                    f.write(data)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    value: Column = F.col(content) if dict(files.dtypes)[content] == "binary" else F.encode(content, "UTF-8")
    done = files.where(F.col(content).isNotNull()).select(F.col(name).alias("file"), value.alias("content")).mapInArrow(written, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
