"""Folders and files listed and read by tasks, so that the driver holds no listing."""

from __future__ import annotations

import fnmatch
import hashlib
import posixpath
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.session import scratch_dir

#: Bytes of a file that a task holds at once while it hashes it; entries of a listing that it hands on at once.
HASHED_BYTES, LISTED = 1 << 22, 10_000
#: Folders that one task lists or reads, about.
FOLDERS_PER_TASK = 2_000
_ENTRY = "path string, is_folder boolean, size bigint, modified timestamp"


def store_of(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in uri:
        return pyarrow.fs.FileSystem.from_uri(uri)
    return pyarrow.fs.LocalFileSystem(), uri.removeprefix("file:")


def _spread(folders: DataFrame, rows: int) -> DataFrame:
    cores = folders.sparkSession.sparkContext.defaultParallelism
    return folders.repartition(max(2, cores, min(-(-rows // FOLDERS_PER_TASK), 1 << 16)), "path")


def list_level(folders: DataFrame) -> DataFrame:
    """What lies right below the folders (``path``): path, is_folder, size, modified.

    Folders that are not there hold nothing, and names that begin with a dot or an underscore do not count.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = store_of(uri)
                found = _visible(store, path)
                for at in range(0, len(found), LISTED):
                    yield _entries(uri, path, found[at : at + LISTED])

    return folders.select("path").mapInArrow(apply, _ENTRY)


def _visible(store: pyarrow.fs.FileSystem, path: str) -> list[pyarrow.fs.FileInfo]:
    found = store.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
    return [f for f in found if f.base_name[:1] not in (".", "_")]


def _entries(uri: str, path: str, found: list[pyarrow.fs.FileInfo]) -> pa.RecordBatch:
    front = uri.rstrip("/")
    columns = [
        pa.array([front + f.path[len(path.rstrip("/")) :] for f in found], pa.string()),
        pa.array([f.type == pyarrow.fs.FileType.Directory for f in found], pa.bool_()),
        pa.array([f.size for f in found], pa.int64()),
        pa.array([f.mtime for f in found], pa.timestamp("us", "UTC")),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["path", "is_folder", "size", "modified"])


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``: path, size, modified; listed level by level.

    One task lists the root, tasks list the folders it names, and so on, as many rounds as the tree is deep. Each level is a
    written table; the driver counts its rows and knows none of them.
    """
    target = scratch_dir(spark, "listing")
    level, depth = spark.createDataFrame([(root,)], "path string"), 0
    while True:
        list_level(level).write.parquet(f"{target}/depth={depth}")
        below = spark.read.schema(_ENTRY).parquet(f"{target}/depth={depth}").filter("is_folder")
        count = below.count()
        if not count:
            break
        level, depth = _spread(below, count), depth + 1
    return spark.read.schema(_ENTRY).parquet(*[f"{target}/depth={d}" for d in range(depth + 1)]).filter("NOT is_folder").drop("is_folder")


def list_folders(spark: SparkSession, root: str) -> DataFrame:
    """The folders right below ``root`` (path), empty ones included; one task lists them, a written table holds them."""
    target = scratch_dir(spark, "folders")
    list_level(spark.createDataFrame([(root,)], "path string")).filter("is_folder").select("path").write.parquet(target)
    return spark.read.schema("path string").parquet(target)


def read_small(folders: DataFrame, file: str, count: int) -> DataFrame:
    """path, content: the files of this name in each folder as text. The name may hold a ``*`` behind its last slash."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                texts = [text for name in _matching(uri, file) if (text := _text(name)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(texts), pa.string()), pa.array(texts, pa.string())], names=["path", "content"])

    return _spread(folders, count).select("path").mapInArrow(apply, "path string, content string")


def partition_name(value: Column) -> Column:
    """A value as the name of a partition folder: characters that a path cannot hold as Spark writes them."""
    return reduce(lambda name, c: F.replace(name, F.lit(c), F.lit(f"%{ord(c):02X}")), "%\"#'*/:=?\\\x7f{[]^", value)


def write_small(documents: DataFrame) -> None:
    """Write each text (``content``) as the file at ``path``, with the folders it lies in.

    Tasks write the files where they belong, and the driver neither moves nor names one. A task that runs again writes the
    same files.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for batch in batches:
            for uri, content in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                store, path = store_of(uri)
                store.create_dir(posixpath.dirname(path), recursive=True)
                with store.open_output_stream(path) as out:
                    out.write(content.encode())
                written += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([written], pa.int64())})

    spread = _spread(documents, documents.count()).select("path", "content")
    spread.mapInArrow(apply, "files long").write.format("noop").mode("overwrite").save()


def _matching(folder: str, file: str) -> list[str]:
    front, _, name = f"{folder.rstrip('/')}/{file}".rpartition("/")
    if "*" not in name:
        return [f"{front}/{name}"]
    store, path = store_of(front)
    found = [f.base_name for f in _visible(store, path) if f.type == pyarrow.fs.FileType.File]
    return [f"{front}/{n}" for n in sorted(found) if fnmatch.fnmatchcase(n, name)]


def _text(uri: str) -> str | None:
    store, path = store_of(uri)
    try:
        with store.open_input_stream(path) as file:
            return file.read().decode("utf-8", "replace")
    except FileNotFoundError:
        return None


def digest_files(files: DataFrame, digest: Callable[[], hashlib._Hash] = hashlib.sha256, name: str = "sha256") -> DataFrame:
    """The rows with the hex digest of the file at ``path``, NULL if it is not there.

    A task reads a file in pieces of 4 MiB, so files of any size take no more memory than that.
    """
    kept = files.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digest(uri, digest()) for uri in batch.column(kept.index("path")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*kept, name])

    return files.mapInArrow(apply, files.withColumn(name, F.lit("")).schema)


def _digest(uri: str, state: hashlib._Hash) -> str | None:
    store, path = store_of(uri)
    try:
        with store.open_input_stream(path) as file:
            while piece := file.read(HASHED_BYTES):
                state.update(piece)
    except FileNotFoundError:
        return None
    return state.hexdigest()
