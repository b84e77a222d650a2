"""A request queue in a folder, as a streaming source: partitions of numbered records, offsets, and a commit.

A partition is a folder of segments, files that are written once and named by the first offset in them and the first
one after them. So the end of a partition is known from names, and a range of offsets is a few files. Producers append
segments, a reader remembers nothing but offsets, and what all consumer groups have committed may be trimmed.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from runloom.sources.files import store_of

FORMAT = "folder_queue"
SCHEMA = "key string, value string, partition int, offset bigint, timestamp timestamp"
#: Records that a task reads at once.
READ_RECORDS = 1_000
#: About the bytes that a task sorts to append them, and what a record takes there besides its texts.
SEGMENT_BYTES, RECORD_BYTES = 1 << 25, 64
_COMMITS = "_commits"


def _partition_folder(partition: int) -> str:
    return f"partition={partition}"


def _segments(root: str) -> dict[int, list[tuple[int, int, str]]]:
    """(first offset, offset after the last, path) of each segment by partition, in order. Only names are read."""
    store, path = store_of(root)
    found: dict[int, list[tuple[int, int, str]]] = {}
    for folder in store.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True)):
        if not folder.base_name.startswith("partition="):
            continue
        partition = int(folder.base_name.partition("=")[2])
        names = [f for f in store.get_file_info(pyarrow.fs.FileSelector(folder.path)) if f.base_name.endswith(".jsonl") and f.base_name[0] != "."]
        parts = [(*map(int, f.base_name.removesuffix(".jsonl").split("-")), f.path) for f in names]
        found[partition] = sorted(parts)
    return found


def _write_whole(root: str, name: str, lines: Iterator[str] | Sequence[str]) -> None:
    """The file appears whole or not at all; the same file may be written again."""
    store, path = store_of(root)
    target = posixpath.join(path, name)
    store.create_dir(posixpath.dirname(target), recursive=True)
    draft = posixpath.join(posixpath.dirname(target), f".{uuid.uuid4().hex}")
    with store.open_output_stream(draft) as out:
        for line in lines:
            out.write(line.encode() + b"\n")
    store.move(draft, target)


# --- Producing ----------------------------------------------------------------------


def ends(root: str) -> dict[int, int]:
    """The offset after the last record of each partition."""
    return {partition: parts[-1][1] for partition, parts in _segments(root).items() if parts}


def enqueue(records: DataFrame, root: str, order: Sequence[str | Column], partitions: int) -> None:
    """Append the records (key, value) to the queue, each key in one partition and in the given order.

    The records are sorted in ranges of about ``SEGMENT_BYTES``, so that no task holds more, however few partitions there
    are. A task writes a draft for each partition in its range, as the records come. When all are written, the drafts
    become segments, one after the other, at the offsets that their numbers of records give. No reader sees drafts, so a
    task that runs again adds nothing twice; those of a call that stopped stay. A call that stops while drafts become
    segments has appended the first ones. One producer appends at a time; the number of partitions stays what it was at first.
    """
    known, now, drafts = ends(root), datetime.now(UTC).isoformat(), f"_drafts/{uuid.uuid4().hex}"
    placed = records.select("key", "value", F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int").alias("partition"), *[F.col(c).alias(f"_{k}") if isinstance(c, str) else c.alias(f"_{k}") for k, c in enumerate(order)])
    length = F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0)) + RECORD_BYTES
    ranges = placed.groupBy("partition").agg(F.sum(length).alias("n")).agg(F.sum(F.ceil(F.col("n") / SEGMENT_BYTES))).first()[0]
    if not ranges:
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("partition", "key", "value")), strict=True))
        held, place = next(rows, None), TaskContext.get().partitionId()
        while held is not None:
            partition, number = held[0], 0

            def lines() -> Iterator[str]:
                nonlocal held, number
                while held is not None and held[0] == partition:  # noqa: B023
                    yield json.dumps([held[1], held[2], now])
                    held, number = next(rows, None), number + 1

            name = f"{drafts}/{uuid.uuid4().hex}"
            _write_whole(root, name, lines())
            yield pa.RecordBatch.from_pydict({"partition": pa.array([partition], pa.int32()), "place": pa.array([place], pa.int64()), "n": pa.array([number], pa.int64()), "name": [name]})

    # Records of one place in the order are told apart by their hash, so that they need not share a range.
    sorting = ["partition", *[f"_{k}" for k in range(len(order))], F.xxhash64("key", "value")]
    sorted_rows = placed.repartitionByRange(int(ranges), *sorting).sortWithinPartitions(*sorting)
    written = sorted_rows.select("partition", "key", "value").mapInArrow(write, "partition int, place long, n long, name string").collect()
    store, path = store_of(root)
    for row in sorted(written, key=lambda r: (r["partition"], r["place"])):
        partition, first = row["partition"], known.get(row["partition"], 0)
        known[partition] = first + row["n"]
        folder = posixpath.join(path, _partition_folder(partition))
        store.create_dir(folder, recursive=True)
        store.move(posixpath.join(path, row["name"]), posixpath.join(folder, f"{first:020}-{known[partition]:020}.jsonl"))
    store.delete_dir(posixpath.join(path, drafts))


def committed(root: str) -> dict[str, dict[int, int]]:
    """Per consumer group the offsets up to which its batches are done."""
    store, path = store_of(f"{root}/{_COMMITS}")
    found = {}
    for file in store.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True)):
        if file.base_name.endswith(".json") and file.base_name[0] != ".":
            with store.open_input_stream(file.path) as data:
                found[file.base_name.removesuffix(".json")] = {int(p): n for p, n in json.loads(data.read()).items()}
    return found


def trim(root: str) -> int:
    """Delete the segments that every consumer group has committed; returns how many. The last one of a partition stays, as it names the end."""
    groups, gone = list(committed(root).values()), 0
    store, _ = store_of(root)
    for partition, parts in _segments(root).items() if groups else ():
        done = min(group.get(partition, 0) for group in groups)
        for _, end, path in parts[:-1]:
            if end <= done:
                store.delete_file(path)
                gone += 1
    return gone


# --- Reading ------------------------------------------------------------------------


@dataclass
class Range(InputPartition):
    """The records of one partition from an offset to before another one."""

    partition: int
    start: int
    end: int


class QueueReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.group = options["path"], options.get("group", "default")

    def initialOffset(self) -> dict:
        """The oldest records that are still there."""
        return {str(partition): parts[0][0] for partition, parts in _segments(self.root).items() if parts}

    def latestOffset(self) -> dict:
        return {str(partition): end for partition, end in ends(self.root).items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        """One task per partition, so that the records of a key come in order."""
        asked = [Range(int(p), start.get(p, 0), last) for p, last in end.items()]
        return [r for r in asked if r.start < r.end]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.root)
        held: list[tuple] = []
        at = partition.start
        for first, last, path in _segments(self.root).get(partition.partition, []):
            if last <= partition.start or first >= partition.end:
                continue
            if first > at:
                raise RuntimeError(f"records {at} to {first} of partition {partition.partition} are gone")
            with store.open_input_stream(path) as file:
                for number, line in enumerate(_lines(file), first):
                    if partition.start <= number < partition.end:
                        key, value, written = json.loads(line)
                        held.append((key, value, partition.partition, number, datetime.fromisoformat(written)))
                        if len(held) == READ_RECORDS:
                            yield _batch(held)
                            held = []
            at = last
        if at < partition.end:
            raise RuntimeError(f"records {at} to {partition.end} of partition {partition.partition} are gone")
        if held:
            yield _batch(held)

    def commit(self, end: dict) -> None:
        _write_whole(f"{self.root}/{_COMMITS}", f"{self.group}.json", [json.dumps(end)])


def _lines(file) -> Iterator[bytes]:
    rest = b""
    while chunk := file.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.timestamp("us", "UTC")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "value", "partition", "offset", "timestamp"])


class FolderQueue(DataSource):
    """The queue at ``path``, read by the consumer group ``group``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> QueueReader:
        return QueueReader(self.options)


def queue_stream(spark: SparkSession, root: str, group: str = "default") -> DataFrame:
    """An endless stream of the records in a queue: key, value, partition, offset, timestamp."""
    spark.dataSource.register(FolderQueue)
    return spark.readStream.format(FORMAT).option("group", group).load(root)
