"""The queue in a folder: nothing lost and nothing repeated, whatever stops."""

import os

import pytest

from runloom import sources, streaming
from runloom.sources import queue


def put(spark, root, numbers, partitions=3, keys=5):
    records = spark.createDataFrame([(f"k{n % keys}", f"v{n}", n) for n in numbers], "key string, value string, n bigint")
    sources.enqueue(records, root, ["n"], partitions)


def drained(spark, root, target, stop=False):
    """Read all there is, or stop in the middle of the first batch."""

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{target}/rows/batch_id={batch_id}")
        if stop:
            raise RuntimeError("stopped")

    stream = sources.queue_stream(spark, root)
    streaming.drain(stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/checkpoint"))


def values(spark, target):
    return sorted(int(r["value"][1:]) for r in spark.read.parquet(f"{target}/rows").collect())


def test_records_come_once_and_in_order(spark, tmp_path):
    root, target = f"{tmp_path}/queue", f"{tmp_path}/out"
    put(spark, root, range(50, 0, -1))
    drained(spark, root, target)
    put(spark, root, range(51, 90))
    drained(spark, root, target)
    drained(spark, root, target)
    assert values(spark, target) == list(range(1, 90))
    read = spark.read.parquet(f"{target}/rows").orderBy("partition", "offset").collect()
    for key in {r["key"] for r in read}:
        mine = [r for r in read if r["key"] == key]
        assert len({r["partition"] for r in mine}) == 1
        numbers = [int(r["value"][1:]) for r in mine]
        assert numbers == sorted(numbers)
    for partition in {r["partition"] for r in read}:
        assert [r["offset"] for r in read if r["partition"] == partition] == list(range(queue.ends(root)[partition]))


def test_a_restart_in_the_middle_of_a_batch(spark, tmp_path):
    root, target = f"{tmp_path}/queue", f"{tmp_path}/out"
    put(spark, root, range(1, 40))
    with pytest.raises(Exception, match="stopped"):
        drained(spark, root, target, stop=True)
    put(spark, root, range(40, 60))
    drained(spark, root, target)
    put(spark, root, range(60, 70))
    with pytest.raises(Exception, match="stopped"):
        drained(spark, root, target, stop=True)
    drained(spark, root, target)
    assert values(spark, target) == list(range(1, 70))


def test_what_is_committed_may_go(spark, tmp_path):
    root, target = f"{tmp_path}/queue", f"{tmp_path}/out"
    for first in range(0, 30, 10):
        put(spark, root, range(first, first + 10), partitions=1)
        drained(spark, root, target)
    assert sources.trim(root) >= 1
    put(spark, root, range(30, 40), partitions=1)
    drained(spark, root, target)
    assert values(spark, target) == list(range(40))
    # A group that starts now gets what is left; one that asks for records that are gone is told so.
    late = queue.QueueReader({"path": root, "group": "late"})
    assert late.initialOffset()["0"] > 0
    with pytest.raises(RuntimeError, match="gone"):
        list(late.read(queue.Range(0, 0, 40)))


def test_a_segment_that_is_written_again_is_the_same(spark, tmp_path):
    root = str(tmp_path)
    queue._write_whole(root, "partition=0/00000000000000000000-00000000000000000002.jsonl", ['["a", "1", "2024-01-01T00:00:00+00:00"]', '["a", null, "2024-01-01T00:00:00+00:00"]'])
    os.close(os.open(f"{root}/partition=0/.draft", os.O_CREAT))
    assert queue.ends(root) == {0: 2}
    batch = next(queue.QueueReader({"path": root}).read(queue.Range(0, 1, 2)))
    assert batch.to_pylist()[0] | {"timestamp": None} == {"key": "a", "value": None, "partition": 0, "offset": 1, "timestamp": None}


def test_an_empty_queue(spark, tmp_path):
    os.makedirs(f"{tmp_path}/queue")
    drained(spark, f"{tmp_path}/queue", f"{tmp_path}/out")
    put(spark, f"{tmp_path}/queue", range(3))
    drained(spark, f"{tmp_path}/queue", f"{tmp_path}/out")
    assert values(spark, f"{tmp_path}/out") == [0, 1, 2]


def test_a_partition_is_appended_in_bounded_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queue, "SEGMENT_BYTES", 2_000)
    root, target = f"{tmp_path}/queue", f"{tmp_path}/out"
    put(spark, root, range(300, 0, -1), partitions=1)
    put(spark, root, range(301, 401), partitions=1)
    parts = queue._segments(root)[0]
    assert len(parts) >= 8 and max(end - first for first, end, _ in parts) <= 100
    assert [first for first, _, _ in parts] == [0, *[end for _, end, _ in parts[:-1]]] and parts[-1][1] == 400
    assert os.listdir(f"{root}/_drafts") == []
    drained(spark, root, target)
    read = spark.read.parquet(f"{target}/rows").orderBy("offset").collect()
    assert [r["value"] for r in read] == [f"v{n}" for n in range(1, 401)]
