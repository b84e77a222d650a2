import hashlib
import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from runloom import operators as op
from runloom import sources

from test_functions import tree


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_load_tagged_keeps_the_base_directory(spark, tmp_path):
    write(f"{tmp_path}/x/train1/a.csv", "1\n2\n")
    write(f"{tmp_path}/x/train1/deep/b.csv", "3\n")
    write(f"{tmp_path}/y/train2/a.csv", "4\n")
    paths = [f"{tmp_path}/x/train1/", f"{tmp_path}/y/train2"]
    df = sources.load_tagged(spark, paths, "csv", "v int")
    assert rows(df) == [(1, "train1"), (2, "train1"), (3, "train1"), (4, "train2")]
    assert rows(sources.load_tagged(spark, paths[1], "csv", "v int")) == [(4, "train2")]
    # a filter on the tag drops the other scan
    plan = df.filter("base_dir = 'train2'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_no_path_is_an_empty_dataset(spark):
    for nothing in (None, [], ""):
        df = sources.load_tagged(spark, nothing, schema="v int")
        assert df.columns == ["v", "base_dir"] and df.count() == 0


def test_shared_base_names_are_refused(spark):
    with pytest.raises(ValueError, match="data"):
        sources.load_tagged(spark, ["/users/train1/data/", "/users/train2/data"])


def test_manifest_lists_recursively(spark, tmp_path):
    write(f"{tmp_path}/r/a.csv", "abc")
    write(f"{tmp_path}/r/s/t/b.png", "z")
    df = sources.file_manifest(spark, f"{tmp_path}/r")
    assert rows(df, "path", "folder", "name", "ext", "size") == [
        ("a.csv", "", "a.csv", ".csv", 3),
        ("s/t/b.png", "s/t", "b.png", ".png", 1),
    ]
    assert rows(sources.file_manifest(spark, f"{tmp_path}/r", [".png"]), "path") == [("s/t/b.png",)]
    assert sources.list_files(spark, f"{tmp_path}/nowhere").count() == 0


def test_hashes_of_real_files_give_a_dataset_id(spark, tmp_path):
    write(f"{tmp_path}/d/b.txt", "two")
    write(f"{tmp_path}/d/a.txt", "one")
    hashed = sources.hash_files(spark, f"{tmp_path}/d")
    low = lambda t: int(hashlib.sha256(t.encode()).hexdigest(), 16) & ((1 << 64) - 1)
    assert [(r["path"], int(r["hash64"])) for r in hashed.orderBy("path").collect()] == [
        ("d/a.txt", low("one")),
        ("d/b.txt", low("two")),
    ]
    wanted = tree([("d/a.txt", str(low("one"))), ("d/b.txt", str(low("two")))])[:12]
    assert rows(op.dataset_id(hashed)) == [(wanted, 2)]
    assert rows(op.dataset_id(sources.hash_files(spark, None))) == [("000000000000", 0)]


def test_a_repeated_directory_name_stays_in_the_path(spark, tmp_path):
    write(f"{tmp_path}/d/x/d/a.txt", "one")
    assert rows(sources.hash_files(spark, f"{tmp_path}/d"), "path") == [("d/x/d/a.txt",)]


def test_run_folders_with_and_without_record(spark, tmp_path):
    root = f"{tmp_path}/history/inference"
    record = {
        "id": "run1",
        "data_id": "d",
        "param_id": "p",
        "code_id": "c",
        "data_id_description": {"a": 18446744073709551615},
        "start_time": "20240101T000000Z",
        "end_time": "20240101T000100Z",
        "train_id": "t1",
    }
    write(f"{root}/run1/log/record.json", json.dumps(record, indent=4))
    write(f"{root}/run1/score/run_summary.json", json.dumps({"result": "ok", "score": 0.5}))
    write(f"{root}/run1/output/record.json", json.dumps(record | {"id": "not the record"}))
    write(f"{root}/run2-error/plan.yaml", "name: x")
    df = sources.scan_run_records(spark, root, "inference", record_path="log/record.json")
    found = {r["folder"]: r for r in df.collect()}
    assert set(found) == {"run1", "run2-error"}
    assert found["run1"]["train_id"] == "t1"
    assert int(found["run1"]["data_id_description"]["a"]) == 18446744073709551615
    missing = found["run2-error"]
    assert (missing["id"], missing["end_time"], missing["train_id"]) == ("", "20000101T000000Z", "none")
    assert "train_id" not in sources.scan_run_records(spark, root, "train", "log/record.json").columns
    listed = spark.createDataFrame([("run1",), ("run3-empty",)], "folder string")
    given = sources.scan_run_records(spark, root, "inference", "log/record.json", folders=listed)
    assert rows(given, "folder", "id") == [("run1", "run1"), ("run3-empty", "")]
    summaries = sources.scan_run_summaries(spark, root)
    assert rows(summaries, "folder", "result", "score") == [("run1", "ok", 0.5)]
    known = df.withColumn("ptype", F.lit("inference")).withColumn("has_plan", F.lit(False))
    shown = op.history(known, summaries, ptype="inference", keep=["folder"])
    assert [(r["folder"], r["status"], r["result"]) for r in shown.collect()] == [("run1", "success", "ok"), ("run2-error", "error", "")]


def test_partitioned_directories_become_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "v int, part string").write.partitionBy("part").parquet(f"{tmp_path}/in")
    got = sources.load_tagged(spark, f"{tmp_path}/in", partitioned=True)
    assert rows(got, "v", "part", "base_dir") == [(1, "a", "in"), (2, "b", "in")]


def test_log_lines(spark):
    lines = [
        ("[2024-01-02 03:04:05,678|SYS|WARNING|load.py(12)|main()] slow | [x] disk",),
        ("plain text",),
        ("[SHOW|2024-01-02 03:04:05,678|USER|v]",),
    ]
    df = sources.parse_log(spark.createDataFrame(lines, "text string"))
    first, *others = df.collect()
    assert str(first["ts"]) == "2024-01-02 03:04:05.678000"
    assert (first["service"], first["level"], first["source"], first["source_line"], first["func"], first["message"]) == (
        "SYS",
        "WARNING",
        "load.py",
        12,
        "main",
        "slow | [x] disk",
    )
    assert all(row[name] is None for row in others for name in df.columns if name != "text")


def test_read_log_keeps_the_line_order(spark, tmp_path):
    lines = [f"[2024-01-01 00:00:00,000|SYS|INFO|a.py(1)|f()] current step: s{i}" for i in range(50)]
    lines[20] = "[2024-01-01 00:00:00,000|SYS|ERROR|a.py(1)|f()] bad"
    write(f"{tmp_path}/logs/p.log", "\n".join(lines) + "\n")
    parsed = sources.parse_log(sources.read_log(spark, f"{tmp_path}/logs"))
    tail = op.error_tail(parsed, order=("block_start", "scan_order"), chunk=F.col("block_start"))
    assert tail.count() == 30
    assert rows(tail.filter("is_error"), "error_step") == [("s19",)]


def test_uris(spark):
    data = ["s3://bucket/a/b/", "s3://bucket", "x/s3:/odd", "/abs/path", "a/b/", "./x", "x", "~/x"]
    df = sources.classify_uris(spark.createDataFrame([(u,) for u in data], "uri string"))
    found = {r["uri"]: (r["kind"], r["bucket"], r["key"], r["rejected"], r["suspicious"]) for r in df.collect()}
    assert found["s3://bucket/a/b/"] == ("s3", "bucket", "a/b/", False, False)
    assert found["s3://bucket"] == ("s3", "bucket", "", False, False)
    assert found["x/s3:/odd"][0] == "s3" and found["x/s3:/odd"][4] is True
    assert found["/abs/path"][:3] == ("absolute", "", "abs/path")
    assert [found[u][3] for u in ("a/b/", "./x", "x", "~/x")] == [False, True, True, True]


def test_a_file_larger_than_the_memory_of_a_task(spark, tmp_path):
    path = tmp_path / "d" / "large.bin"
    path.parent.mkdir()
    size = 3 << 30
    with open(path, "wb") as file:
        # A sparse file: 3 GB that take no room on the disk.
        file.seek(size - 4)
        file.write(b"tail")
    expected, left = hashlib.sha256(), size - 4
    while left:
        expected.update(bytes(min(left, 1 << 24)))
        left -= min(left, 1 << 24)
    expected.update(b"tail")
    found = sources.hash_files(spark, str(path.parent)).first()
    assert int(found["hash64"]) == int(expected.hexdigest(), 16) & ((1 << 64) - 1)


def test_empty_run_folders_count(spark, tmp_path):
    root = f"{tmp_path}/history"
    os.makedirs(f"{root}/run1/log")
    os.makedirs(f"{root}/run2")
    os.makedirs(f"{root}/_hidden")
    found = sources.scan_run_records(spark, root, "train")
    assert rows(found, "folder", "id") == [("run1", ""), ("run2", "")]


def test_levels_are_listed_by_tasks(spark, tmp_path):
    for a in range(30):
        for b in range(20):
            write(f"{tmp_path}/r/a{a}/b{b}/{a * b}.txt", "x" * b)
    os.makedirs(f"{tmp_path}/r/a0/empty")
    write(f"{tmp_path}/r/a0/_SUCCESS", "")
    found = sources.list_files(spark, f"{tmp_path}/r")
    assert rows(found, "path", "size") == sorted((f"{tmp_path}/r/a{a}/b{b}/{a * b}.txt", b) for a in range(30) for b in range(20))
    # The plan reads a written listing, no index of the listed files.
    assert "a1/b1" not in found._jdf.queryExecution().toString()


def test_small_files_are_written_by_tasks_where_they_belong(spark, tmp_path):
    root = f"{tmp_path}/w"
    name = sources.partition_name(F.concat(F.lit("a/b=%:"), F.col("id").cast("string")))
    path = F.concat(F.lit(f"{root}/folder="), name, F.lit("/log/record.json"))
    sources.write_small(spark.range(50).select(F.col("id").cast("string").alias("content"), path.alias("path")))
    folders = sources.run_folders(spark, root)
    assert folders.count() == 50 and set(os.listdir(f"{root}/folder=a%2Fb%3D%25%3A7/log")) == {"record.json"}
    assert sorted(os.listdir(root)) == sorted(f"folder=a%2Fb%3D%25%3A{k}" for k in range(50))
    with open(f"{root}/folder=a%2Fb%3D%25%3A7/log/record.json") as file:
        assert file.read() == "7"
