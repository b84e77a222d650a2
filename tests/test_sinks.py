from conftest import rows

from runloom import operators as op


def test_csv_output(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "i int, t string")
    path = op.write_output(df, f"{tmp_path}/out")
    assert rows(spark.read.schema(df.schema).option("header", "true").csv(path)) == rows(df)


def test_artifacts(spark, tmp_path):
    df = spark.range(3)
    assert op.write_artifacts({"output": df}, None, "train", "r") == []
    paths = op.write_artifacts({"output": df, "models": df}, str(tmp_path), "inference", "r1", "zstd")
    assert [p.removeprefix(str(tmp_path)) for p in paths] == ["/inference/output/run_id=r1", "/inference/models/run_id=r1"]
    assert spark.read.parquet(f"{tmp_path}/inference/output").columns == ["id", "run_id"]
    try:
        op.write_artifacts({"report": df}, str(tmp_path), "inference", "r1")
        raise AssertionError("an area of another run type was taken")
    except ValueError as error:
        assert "report" in str(error)


def test_ledger_grows(spark, tmp_path):
    schema = "ptype string, start_time string, name string, failed boolean, n bigint"
    first = spark.createDataFrame([("train", "20240101T000000Z", "p", False, 7)], schema)
    second = spark.createDataFrame([("inference", "20240102T000000Z", "p", True, 8)], schema)
    for records in (first, second):
        op.append_run(records, f"{tmp_path}/ledger", number=records["n"])
    got = spark.read.parquet(f"{tmp_path}/ledger")
    assert rows(got, "folder", "ptype") == [
        ("20240101T000000Z-00000007-p", "train"),
        ("20240102T000000Z-00000008-p-error", "inference"),
    ]
    op.append_run(first, f"{tmp_path}/drawn")
    drawn = spark.read.parquet(f"{tmp_path}/drawn").first()["id"]
    assert len(drawn.split("-")[1]) == 8 and drawn.split("-")[1].isdigit()


def test_prefix_is_replaced_or_kept(spark, tmp_path):
    schema = "name string, version string, pipeline string, area string, v int"
    root = f"{tmp_path}/published"
    data = [("s", "v1", "train", "data", 1), ("s", "v1", "train", "artifacts", 2), ("s", "v2", "train", "data", 3)]
    op.replace_prefix(spark.createDataFrame(data, schema), root)
    op.replace_prefix(spark.createDataFrame([("s", "v1", "train", "data", 9)], schema), root)
    op.replace_prefix(spark.createDataFrame([("s", "v1", "train", "artifacts", 4)], schema), root, keep=True)
    assert rows(spark.read.parquet(root), "v") == [(2,), (3,), (4,), (9,)]
