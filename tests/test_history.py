import pytest
from conftest import rows
from pyspark.sql import functions as F

from runloom import operators as op
from runloom.constants import HISTORY_COLUMNS

RUNS = "folder string, ptype string, name string, id string, start_time string, end_time string, data_id string, has_plan boolean"
SUMMARIES = "folder string, date string, file_path string, note string, probability map<string,double>, result string, score double, version string"


def runs(spark):
    return spark.createDataFrame(
        [
            ("a", "train", "p", "a", "20240101T000000Z", "20240101T000100Z", "d1", True),
            ("b-error", "train", "p", "b", "20240101T000000Z", "20240101T000200Z", "d2", True),
            ("c", "train", "p", "", "20000101T000000Z", "20000101T000000Z", "", False),
            ("i", "inference", "p", "i", "20240101T000000Z", "20240101T000300Z", "d1", True),
        ],
        RUNS,
    )


def summaries(spark):
    return spark.createDataFrame([("a", "x", "f", "n", {"1": 0.5}, "1", 0.5, "1.0")], SUMMARIES)


def params(spark):
    return spark.createDataFrame(
        [("a", "train", "depth", "3"), ("a", "train", "rate", None), ("a", "input", "cols", "x"), ("b-error", "train", None, None)],
        "folder string, step string, name string, value string",
    )


def test_history_table(spark):
    steps = {"train": ["depth", "rate"]}
    df = op.history(runs(spark), summaries(spark), params(spark), steps, "train", keep=["folder"])
    assert df.columns[:12] == list(HISTORY_COLUMNS)
    assert "file_path" not in df.columns and "train_id" not in df.columns
    found = df.collect()
    assert [r["folder"] for r in found] == ["b-error", "a", "c"]
    assert [r["status"] for r in found] == ["error", "success", "success"]
    assert found[1]["start_time"] == "2024-01-01 00:00:00" and found[2]["end_time"] == "2000-01-01 00:00:00"
    assert [r["train.depth"] for r in found] == [None, "3", "none"]
    assert [r["train.rate"] for r in found] == [None, None, "none"]
    assert (found[0]["note"], found[0]["score"], found[0]["probability"]) == ("", None, {})
    assert found[1]["probability"] == {"1": 0.5}


def test_steps_alone_show_all_their_parameters(spark):
    args = runs(spark), summaries(spark), params(spark)
    df = op.history(*args, ["train"], "train")
    assert [c for c in df.columns if c.startswith("train.")] == ["train.depth", "train.rate"]
    with pytest.raises(ValueError, match="b-error: input"):
        op.history(*args, ["train", "input"], "train")
    assert op.parameter_names(params(spark), ["input", "nothing"]) == {"input": ["cols"], "nothing": []}
    with pytest.raises(ValueError, match="more than 1"):
        op.parameter_names(params(spark), ["train"], limit=1)


def test_inference_history_ends_with_the_train_id(spark):
    df = op.history(runs(spark), summaries(spark), ptype="inference")
    assert df.columns[:13] == [*HISTORY_COLUMNS, "train_id"]
    assert df.count() == 1


def test_id_filters_reach_the_scan(spark, tmp_path):
    runs(spark).write.partitionBy("ptype").parquet(f"{tmp_path}/ledger")
    ledger = spark.read.parquet(f"{tmp_path}/ledger")
    df = op.history(ledger, summaries(spark), ptype="train", data_id="d1")
    assert df.count() == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(data_id,d1)" in plan and "PartitionFilters: [isnotnull(ptype" in plan
    assert "SinglePartition" not in plan


def test_empty_ids_do_not_filter(spark):
    assert op.filter_ids(runs(spark)).count() == 4
    assert op.filter_ids(runs(spark), data_id="d1").count() == 2


def test_status_looks_anywhere_in_the_name(spark):
    df = spark.createDataFrame([("1-x-error-y",), ("1-error",), ("1-ok",)], "folder string")
    assert rows(df.select("folder", op.run_status().alias("s"))) == [
        ("1-error", "error"),
        ("1-ok", "success"),
        ("1-x-error-y", "error"),
    ]


def test_wanted_steps(spark):
    df = params(spark).withColumnRenamed("folder", "plan_id")
    assert rows(op.missing_steps(df, ["train", "input"])) == [("b-error", "input")]
    assert op.missing_steps(df, []).count() == 0
    op.check_steps(df, ["train"])
    with pytest.raises(ValueError, match="b-error: input"):
        op.check_steps(df, ["input"])


def test_train_run_of_an_inference_run(spark):
    schema = "folder string, id string, name string, end_time string"
    train = spark.createDataFrame(
        [
            ("t1", "t1", "p", "20240101T000000Z"),
            ("t2", "t2", "p", "20240101T100000Z"),
            ("t2b", "t2b", "p", "20240101T100000Z"),
            ("t3-error", "t3", "p", "20240101T110000Z"),
            ("q1", "q1", "q", "20240101T000000Z"),
        ],
        schema,
    )
    inference = spark.createDataFrame(
        [
            ("early", "p", "20231231T235959Z", None, False),
            ("same", "p", "20240101T000000Z", None, False),
            ("later", "p", "20240101T095959Z", "", False),
            ("tie", "p", "20240101T100000Z", None, False),
            ("after", "p", "20240301T000000Z", None, False),
            ("asked", "p", "20240301T000000Z", "t1", False),
            ("external", "p", "20240301T000000Z", "t1", True),
            ("other", "q", "20240101T000001Z", None, False),
            ("alone", "r", "20240101T000001Z", None, False),
        ],
        "folder string, name string, end_time string, wanted_train_id string, external_model boolean",
    )
    got = dict(rows(op.link_train_run(inference, train), "folder", "train_id"))
    assert got == {
        "early": "none",
        "same": "t1",
        "later": "t1",
        "tie": "t2b",
        "after": "t2b",
        "asked": "t1",
        "external": "load-external-model",
        "other": "q1",
        "alone": "none",
    }


def test_shape_keeps_the_order_of_other_columns(spark):
    df = spark.createDataFrame([(1, "i", 2, "f")], "z int, id string, y int, file_path string")
    assert op.shape_columns(df, "train").columns == [*HISTORY_COLUMNS, "z", "y"]


def test_ties_of_the_end_time_go_by_folder(spark):
    df = spark.createDataFrame([("b", "1"), ("a", "1"), ("c", "2")], "folder string, end_time string")
    assert [r["folder"] for r in op.sort_recent(df).collect()] == ["c", "a", "b"]
    assert df.select(F.max("folder")).first()[0] == "c"
