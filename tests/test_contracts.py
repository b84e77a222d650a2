import pytest
from conftest import rows

from runloom import operators as op
from runloom.constants import PLAN_KEYS


def test_outputs(spark):
    cases = {
        "csv": [".csv"],
        "png": [".png"],
        "txt": [".txt"],
        "upper": [".CSV"],
        "csv+png": [".csv", ".png"],
        "csv+csv": [".csv", ".csv"],
        "png+png": [".png", ".png"],
        "png+jpg": [".png", ".jpg"],
        "csv+txt": [".csv", ".txt"],
        "three": [".csv", ".png", ".jpg"],
    }
    files = spark.createDataFrame([(run, ext) for run, exts in cases.items() for ext in exts], "run string, ext string")
    runs = spark.createDataFrame([(run,) for run in [*cases, "none"]], "run string")
    got = {r["run"]: (r["ok"], r["reason"]) for r in op.check_outputs(files, runs).collect()}
    assert {run for run, (ok, _) in got.items() if ok} == {"csv", "png", "csv+png"}
    assert got["none"] == (False, "file count") and got["three"] == (False, "file count")
    assert got["txt"] == got["upper"] == (False, "extension")
    assert {got[r][1] for r in ("csv+csv", "png+png", "png+jpg", "csv+txt")} == {"pair"}


def test_plan_keys(spark):
    complete = [("full", key) for key in PLAN_KEYS]
    sections = [("full", "user_parameters:train_pipeline"), ("full", "ui_args_detail")]
    partial = [("part", key) for key in PLAN_KEYS if key not in ("version", "control:backup_size")]
    data = [*complete, *sections, *partial, ("part", "extra"), ("part", "extra"), ("empty", None)]
    got = rows(op.check_keys(spark.createDataFrame(data, "plan_id string, key string")))
    assert [r for r in got if r[0] == "full"] == []
    assert [r for r in got if r[0] == "part"] == [
        ("part", "defaulted", "control:backup_size"),
        ("part", "missing", "version"),
        ("part", "not_allowed", "extra"),
    ]
    assert len([r for r in got if r[0] == "empty"]) == len(PLAN_KEYS)


def test_step_lists_match_with_repeats(spark):
    schema = "plan_id int, pipeline string, step string"
    params = spark.createDataFrame(
        [(1, "train", "a"), (1, "train", "b"), (2, "train", "a"), (2, "train", "a"), (3, "train", "a"), (3, "other", "x")], schema
    )
    sources = spark.createDataFrame(
        [(1, "train", "b"), (1, "train", "a"), (2, "train", "a"), (3, "train", "a"), (3, "train", "c"), (4, "train", "a")], schema
    )
    got = {r["plan_id"]: r["matches"] for r in op.match_steps(params, sources).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_duplicates(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "k string")
    assert rows(op.find_duplicates(df, ["k"])) == [(None, 2), ("a", 2)]


def test_texts_at_the_limits(spark):
    data = [
        ("é" * 2499 + "a", "my-solution-v0"),
        ("é" * 2500, "My-Solution"),
        ("a" * 499, "a" * 100),
        ("a" * 500, "a" * 101),
        ("", "with_underscore"),
        ("", ""),
    ]
    df = op.check_text(spark.createDataFrame(data, "t string, n string"), "t", "n")
    got = [(r["bytes_ok"], r["chars_ok"], r["name_ok"], r["name_bytes_ok"]) for r in df.collect()]
    assert got == [
        (True, False, True, True),
        (False, False, True, True),
        (True, True, True, True),
        (True, False, True, False),
        (True, True, False, True),
        (True, True, False, True),
    ]
    lower = op.check_text(df.select("t", "n"), "t", "n", lower=True)
    assert [r["name_ok"] for r in lower.collect()][:2] == [True, False]


@pytest.mark.parametrize(
    ("spec", "violations"),
    [
        (("string", None, "", "1,5"), []),
        (("string", None, None, None), []),
        (("int", None, "", "1,5"), ["default required"]),
        (("int", None, "1", "1,5.5"), ["whole range"]),
        (("int", None, "1", "1"), ["two range ends"]),
        (("float", None, "1", "0.1, 1e3"), []),
        (("float", None, "1", "a,b,c"), ["two range ends", "number range"]),
        (("string", None, "x", "a,5"), ["whole range"]),
        (("single_selection", "a,b", "a", None), []),
        (("single_selection", "a", "a,b", None), ["one default", "several selectable"]),
        (("multi_selection", "a,b", "a", None), ["several defaults"]),
        (("multi_selection", "a,b", "", None), ["default required"]),
    ],
)
def test_argument_specs(spark, spec, violations):
    df = spark.createDataFrame([spec], "type string, selectable string, default string, range string")
    assert op.check_arg_specs(df).first()["violations"] == violations


def test_enum(spark):
    df = spark.createDataFrame([("table",), ("image",), ("Table",), (None,)], "t string")
    assert rows(op.check_enum(df, "t", ["table", "image"])) == [(None,), ("Table",)]


def test_registry(spark):
    existing = spark.createDataFrame(
        [("a", "2"), ("a", "10"), ("a", "beta"), ("a", "inf"), ("b", "beta")], "name string, version string"
    )
    new = spark.createDataFrame(
        [("a", True), ("a", False), ("b", True), ("c", True), ("c", False)], "name string, is_update boolean"
    )
    assert rows(op.check_registry(new, existing)) == [
        ("a", False, "name exists", None),
        ("a", True, "", 11),
        ("b", True, "no numeric version", None),
        ("c", False, "", 1),
        ("c", True, "unknown name", None),
    ]
