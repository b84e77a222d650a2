import pytest
from conftest import rows

from runloom import operators as op

PARAMS = "plan_id int, pipeline string, step string, name string, value string"


def params(spark, *data):
    return spark.createDataFrame([(1, "train", *row) for row in data], PARAMS)


def test_flatten_keeps_steps_without_arguments(spark):
    plans = spark.createDataFrame(
        [(1, "train", [("input", {"x": "1", "y": None}), ("train", None), ("end", {})]), (2, "train", None)],
        "plan_id int, pipeline string, steps array<struct<step: string, args: map<string,string>>>",
    )
    assert rows(op.flatten_params(plans), "plan_id", "step", "name", "value") == [
        (1, "end", None, None),
        (1, "input", "x", "1"),
        (1, "input", "y", None),
        (1, "train", None, None),
    ]


def test_defaults(spark):
    controls = spark.createDataFrame(
        [(1, "backup_size", "5"), (1, "interface_mode", None), (2, None, None)], "plan_id int, key string, value string"
    )
    got = rows(op.fill_defaults(controls))
    assert len(got) == 14
    assert (1, "backup_size", "5", False) in got and (2, "backup_size", "1000", True) in got
    assert (1, "interface_mode", None, False) in got and (2, "interface_mode", "memory", True) in got


def test_overlay(spark):
    base = params(spark, ("s", "a", "1"), ("s", "b", "2"), ("s", "c", None), ("bare", None, None))
    override = params(
        spark, ("s", "a", " x , y "), ("s", "b", ""), ("s", "d", "new"), ("bare", "z", "1"), ("unknown", "a", "1"), ("s", "c", "7")
    )
    assert rows(op.overlay_params(base, override), "step", "name", "value", "origin") == [
        ("bare", None, None, "base"),
        ("s", "a", "x,y", "override"),
        ("s", "b", "2", "base"),
        ("s", "c", "7", "override"),
        ("s", "d", "new", "added"),
    ]
    nothing = override.limit(0)
    assert rows(op.overlay_params(base, nothing).drop("origin")) == rows(base)


def test_paths(spark):
    schema = "plan_id int, pipeline string, path_key string, uri string"
    data = [(1, p, k, "old") for p in ("train", "inference") for k in ("dataset_uri", "artifact_uri", "model_uri")]
    override = [
        (1, "train", "dataset_uri", None),
        (1, "inference", "dataset_uri", ""),
        (1, "train", "model_uri", "m"),
        (1, "inference", "model_uri", "m"),
        (1, "inference", "unknown", "u"),
    ]
    got = rows(op.overlay_paths(spark.createDataFrame(data, schema), spark.createDataFrame(override, schema)))
    assert [r[1:] for r in got] == [
        ("inference", "artifact_uri", "old", None),
        ("inference", "dataset_uri", "", "E122"),
        ("inference", "model_uri", "m", None),
        ("train", "artifact_uri", "old", None),
        ("train", "dataset_uri", None, None),
        ("train", "model_uri", "old", None),
    ]


def test_clean_args(spark):
    df = params(spark, ("s", "a", None), ("s", "b", ""), ("s", "c", " "), ("s", "d", "a,"), ("s", "e", "x"), ("s", "f", "x , y"))
    got = {r["name"]: (list(r["parts"]), r["is_list"]) for r in op.clean_args(df).collect()}
    assert got == {"c": ([""], False), "d": (["a", ""], True), "e": (["x"], False), "f": (["x", "y"], True)}


@pytest.mark.parametrize(
    ("values", "kind"),
    [
        (["1", " 7 "], "int"),
        (["1", "1.5"], "float"),
        (["True", "False", None], "bool"),
        (["True", "1"], "string"),
        (["1", "x"], "string"),
        (["1e3"], "float"),
        (["inf"], "string"),
        ([None], None),
    ],
)
def test_types(spark, values, kind):
    df = params(spark, *[("s", "a", v) for v in values])
    assert op.infer_types(df).first()["type"] == kind


def test_ui_args(spark):
    detail, chosen = params(spark, ("s", "a", "1"), ("s", "b", "2")), params(spark, ("s", "a", None), ("t", "a", None))
    assert rows(op.select_ui_args(detail, chosen), "step", "name") == [("s", "a")]
    assert rows(op.unknown_ui_args(detail, chosen)) == [("t", "a")]


def test_diff_and_merge(spark):
    old = params(spark, ("s", "same", "1"), ("s", "gone", "1"), ("s", "changed", "1"), ("s", "null", None))
    new = params(spark, ("s", "same", "1"), ("s", "new", "1"), ("s", "changed", None), ("s", "null", None))
    assert rows(op.diff_plans(old, new), "name", "change", "old_value", "new_value") == [
        ("changed", "changed", "1", None),
        ("gone", "removed", "1", None),
        ("new", "added", None, "1"),
    ]
    inference = spark.createDataFrame([(1, "inference", "s", "a", "1")], PARAMS)
    both = old.unionByName(inference)
    assert rows(op.merge_plan(both, new, "train")) == rows(new.unionByName(inference))
    assert rows(op.merge_plan(both, new, "inference")) == rows(old)
    assert rows(op.merge_plan(both, new)) == rows(new)
    with pytest.raises(ValueError):
        op.merge_plan(both, new, "other")


def test_defaults_sort_no_more_than_the_plans_of_a_partition(spark):
    controls = spark.range(100).selectExpr("id AS plan_id", "'backup_log' AS key", "CAST(id AS string) AS value")
    filled = op.fill_defaults(controls)
    plan = filled._jdf.queryExecution().executedPlan().toString()
    # A sort that lies below the exchange takes all rows that a task has read.
    assert "Sort" in plan.partition("Exchange")[0] and "Sort" not in plan.partition("Exchange")[2]
    assert filled.filter("key = 'backup_log' AND value = CAST(plan_id AS string) AND NOT defaulted").count() == 100
    assert filled.filter("defaulted").count() == filled.count() - 100
