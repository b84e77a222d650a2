import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from runloom import plans
from runloom.plans import Step, StepError


def add(df, n=1):
    return df.withColumn("v", F.col("v") + n)


def fails(df, args, config):
    raise ValueError("no data")


def counts(df, args, config):
    return df, {**config, "n": config.get("n", 0) + 1}


STEPS = [Step("one", plans.native_step(add), {"n": 1}), Step("ten", plans.native_step(add), {"n": 10}), Step("count", counts)]


def data(spark):
    return spark.range(3).select(F.col("id").alias("v"))


def test_steps_run_in_order_by_name_or_list(spark):
    assert rows(plans.run_steps(data(spark), STEPS)[0]) == [(11,), (12,), (13,)]
    assert rows(plans.run_steps(data(spark), STEPS, "ten")[0]) == [(10,), (11,), (12,)]
    result, config = plans.run_steps(data(spark), STEPS, ["one", "one", "count"], {"n": 5})
    assert rows(result) == [(2,), (3,), (4,)] and config["n"] == 6


def test_unknown_and_failing_steps(spark):
    with pytest.raises(ValueError, match="nope"):
        plans.run_steps(data(spark), STEPS, "nope")
    reached = []
    steps = [Step("bad", fails), Step("after", lambda df, args, config: reached.append(1) or df)]
    with pytest.raises(StepError, match="step bad failed: no data"):
        plans.run_steps(data(spark), steps)
    assert reached == []
    with pytest.raises(ValueError, match="differ"):
        plans.run_steps(data(spark), [STEPS[0], STEPS[0]])


def test_config_is_read_only_for_a_step(spark):
    def writes(df, args, config):
        config["n"] = 1
        return df

    with pytest.raises(StepError):
        plans.run_steps(data(spark), [Step("w", writes)])


def test_both_modes_give_the_same(spark):
    memory = plans.run_steps(data(spark), STEPS, mode="memory")[0]
    file = plans.run_steps(data(spark), STEPS, mode="file")[0]
    assert rows(memory) == rows(file)
    assert "FileScan parquet" in file._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(StepError, match="mode"):
        plans.run_steps(data(spark), STEPS, mode="disk")


def test_a_failed_run_goes_on_behind_its_last_whole_step(spark, tmp_path):
    ran = []

    def step(name, fails=False):
        def code(data, args, config):
            ran.append(name)
            if fails:
                raise RuntimeError("no")
            return data.withColumn(name, F.lit(config["n"])), {"n": config["n"] + 1}

        return Step(name, code)

    root = f"{tmp_path}/steps"
    with pytest.raises(StepError):
        plans.run_steps(data(spark), [step("a"), step("b"), step("c", True)], config={"n": 1}, mode="file", root=root)
    result, config = plans.run_steps(data(spark), [step("a"), step("b"), step("c")], config={"n": 1}, mode="file", root=root)
    assert ran == ["a", "b", "c", "c"] and config == {"n": 4}
    assert rows(result.select("a", "b", "c").distinct()) == [(1, 2, 3)]


def test_python_steps_do_not_depend_on_batches(spark):
    def batch(frame: pd.DataFrame, factor: int) -> pd.DataFrame:
        return pd.DataFrame({"w": frame["v"] * factor})

    def column(frame: pd.DataFrame, plus: int) -> pd.Series:
        return frame["v"] + frame["v"] + plus

    steps = [
        Step("p", plans.pandas_step(batch, "w bigint"), {"factor": 3}),
    ]
    assert rows(plans.run_steps(data(spark).repartition(3), steps)[0]) == [(0,), (3,), (6,)]
    steps = [Step("c", plans.vector_step("w", column, "bigint", ["v"]), {"plus": 1})]
    assert rows(plans.run_steps(data(spark), steps)[0]) == [(0, 1), (1, 3), (2, 5)]


def training(spark):
    return spark.range(200).select(
        (F.col("id") % 10).cast("double").alias("x"),
        F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("word"),
        F.when(F.col("id") % 10 < 5, "low").otherwise("high").alias("y"),
    )


def test_model_is_saved_and_scores_the_same(spark, tmp_path):
    df = training(spark)
    model = plans.fit_step(df, ["x", "word"], "y", {"n_estimators": 5, "max_depth": 3}, f"{tmp_path}/m")
    now = plans.score_step(df.drop("y"), model)
    later = plans.score_step(df.drop("y"), f"{tmp_path}/m")
    assert rows(now, "x", "predicted") == rows(later, "x", "predicted")
    assert rows(later.filter("(x < 5) <> (predicted = 'low')"), "x") == []


def test_trees_as_expressions_and_sql(spark, tmp_path):
    import duckdb

    df = spark.range(600).select(
        (F.col("id") % 7).alias("a"),
        (F.col("id") % 3).cast("double").alias("b"),
        F.when(F.col("id") % 5 < 2, "x'").when(F.col("id") % 5 < 4, "y").otherwise("z").alias("word"),
        F.when(F.col("id") % 7 < 3, "p").when(F.col("id") % 5 < 2, "q").otherwise("r'").alias("label_"),
    )
    plans.fit_step(df.filter("a <> 6"), ["a", "b", "word"], "label_", {"n_estimators": 7, "max_depth": 4}, f"{tmp_path}/m")
    unseen = df.union(df.limit(5).withColumn("word", F.lit("new")).select(df.columns))
    scored = plans.score_step(unseen, f"{tmp_path}/m")
    forest = plans.read_forest(spark, f"{tmp_path}/m")
    both = forest.add_prediction(scored, "by_trees")
    assert both.filter("predicted <> by_trees").count() == 0 and both.count() == 605
    # An accuracy floor: the label follows from the features.
    assert both.filter("predicted = label_ AND a <> 6").count() >= 0.9 * both.filter("a <> 6").count()
    small = plans.fit_step(df, ["a", "b", "word"], "label_", {"n_estimators": 2, "max_depth": 3}, f"{tmp_path}/small")
    wanted = rows(plans.score_step(unseen, small), "a", "b", "word", "predicted")
    con = duckdb.connect()
    con.register("unseen", unseen.toPandas())
    found = con.sql(f"SELECT a, b, word, {plans.read_forest(spark, f'{tmp_path}/small').sql()} AS predicted FROM unseen").fetchall()
    assert sorted(map(str, found)) == sorted(map(str, wanted))


def test_select_xy(spark):
    df = training(spark)
    assert plans.select_xy(df, ["x"], "y").columns == ["x", "y"]
    assert plans.select_xy(df, ["x"]).columns == ["x"]
    with pytest.raises(ValueError, match="z"):
        plans.select_xy(df, ["z"])


def test_summary_of_scores(spark):
    df = spark.createDataFrame([("r", "b"), ("r", "a"), ("q", "x"), ("q", "y"), ("q", "y")], "run string, label string")
    got = {r["run"]: r for r in plans.summarize_scores(df, date="d").collect()}
    assert (got["r"]["result"], got["r"]["score"], got["r"]["probability"]) == ("a", 0.5, {"a": 0.5, "b": 0.5})
    assert (got["q"]["result"], got["q"]["score"], got["q"]["note"]) == ("y", 0.666667, "n3")


def test_summary_of_probabilities(spark):
    data = [("r", {"a": 0.25, "b": 0.75}), ("r", {"a": 0.5, "b": 0.5}), ("q", {"a": 1.0, "b": 0.0})]
    df = spark.createDataFrame(data, "run string, p map<string,double>")
    got = {r["run"]: r for r in plans.summarize_scores(df, probabilities="p").collect()}
    assert (got["r"]["result"], got["r"]["score"], got["r"]["probability"]) == ("b", 0.625, {"a": 0.375, "b": 0.625})
    assert (got["q"]["result"], got["q"]["note"], got["r"]["note"]) == ("a", "n1", "n2")


def test_scores_feed_the_summary(spark):
    df = training(spark)
    model = plans.fit_step(df, ["x", "word"], "y", {"n_estimators": 3, "max_depth": 3})
    scored = plans.score_step(df.withColumn("run", F.lit("r")), model)
    summary = plans.summarize_scores(scored, probabilities="probabilities").first()
    assert set(summary["probability"]) == {"low", "high"} and abs(sum(summary["probability"].values()) - 1) < 1e-5


def test_model_choice(spark):
    train = spark.createDataFrame([("t1",), ("t2",)], "folder string")
    assert plans.pick_model(train, "t1", "history/train") == "history/train/t1/models/"
    with pytest.raises(LookupError, match="t2"):
        plans.pick_model(train, "t9", "history/train")
    wanted = spark.createDataFrame([("i", "t2"), ("j", "t9")], "folder string, wanted_train_id string")
    assert rows(plans.pick_models(wanted, train, "h"), "folder", "model_path") == [("i", "h/t2/models/"), ("j", None)]


def test_forest_grows_on_weighted_cells(spark, tmp_path, monkeypatch):
    from runloom.plans import learning

    monkeypatch.setattr(learning, "BLOCKS", 500)
    odd = [(None, 1.0, "p"), (float("nan"), 2.0, "q"), (float("inf"), 0.0, "q"), (float("-inf"), -0.0, "p")]
    df = spark.range(20_000).select(
        F.when(F.col("id") % 50 != 0, F.col("id") / 7).alias("x"),
        (F.col("id") % 5).cast("double").alias("few"),
        F.when(F.col("id") < 8_000, "p").otherwise("q").alias("y"),
    ).union(spark.createDataFrame(odd, "x double, few double, y string"))
    cuts = learning.bin_cuts(df, ["x", "few"])
    assert cuts["few"] == [0.5, 1.5, 2.5, 3.5] and len(cuts["x"]) == 31
    cells = spark.createDataFrame([(0, 1), (1, 20_003)], "cell int, _n bigint")
    blocks = learning._blocks(cells, 20_004).groupBy("cell").agg(F.count(F.lit(1)).alias("blocks"), F.sum("_weight").alias("weight"))
    assert rows(blocks, "cell", "blocks", "weight") == [(0, 1, 1.0), (1, 488, 20_003.0)]
    plans.fit_step(df.filter("x IS NOT NULL"), ["x", "few"], "y", {"n_estimators": 9, "max_depth": 4}, f"{tmp_path}/m")
    both = plans.read_forest(spark, f"{tmp_path}/m").add_prediction(plans.score_step(df, f"{tmp_path}/m"), "by_trees")
    assert both.count() == 20_004 and both.filter("predicted <> by_trees OR by_trees IS NULL").count() == 0
    assert both.filter("predicted <> y").count() < 700
