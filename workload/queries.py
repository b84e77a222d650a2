"""One query per operator over the given tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runloom import operators as op
from runloom import plans, sources, streaming
from runloom.constants import ARTIFACTS_CHANNEL, IMAGE_EXTENSIONS, SUMMARY_CHANNEL
from runloom.functions.hashing import content_hash64, short_id
from runloom.functions.text import base_name
from runloom.operators.logs import SERVICE_CLASSES
from runloom.plans import Step
from runloom.session import prepare, scratch_dir
from workload import views
from workload.views import table, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RETENTION_LIMIT = 20_000 * 1024 * 1024
# Runs from this start on are appended after a first trimming.
RETENTION_HALF = "20000101T000000Z"
SHOWN_STEPS = {"view": ["k0", "k1", "k2", "k3"], "purchase": ["k0", "k1"]}
SERVED = {"view": ["k0", "k1"], "click": ["k2", "k3"]}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(prepare(spark), sf_dir)

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    QUERIES[function.__name__] = run
    return run


def flat_columns(df: DataFrame) -> DataFrame:
    """Dots in column names as double underscores."""
    return df.toDF(*[name.replace(".", "__") for name in df.columns])


def stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs as a stored ledger, partitioned by type."""
    runs = views.runs(spark, sf_dir)
    path = scratch_dir(spark, "runs")
    runs.hint("rebalance", "ptype").sortWithinPartitions("ptype", "folder").write.partitionBy("ptype").parquet(path)
    return spark.read.schema(runs.schema).parquet(path)


def id_of(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()[:12]


# --- A: sources -----------------------------------------------------------------


@query
def a1_load_tagged(spark, sf_dir):
    """Two directories, each partitioned by year."""
    year = F.substring("folder", 1, 4).alias("year")
    runs = views.runs(spark, sf_dir).select("k", "ptype", "folder", "size_bytes", year)
    root = scratch_dir(spark, "a1")
    for ptype in ("train", "inference"):
        runs.filter(F.col("ptype") == ptype).drop("ptype").write.partitionBy("year").parquet(f"{root}/{ptype}")
    loaded = sources.load_tagged(spark, [f"{root}/train", f"{root}/inference/"], partitioned=True)
    return loaded.withColumn("year", text(F.col("year")))


@query
def a2_file_manifest(spark, sf_dir):
    files = views.files(spark, sf_dir, content=False).select("path", "size")
    return sources.describe_files(files, IMAGE_EXTENSIONS)


@query
def a2_file_manifest_scan(spark, sf_dir):
    """The files of a folder that was written from the documents, one file per language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    root = scratch_dir(spark, "a2")
    docs.repartition("lang").write.partitionBy("lang").csv(root)
    found = sources.file_manifest(spark, root, [".csv"])
    return found.groupBy("folder", "ext").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("size"))


@query
def a3_scan_run_records(spark, sf_dir):
    k = F.col("c_custkey")
    start = F.date_format(F.timestamp_seconds(1704067200 + k), "yyyyMMdd'T'HHmmss'Z'")
    folder = F.concat_ws("-", start, F.lpad(text(k), 8, "0"), F.lower("c_mktsegment"))
    runs = table(spark, sf_dir, "customer").select(
        k.alias("k"),
        folder.alias("folder"),
        folder.alias("id"),
        start.alias("start_time"),
        start.alias("end_time"),
        F.create_map(F.lit("train/data.csv"), content_hash64(F.col("c_name"))).alias("data_id_description"),
        short_id(F.sha2("c_name", 256)).alias("data_id"),
    )
    root = scratch_dir(spark, "a3")
    place = F.concat(F.lit(f"{root}/folder="), sources.partition_name(F.col("folder")))
    record = F.to_json(F.struct(*[c for c in runs.columns if c not in ("k", "folder")]))

    def document(wanted: F.Column, name: str, content: F.Column) -> F.Column:
        return F.when(wanted, F.struct(F.concat(place, F.lit(f"/{name}")).alias("path"), content.alias("content")))

    documents = [
        document(F.expr("k % 10 <> 0"), "record.json", record),
        # Other documents of a run, which are not its record.
        document(F.expr("k % 4 = 0"), "area=output/other.json", F.lit('{"id":"x"}')),
        document(F.expr("k % 10 = 0"), "plan.txt", F.lit("name: plan")),
    ]
    sources.write_small(runs.select(F.inline(F.array_compact(F.array(*documents)))))
    found = sources.scan_run_records(spark, root, "train", record_path="*.json")
    return found.select(
        "folder",
        "id",
        "data_id",
        "param_id",
        "start_time",
        text(F.try_element_at("data_id_description", F.lit("train/data.csv"))).alias("data_hash"),
    )


@query
def a4_parse_log(spark, sf_dir):
    parsed = sources.parse_log(views.log_lines(spark, sf_dir))
    return parsed.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")).drop("text")


@query
def a5_profile_uris(spark, sf_dir):
    return sources.profile_uris(views.uris(spark, sf_dir))


# --- B: identity ----------------------------------------------------------------


@query
def b1_content_hash64(spark, sf_dir):
    return views.files(spark, sf_dir).select("doc_id", text(content_hash64(F.col("content"))).alias("hash64"))


@query
def b2_dataset_id(spark, sf_dir):
    """One id per base directory and one over all of them, from file hashes that are stored once."""
    hashed = op.file_hashes(views.files(spark, sf_dir)).select("base_dir", "path", "hash64")
    hashed = plans.interface(hashed, "file", "hashes")
    everything = op.dataset_id(hashed).withColumn("base_dir", F.lit("*"))
    return op.dataset_id(hashed, ["base_dir"]).unionByName(everything)


@query
def b2_renewed_id(spark, sf_dir):
    """The same ids from stored leaves: a dataset of older files is stored, then changed, new and deleted files are taken over."""
    hashed = op.file_hashes(views.files(spark, sf_dir)).select("base_dir", "path", "hash64", "doc_id")
    hashed = plans.interface(hashed, "file", "hashes")
    number = F.col("doc_id")
    changed, new, gone = number % 10 == 0, number % 7 == 1, number % 13 == 2
    older = hashed.filter(~new).withColumn("hash64", F.when(changed, F.lit(0).cast("decimal(20,0)")).otherwise(F.col("hash64")))
    extra = hashed.filter(gone).withColumn("path", F.concat("path", F.lit(".old")))
    columns = ["base_dir", "path", "hash64"]
    changes = hashed.filter(changed | new).select(columns).union(extra.withColumn("hash64", F.lit(None).cast("decimal(20,0)")).select(columns))
    root = op.store_dataset(older.select(columns).union(extra.select(columns)), scratch_dir(spark, "dataset"), ["base_dir"])
    op.renew_dataset(changes, root, ["base_dir"])
    return op.stored_id(spark, root, ["base_dir"])


@query
def b3_param_id(spark, sf_dir):
    return op.param_id(views.params(spark, sf_dir))


@query
def b4_group_digest(spark, sf_dir):
    digests = op.group_digest(views.files(spark, sf_dir), ["base_dir", "step"])
    return digests.withColumn("code_hash", text(F.col("code_hash")))


@query
def b5_code_id(spark, sf_dir):
    """Steps in the order of a plan that runs them from the last name to the first."""
    digests = op.group_digest(views.files(spark, sf_dir), ["base_dir", "step"])
    position = F.lit(4) - F.array_position(F.array(*map(F.lit, ["de", "en", "es", "fr"])), F.col("step"))
    ids = op.code_id(digests, ["base_dir"], position)
    steps = F.array_sort(F.transform(F.map_entries("code_id_description"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return ids.select("base_dir", "code_id", F.array_join(steps, ",").alias("steps"))


# --- C: history -----------------------------------------------------------------


def _as_text(df: DataFrame, column: str = "probability") -> DataFrame:
    return df.withColumn(column, F.to_json(column))


@query
def c1_attach_summary(spark, sf_dir):
    runs = views.runs(spark, sf_dir).select("folder", "ptype")
    return _as_text(op.attach_summary(runs, views.run_scores(spark, sf_dir)))


def _step_params(spark, sf_dir):
    return views.params(spark, sf_dir).filter("pipeline = 'train'").drop("pipeline")


@query
def c2_attach_params(spark, sf_dir):
    runs = views.runs(spark, sf_dir).select("folder", "plan_id", "has_plan")
    return flat_columns(op.attach_params(runs, _step_params(spark, sf_dir), SHOWN_STEPS, key="plan_id"))


@query
def c3_run_status(spark, sf_dir):
    return views.runs(spark, sf_dir).select("folder", op.run_status().alias("status"))


@query
def c4_shape_columns(spark, sf_dir):
    runs = views.runs(spark, sf_dir).select(
        "size_bytes", "code_id", "folder", "id", F.lit("x").alias("file_path"), "start_time"
    )
    return op.shape_columns(runs, "inference")


@query
def c5_display_times(spark, sf_dir):
    return op.display_times(views.ledger(spark, sf_dir).select("folder", "start_time", "end_time"))


@query
def c6_filter_ids(spark, sf_dir):
    runs = views.runs(spark, sf_dir).select("folder", "data_id", "param_id", "code_id")
    return op.filter_ids(runs, data_id=id_of("7"), param_id=id_of("p3"))


@query
def c7_sort_recent(spark, sf_dir):
    """The rank makes the order part of the result."""
    return op.rank_recent(views.ledger(spark, sf_dir).select("folder", "end_time"))


@query
def c8_check_steps(spark, sf_dir):
    steps = op.flatten_params(views.nested_plans(spark, sf_dir))
    return op.missing_steps(steps, ["system", "assistant", "end", "score"])


def _inference_runs(runs):
    """Inference runs; some ask for the run before them, some use an external model."""
    k = F.col("k")
    before = runs.select((k + 1).alias("k"), F.col("folder").alias("_before"))
    return (
        runs.filter("ptype = 'inference'")
        .join(before, "k", "left")
        .withColumns(
            {
                "wanted_train_id": F.when(k % 5 == 1, F.col("_before")),
                "external_model": k % 35 == 3,
            }
        )
        .drop("_before")
    )


@query
def c9_link_train_run(spark, sf_dir):
    runs = stored_runs(spark, sf_dir)
    linked = op.link_train_run(_inference_runs(runs), runs.filter("ptype = 'train'"))
    return linked.select("folder", "name", "end_time", "train_id")


@query
def c10_history(spark, sf_dir):
    """The flagship: all train runs with summary and parameters, newest first."""
    table_ = op.history(
        views.ledger(spark, sf_dir),
        views.scores(spark, sf_dir),
        _step_params(spark, sf_dir),
        SHOWN_STEPS,
        ptype="train",
        summary_key="k",
        params_key="plan_id",
        keep=["folder"],
    )
    return _as_text(flat_columns(table_))


@query
def c10_history_inference(spark, sf_dir):
    """The inference side: with the train run of each, one data set only."""
    runs = stored_runs(spark, sf_dir)
    linked = op.link_train_run(_inference_runs(runs), runs.filter("ptype = 'train'"))
    columns = ["k", "folder", "ptype", "id", "start_time", "end_time", "data_id", "param_id", "code_id", "train_id"]
    table_ = op.history(
        linked.select(*columns),
        views.scores(spark, sf_dir),
        ptype="inference",
        data_id=id_of("7"),
        summary_key="k",
    )
    return _as_text(table_)


# --- D: ordered -----------------------------------------------------------------


@query
def d1_retention_plan(spark, sf_dir):
    return op.retention_plan(stored_runs(spark, sf_dir), RETENTION_LIMIT)


@query
def d2_show_increments(spark, sf_dir):
    return op.show_increments(views.log_lines(spark, sf_dir), SERVICE_CLASSES)


@query
def d3_error_tail(spark, sf_dir):
    parsed = sources.parse_log(views.log_lines(spark, sf_dir))
    return op.error_tail(parsed).select("file", "line_no", "text", "is_error", "error_step")


@query
def d4_first_wins(spark, sf_dir):
    return op.first_wins(views.requirements(spark, sf_dir))


@query
def d5_stage_durations(spark, sf_dir):
    return op.stage_durations(views.marks(spark, sf_dir))


@query
def d6_latest_by_key(spark, sf_dir):
    files = views.files(spark, sf_dir, content=False).select("base_dir", "path", "size", "doc_id")
    return op.latest_by_key(files, ".py", ["base_dir"])


# --- E: contracts ---------------------------------------------------------------


@query
def e1_check_outputs(spark, sf_dir):
    files = sources.describe_files(views.output_files(spark, sf_dir))
    runs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 3).alias("run"))
    return op.check_outputs(files, runs)


@query
def e2_check_summary(spark, sf_dir):
    return op.check_summary(views.runs(spark, sf_dir).select("folder"), views.run_scores(spark, sf_dir))


@query
def e3_check_keys(spark, sf_dir):
    return op.check_keys(views.plan_keys(spark, sf_dir))


@query
def e4_match_steps(spark, sf_dir):
    """Steps of the override compared with those of the base parameters."""
    params = views.params(spark, sf_dir, "override").select("plan_id", "pipeline", "step").distinct()
    found = views.params(spark, sf_dir, "base").select("plan_id", "pipeline", "step").distinct()
    return op.match_steps(params, found)


@query
def e5_find_duplicates(spark, sf_dir):
    names = views.uris(spark, sf_dir).select(base_name(F.col("uri")).alias("base_name"))
    return op.find_duplicates(names, ["base_name"])


@query
def e6_check_text(spark, sf_dir):
    name = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("_", "source", "lang")).otherwise(F.concat_ws("-", "source", "lang"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", name.alias("name"))
    return op.check_text(docs, "text", "name").drop("text")


@query
def e7_check_arg_specs(spark, sf_dir):
    checked = op.check_arg_specs(views.arg_specs(spark, sf_dir))
    return checked.select("spec_id", "type", F.array_join("violations", ";").alias("violations"))


@query
def e8_check_enum(spark, sf_dir):
    return op.check_enum(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["en", "de"])


@query
def e9_check_registry(spark, sf_dir):
    return op.check_registry(*views.registry(spark, sf_dir))


# --- F: parameters --------------------------------------------------------------


@query
def f1_flatten_params(spark, sf_dir):
    return op.flatten_params(views.nested_plans(spark, sf_dir))


@query
def f2_fill_defaults(spark, sf_dir):
    return op.fill_defaults(views.controls(spark, sf_dir))


@query
def f3_overlay_params(spark, sf_dir):
    return op.overlay_params(views.params(spark, sf_dir, "base"), views.params(spark, sf_dir, "override"))


def _paths(spark, sf_dir, part):
    keys = {"k0": "dataset_uri", "k1": "artifact_uri", "k2": "model_uri", "k3": "log_uri"}
    key = F.element_at(F.create_map(*[F.lit(x) for pair in keys.items() for x in pair]), F.col("name"))
    return (
        views.params(spark, sf_dir, part)
        .groupBy("plan_id", "pipeline", key.alias("path_key"))
        .agg(F.max_by("value", "step").alias("uri"))
    )


@query
def f4_overlay_paths(spark, sf_dir):
    return op.overlay_paths(_paths(spark, sf_dir, "base"), _paths(spark, sf_dir, "override"))


@query
def f5_clean_args(spark, sf_dir):
    cleaned = op.clean_args(views.params(spark, sf_dir))
    return cleaned.select(
        "plan_id",
        "pipeline",
        "step",
        "name",
        F.array_join("parts", "|").alias("parts"),
        F.size("parts").alias("n_parts"),
        "is_list",
    )


@query
def f6_infer_types(spark, sf_dir):
    """Types per plan and step."""
    return op.infer_types(views.params(spark, sf_dir), ["plan_id", "step"])


def _detail(spark, sf_dir):
    return views.params(spark, sf_dir, "base").select("plan_id", "step", "name", "value")


def _chosen(spark, sf_dir):
    return views.params(spark, sf_dir, "override").select("plan_id", "step", "name")


@query
def f7_select_ui_args(spark, sf_dir):
    """Chosen detail rows and, marked, chosen names without detail."""
    detail, chosen, keys = _detail(spark, sf_dir), _chosen(spark, sf_dir), ["plan_id", "step", "name"]
    unknown = op.unknown_ui_args(detail, chosen, keys)
    return (
        op.select_ui_args(detail, chosen, keys)
        .withColumn("known", F.lit(True))
        .unionByName(unknown.withColumns({"value": F.lit(None).cast("string"), "known": F.lit(False)}))
    )


@query
def f8_diff_plans(spark, sf_dir):
    return op.diff_plans(views.params(spark, sf_dir, "base"), views.params(spark, sf_dir, "override"))


@query
def f9_merge_plan(spark, sf_dir):
    return op.merge_plan(views.params(spark, sf_dir, "base"), views.params(spark, sf_dir, "override"), "train")


# --- G: train and score ---------------------------------------------------------


def _priced(df, min_quantity):
    return df.filter(F.col("l_quantity") >= min_quantity).select(
        "l_returnflag",
        "l_linestatus",
        F.floor(F.col("l_extendedprice") * 100).alias("cents"),
        F.floor("l_quantity").alias("quantity"),
    )


def _totals(df, by):
    return df.groupBy(*by).agg(
        F.sum("cents").cast("bigint").alias("cents"),
        F.sum("quantity").cast("bigint").alias("quantity"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def _counting(df, args, config):
    """A step that also extends the config."""
    return df.withColumn("used", F.lit(config["used"])), {**config, "used": config["used"] + 1}


LINE_STEPS = [
    Step("input", plans.native_step(_priced), {"min_quantity": 10}),
    Step("total", plans.native_step(_totals), {"by": ["l_returnflag", "l_linestatus"]}),
    Step("mark", _counting),
    Step("mark_again", _counting),
]


@query
def g1_run_steps(spark, sf_dir):
    result, _ = plans.run_steps(table(spark, sf_dir, "lineitem"), LINE_STEPS, config={"used": 1})
    return result


@query
def g2_user_step(spark, sf_dir):
    """User code over pandas batches between native steps."""

    # Defined here, so that they travel to the executors by value.
    def discounted(frame: pd.DataFrame, percent: int) -> pd.Series:
        return (frame["l_discount"] * 100).round().ge(percent)

    def banded(frame: pd.DataFrame, width: int) -> pd.DataFrame:
        band = (frame["l_quantity"] // width).astype("int64")
        return pd.DataFrame({"l_returnflag": frame["l_returnflag"], "band": band})

    steps = [
        Step("cheap", plans.vector_step("cheap", discounted, "boolean", ["l_discount"]), {"percent": 5}),
        Step("keep", plans.native_step(lambda df: df.filter("cheap"))),
        Step("band", plans.pandas_step(banded, "l_returnflag string, band bigint"), {"width": 10}),
        Step(
            "count",
            plans.native_step(lambda df: df.groupBy("l_returnflag", "band").agg(F.count(F.lit(1)).alias("n_lines"))),
        ),
    ]
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    return plans.run_steps(lines, steps)[0]


@query
def g3_interface_mode(spark, sf_dir):
    """All steps with files between them, where the third one fails at first and the second run goes on there."""
    root, lines = scratch_dir(spark, "steps"), table(spark, sf_dir, "lineitem")

    def broken(data, args, config):
        raise RuntimeError("not now")

    at = 2
    failing = [*LINE_STEPS[:at], Step(LINE_STEPS[at].name, broken), *LINE_STEPS[at + 1 :]]
    try:
        plans.run_steps(lines, failing, config={"used": 1}, mode="file", root=root)
    except plans.StepError:
        result, _ = plans.run_steps(lines, LINE_STEPS, config={"used": 1}, mode="file", root=root)
    return result


X_COLUMNS, Y_COLUMN = ["l_quantity", "l_extendedprice", "l_discount", "l_linestatus"], "l_returnflag"


@query
def g4_select_xy(spark, sf_dir):
    return plans.select_xy(table(spark, sf_dir, "lineitem"), X_COLUMNS, Y_COLUMN)


HELD_OUT = "l_orderkey % 5 = 0"


MODELS: dict[tuple[str, str], str] = {}


def _fit(spark, sf_dir):
    """A forest of as many trees as the sample plan has, trained on the orders that are not held out."""
    path = scratch_dir(spark, "models")
    lines = table(spark, sf_dir, "lineitem").filter(f"NOT ({HELD_OUT})")
    model = plans.fit_step(lines, X_COLUMNS, Y_COLUMN, {"n_estimators": 100, "max_depth": 4}, path)
    MODELS[spark.sparkContext.applicationId, sf_dir] = path
    return model


def _model(spark, sf_dir) -> str:
    """Where the model lies that this session trained last on these tables; it is trained if there is none."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in MODELS:
        _fit(spark, sf_dir)
    return MODELS[key]


@query
def g5_fit_step(spark, sf_dir):
    """What SQL can say of the trained forest: its trees, classes, features and the sum of their importance."""
    model = _fit(spark, sf_dir)
    forest, labels = model.stages[-1], model.stages[-2].labels
    total = round(float(sum(forest.featureImportances.toArray())), 6)
    row = (forest.getNumTrees, ",".join(labels), forest.numFeatures, total)
    return spark.createDataFrame([row], "n_trees int, labels string, n_features int, importance double")


@query
def g5_importances(spark, sf_dir):
    """The importance of each feature of the saved model."""
    model = plans.load_model(_model(spark, sf_dir))
    shares = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(X_COLUMNS, shares, strict=True)), "feature string, importance double")


def _scored(spark, sf_dir) -> DataFrame:
    """The held-out lines with the class by the saved model and by its trees as expressions."""
    path = _model(spark, sf_dir)
    scored = plans.score_step(table(spark, sf_dir, "lineitem").filter(HELD_OUT), path)
    return plans.read_forest(spark, path).add_prediction(scored, "by_trees")


@query
def g6_score_step(spark, sf_dir):
    """Held-out lines with the saved model: per true class the lines, those for which its trees as expressions agree, and the probabilities."""
    total = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda s, p: s + p)
    return _scored(spark, sf_dir).groupBy(F.col(Y_COLUMN).alias("truth")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count(F.when(F.col("predicted") == F.col("by_trees"), 1)).alias("n_predicted"),
        F.round(F.avg(total), 6).alias("probability"),
    )


@query
def g6_classes(spark, sf_dir):
    """Held-out lines per true and predicted class."""
    return _scored(spark, sf_dir).groupBy(F.col(Y_COLUMN).alias("truth"), "predicted").agg(F.count(F.lit(1)).alias("n_lines"))


@query
def g7_summarize_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("run"))
    rated = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "run", F.concat_ws("/", text(F.col("quality")), text(F.col("toxic"))).alias("label")
    )
    return _as_text(plans.summarize_scores(rated, date="20240101"))


@query
def g8_pick_model(spark, sf_dir):
    runs = stored_runs(spark, sf_dir)
    inference = _inference_runs(runs).filter("wanted_train_id IS NOT NULL").select("folder", "wanted_train_id")
    train = runs.filter("ptype = 'train' AND has_record")
    return plans.pick_models(inference, train, "history/train")


# --- H: streaming ---------------------------------------------------------------


def _landed(df: DataFrame, label: str) -> str:
    """The rows as JSON files for a file stream."""
    path = scratch_dir(df.sparkSession, label)
    df.write.json(path)
    return path


def _sink(batches_to: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{batches_to}/batch_id={batch_id}")

    return write


def _drained(stream: DataFrame, label: str) -> DataFrame:
    spark = stream.sparkSession
    root = scratch_dir(spark, label)
    streaming.drain(
        stream.writeStream.foreachBatch(_sink(f"{root}/rows")).option("checkpointLocation", f"{root}/checkpoint")
    )
    return spark.read.schema(stream.schema).parquet(f"{root}/rows/batch_id=*")


def _requests(spark, sf_dir):
    return streaming.request_stream(spark, _landed(views.request_events(spark, sf_dir), "requests"))


@query
def h1_request_stream(spark, sf_dir):
    parsed = streaming.parse_requests(_requests(spark, sf_dir))
    return _drained(
        parsed.select(
            "request_id",
            "seq",
            "plan_id",
            "error_code",
            F.col("request.dataset_uri").alias("dataset_uri"),
            F.nullif(F.array_join("request.parameters.selected_user_parameters.step", ","), F.lit("")).alias("steps"),
        ),
        "h1",
    )


@query
def h1_queue_source(spark, sf_dir):
    """The requests through a queue of four partitions, put in by two producers: what each plan asks, in its order."""
    asked = views.request_events(spark, sf_dir).select(F.col("plan_id").cast("string").alias("key"), F.col("payload").alias("value"), "seq")
    root = scratch_dir(spark, "queue")
    half = F.expr("bigint(seq) < 500")
    sources.enqueue(asked.filter(half), root, ["seq"], 4)
    sources.enqueue(asked.filter(~half), root, ["seq"], 4)
    requests = streaming.queued_requests(sources.queue_stream(spark, root))
    parsed = streaming.parse_requests(requests).select("plan_id", "seq", "error_code", F.col("request.dataset_uri").alias("dataset_uri"))
    read = _drained(parsed, "h1-queue")
    place = F.row_number().over(Window.partitionBy("plan_id").orderBy("seq")).alias("place")
    return read.select("plan_id", place, "error_code", "dataset_uri")


def _number(column: str) -> F.Column:
    return F.coalesce(F.when(F.col(column).rlike("^[0-9]+$"), F.col(column).cast("bigint")), F.lit(0))


def _score(loaded: DataFrame) -> DataFrame:
    score = F.col("n_rows") * _number("view__k0") + _number("click__k3") * 10 + _number("view__k1")
    return loaded.withColumn("score", score).withColumn("result", F.when(score >= 200, "high").otherwise("low"))


def _served(spark, sf_dir, score=_score, artifacts=None) -> str:
    base = views.params(spark, sf_dir, "base").filter("pipeline = 'inference'").drop("pipeline")
    root = scratch_dir(spark, "serve")
    service = streaming.Service(
        base=base,
        datasets=views.datasets(spark, sf_dir),
        parameters=SERVED,
        score=score,
        summary=["score", "result"],
        root=root,
        artifacts=artifacts,
    )
    streaming.drain(streaming.serve(_requests(spark, sf_dir), service, f"{root}/checkpoint"))
    return root


@query
def h2_serve(spark, sf_dir):
    return streaming.read_channel(spark, _served(spark, sf_dir), SUMMARY_CHANNEL).select(
        "request_id", "status", "message"
    )


@query
def h3_result_sinks(spark, sf_dir):
    """Messages per channel, where some requests get no summary and some no artifacts, with the artifacts that were written.

    Every 11th score is no summary, every 7th has no artifacts, and every 5th has one that could not be made.
    """

    def score(loaded: DataFrame) -> DataFrame:
        return _score(loaded).withColumn("score", F.when(F.col("score") % 11 != 0, F.col("score")))

    def artifacts(answered: DataFrame) -> DataFrame:
        files = F.explode(F.sequence(F.lit(0), F.col("score") % 3)).alias("file")
        bad = F.when(F.col("score") % 5 == 0, "not made").alias("error")
        return answered.filter("score % 7 <> 0").select("request_id", files, F.col("dataset_uri").alias("content"), bad)

    root = _served(spark, sf_dir, score, artifacts)
    both = streaming.read_channel(spark, root, SUMMARY_CHANNEL).unionByName(
        streaming.read_channel(spark, root, ARTIFACTS_CHANNEL)
    )
    files = streaming.read_artifacts(spark, root).filter("error IS NULL").groupBy("request_id").agg(F.count(F.lit(1)).alias("n_files"))
    code = F.when(F.col("status") == "fail", F.col("message")).alias("code")
    return both.select("request_id", "channel", "status", code).join(files, "request_id", "left")


def _status_stream(spark, sf_dir):
    events = views.status_events(spark, sf_dir)
    return streaming.request_stream(spark, _landed(events, "status"), schema=events.schema)


@query
def h4_route_failures(spark, sf_dir):
    return _drained(streaming.route_failures(_status_stream(spark, sf_dir), message="code"), "h4")


@query
def h5_status_stream(spark, sf_dir):
    root = scratch_dir(spark, "h5")
    streaming.drain(streaming.status_stream(_status_stream(spark, sf_dir), f"{root}/status", f"{root}/checkpoint"))
    return streaming.current_status(spark, f"{root}/status")


@query
def h6_enrich_errors(spark, sf_dir):
    events = _status_stream(spark, sf_dir).select("request_id", "code")
    return _drained(streaming.enrich_errors(events), "h6")


# --- I: sinks -------------------------------------------------------------------


@query
def i1_write_output(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    path = op.write_output(lines, scratch_dir(spark, "i1"))
    return spark.read.schema(lines.schema).option("header", "true").csv(path)


@query
def i2_write_artifacts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    areas = {
        "output": lines.select("l_orderkey", "l_partkey", "l_suppkey"),
        "score": lines.groupBy("l_orderkey").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_suppkey").alias("l_suppkey")),
    }
    paths = op.write_artifacts(areas, scratch_dir(spark, "i2"), "inference", "run-1")
    parts = [spark.read.parquet(path).withColumn("area", F.lit(area)) for area, path in zip(areas, paths)]
    return parts[0].unionByName(parts[1])


@query
def i3_append_run(spark, sf_dir):
    records = views.runs(spark, sf_dir).select(
        "ptype", "start_time", "name", F.col("folder").contains("-error").alias("failed"), "k"
    )
    path = op.append_run(records, scratch_dir(spark, "ledger"), number=F.col("k") % 100_000_000)
    return spark.read.parquet(path).select("ptype", "id", "folder", "failed")


@query
def i4_replace_prefix(spark, sf_dir):
    """Publish all roles, publish the user role anew, then add a model area beside it."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("role").alias("name"),
        F.lit("v1").alias("version"),
        F.when(F.col("turn") % 2 == 0, "train").otherwise("inference").alias("pipeline"),
        F.lit("data").alias("area"),
        "conv_id",
        "turn",
    )
    root = scratch_dir(spark, "published")
    op.replace_prefix(turns, root)
    anew = turns.filter("name = 'user'").withColumn("turn", F.col("turn") + 100)
    op.replace_prefix(anew, root)
    op.replace_prefix(turns.filter("name = 'system'"), root, keep=True)
    return spark.read.parquet(root)


@query
def i5_apply_retention(spark, sf_dir):
    """Append the older half of the runs, trim, append the newer half, trim again: what is left of all."""
    runs = views.runs(spark, sf_dir).select(
        "ptype", "start_time", "name", F.col("folder").contains("-error").alias("failed"), "size_bytes", (F.col("k") % 100_000_000).alias("number"), "k"
    )
    ledger = scratch_dir(spark, "ledger")
    for half in (F.col("start_time") < RETENTION_HALF, F.col("start_time") >= RETENTION_HALF):
        op.append_run(runs.filter(half), ledger, number=F.col("number"))
        op.apply_retention(spark, ledger, RETENTION_LIMIT)
    return op.read_ledger(spark, ledger).select("ptype", "folder", "size_bytes")
