"""Run records: one JSON document per run folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.constants import EMPTY_STAMP, NO_TRAIN_ID
from runloom.sources.files import list_folders, read_small

RUN_RECORD = (
    "data_id_description map<string,decimal(20,0)>, data_id string, param_id string, "
    "code_id_description map<string,decimal(20,0)>, code_id string, id string, "
    "start_time string, end_time string, train_id string"
)
RUN_SUMMARY = (
    "date string, file_path string, note string, probability map<string,double>, "
    "result string, score double, version string"
)

# Where a run folder keeps its record and, as JSON, its summary.
RECORD_PATH = "log/experimental_history.json"
SUMMARY_PATH = "score/run_summary.json"

def run_documents(spark: SparkSession, folders: DataFrame, schema: str, path: str) -> DataFrame:
    """The JSON documents at ``<folder>/<path>``, with their run folder. ``folders`` has path and folder.

    Only that place counts; other documents of a run are not its record.
    """
    found = read_small(folders, path, folders.count())
    document = F.from_json("content", schema).alias("document")
    named = found.select(_name(F.col("path")).alias("folder"), document)
    return named.select("document.*", "folder")


def run_folders(spark: SparkSession, root: str) -> DataFrame:
    """The run folders below ``root``, empty ones too: path and folder. A task lists them; the driver does not."""
    return list_folders(spark, root).select("path", _name(F.col("path")).alias("folder"))


def _name(path: Column) -> Column:
    """The name of a run folder, plain or a partition value."""
    return F.regexp_replace(F.substring_index(path, "/", -1), "^folder=", "")


def scan_run_records(
    spark: SparkSession,
    root: str,
    ptype: str,
    record_path: str = RECORD_PATH,
    extra_columns: str | None = None,
    folders: DataFrame | None = None,
) -> DataFrame:
    """All run folders below ``root`` with their records, one row per folder.

    A folder without a record gets empty ids and the empty time stamp, so that it sorts last; inference
    runs then have no train run. The folders are listed by a task and their records read by tasks, unless
    ``folders``, a table of their names, is given.
    """
    schema = RUN_RECORD + (f", {extra_columns}" if extra_columns else "")
    if folders is None:
        listed = run_folders(spark, root)
    else:
        listed = folders.select("folder").distinct().select(F.concat(F.lit(root.rstrip("/") + "/"), "folder").alias("path"), "folder")
    records = run_documents(spark, listed, schema, record_path)
    return fill_missing_records(listed.select("folder").join(records, "folder", "left"), ptype)


def scan_run_summaries(spark: SparkSession, root: str, summary_path: str = SUMMARY_PATH) -> DataFrame:
    """The summaries of the run folders below ``root`` that have one, kept as JSON."""
    return run_documents(spark, run_folders(spark, root), RUN_SUMMARY, summary_path)


def fill_missing_records(runs: DataFrame, ptype: str) -> DataFrame:
    """Sentinels for runs whose record is absent."""
    empty = {name: "" for name in ("data_id", "param_id", "code_id", "id")}
    empty |= {"start_time": EMPTY_STAMP, "end_time": EMPTY_STAMP}
    if ptype == "inference":
        empty["train_id"] = NO_TRAIN_ID
        return runs.fillna(empty)
    return runs.fillna(empty).drop("train_id")
