"""The history of runs as one table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.constants import HISTORY_COLUMNS, HISTORY_DROPPED
from runloom.functions.ordered import with_rank
from runloom.functions.times import display_stamp

SUMMARY_TEXTS = ("date", "file_path", "note", "result", "version")


def attach_summary(runs: DataFrame, summaries: DataFrame, key: str = "folder") -> DataFrame:
    """Left join of runs and summaries; a run without a summary gets empty values.

    ``score`` and ``probability`` are typed, so "empty" is NULL and the empty map.
    """
    joined = runs.join(summaries, key, "left")
    filled = {name: F.coalesce(name, F.lit("")) for name in SUMMARY_TEXTS if name in summaries.columns}
    if "probability" in summaries.columns:
        filled["probability"] = F.coalesce(
            "probability", F.map_from_arrays(F.array(), F.array()).cast("map<string,double>")
        )
    return joined.withColumns(filled)


def parameter_columns(steps: Mapping[str, Sequence[str]]) -> list[tuple[str, str, str]]:
    """(step, name, column) for the chosen steps and their parameter names."""
    return [(step, name, f"{step}.{name}") for step, names in steps.items() for name in names]


def parameter_names(params: DataFrame, steps: Iterable[str], limit: int | None = None) -> dict[str, list[str]]:
    """The parameter names of the given steps over all plans.

    They become columns, so more than ``limit`` of them is an error; without one the
    session's own limit for pivots holds.
    """
    limit = int(params.sparkSession.conf.get("spark.sql.pivotMaxValues")) if limit is None else limit
    wanted = list(dict.fromkeys(steps))
    pairs = params.filter(F.col("step").isin(wanted) & F.col("name").isNotNull()).select("step", "name").distinct()
    found = pairs.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"the steps {wanted} have more than {limit} parameters; name the ones to show")
    return {step: sorted(row["name"] for row in found if row["step"] == step) for step in wanted}


def attach_params(
    runs: DataFrame,
    params: DataFrame,
    steps: Mapping[str, Sequence[str]],
    key: str = "folder",
    has_plan: str = "has_plan",
) -> DataFrame:
    """Turn the parameters of the chosen steps into columns named ``step.name``.

    The names come with the call, so one aggregation builds all columns. Runs
    without a plan of their own show ``none``; a parameter that the plan of a run
    does not have is NULL.
    """
    columns = parameter_columns(steps)
    if not columns:
        return runs
    wide = (
        params.filter(F.col("step").isin(*steps))
        .groupBy(key)
        .agg(
            *[
                F.max(F.when((F.col("step") == step) & (F.col("name") == name), F.col("value"))).alias(column)
                for step, name, column in columns
            ]
        )
    )
    kept = [F.col(f"`{name}`") for name in runs.columns]
    return runs.join(wide, key, "left").select(
        *kept,
        *[
            F.when(~F.col(has_plan), F.lit("none")).otherwise(F.col(f"`{column}`")).alias(column)
            for _, _, column in columns
        ],
    )


def run_status(folder: str = "folder"):
    """``error`` if the folder name holds ``-error``, else ``success``."""
    return F.when(F.col(folder).contains("-error"), "error").otherwise("success")


def shape_columns(df: DataFrame, ptype: str) -> DataFrame:
    """The fixed columns first, missing ones as NULL, all others after them in their order."""
    first = [*HISTORY_COLUMNS, *(["train_id"] if ptype == "inference" else [])]
    fixed = [F.col(name) if name in df.columns else F.lit(None).cast("string").alias(name) for name in first]
    rest = [F.col(f"`{name}`") for name in df.columns if name not in first and name not in HISTORY_DROPPED]
    return df.select(*fixed, *rest)


def display_times(df: DataFrame) -> DataFrame:
    """Start and end time in the form tables show."""
    return df.withColumns({name: display_stamp(F.col(name)) for name in ("start_time", "end_time")})


def filter_ids(df: DataFrame, data_id: str = "", param_id: str = "", code_id: str = "") -> DataFrame:
    """Keep the runs with the given ids; an empty id does not filter."""
    for name, wanted in (("data_id", data_id), ("param_id", param_id), ("code_id", code_id)):
        if wanted:
            df = df.filter(F.col(name) == wanted)
    return df


def sort_recent(df: DataFrame, end_time: str = "end_time", tie: str = "folder") -> DataFrame:
    """Newest end time first. Both text forms of a time sort like the time itself."""
    return df.orderBy(F.desc(end_time), F.asc(tie))


def rank_recent(df: DataFrame, end_time: str = "end_time", tie: str = "folder", rank: str = "rank") -> DataFrame:
    """The rows with their place in the order of ``sort_recent``, from 0."""
    return with_rank(df, [F.desc(end_time), F.asc(tie)], rank)


def missing_steps(params: DataFrame, steps: Iterable[str], plan: str = "plan_id") -> DataFrame:
    """(plan, step) for every wanted step that a plan does not have.

    One flag per wanted step and plan, so the state of a plan does not grow with
    its rows.
    """
    wanted = list(dict.fromkeys(steps))
    if not wanted:
        return params.select(plan, "step").limit(0)
    has = [F.max(F.col("step").eqNullSafe(step)).alias(f"_has_{i}") for i, step in enumerate(wanted)]
    missing = F.filter(
        F.array(*[F.when(~F.col(f"_has_{i}"), F.lit(step)) for i, step in enumerate(wanted)]),
        lambda step: step.isNotNull(),
    )
    return params.groupBy(plan).agg(*has).select(plan, F.explode(missing).alias("step"))


def check_steps(params: DataFrame, steps: Iterable[str], plan: str = "plan_id") -> None:
    """Raise if any plan lacks a wanted step."""
    found = missing_steps(params, steps, plan).limit(5).collect()
    if found:
        shown = ", ".join(f"{row[0]}: {row['step']}" for row in found)
        raise ValueError(f"plans without a wanted step, the first of them: {shown}")


def history(
    runs: DataFrame,
    summaries: DataFrame,
    params: DataFrame | None = None,
    steps: Mapping[str, Sequence[str]] | Iterable[str] | None = None,
    ptype: str = "train",
    data_id: str = "",
    param_id: str = "",
    code_id: str = "",
    summary_key: str = "folder",
    params_key: str = "folder",
    keep: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """All runs of one type as a table, newest first.

    ``steps`` chooses parameters to show: a mapping names them, a list of steps
    takes all parameters of these steps and raises if a plan lacks one of them. The
    type and id filters stand before the joins, so they reach the scan of the
    ledger. ``summary_key`` and ``params_key`` join summaries and parameters where
    they are not kept by folder. ``keep`` names ledger columns to show besides
    those of the record.
    """
    chosen = filter_ids(runs.filter(F.col("ptype") == ptype), data_id, param_id, code_id)
    table = attach_summary(chosen, summaries, key=summary_key)
    if steps and not isinstance(steps, Mapping):
        check_steps(params, steps, plan=params_key)
        steps = parameter_names(params, steps, limit)
    if steps:
        table = attach_params(table, params, steps, key=params_key)
    table = sort_recent(table.withColumn("status", run_status()))
    helpers = {"folder", "ptype", "has_plan", "has_record", summary_key, params_key} - set(keep)
    if ptype == "train":
        helpers.add("train_id")
    return display_times(shape_columns(table, ptype).drop(*helpers))
