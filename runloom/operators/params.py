"""Parameter tables: rows of (plan, pipeline, step, name, value)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.constants import CONTROL_DEFAULTS
from runloom.functions.text import comma_list, value_kind

STEP_KEYS = ("plan_id", "pipeline", "step")
PARAM_KEYS = (*STEP_KEYS, "name")


def flatten_params(plans: DataFrame, keys: Sequence[str] = ("plan_id", "pipeline")) -> DataFrame:
    """Nested plans to one row per parameter.

    ``steps`` is an array of (step, args map). A step without arguments stays as
    one row with a NULL name.
    """
    steps = plans.select(*keys, F.explode_outer("steps").alias("_step"))
    return steps.select(
        *keys, F.col("_step.step").alias("step"), F.explode_outer("_step.args").alias("name", "value")
    ).filter("step IS NOT NULL")


def fill_defaults(
    controls: DataFrame, plan: str = "plan_id", defaults: Mapping[str, str] = CONTROL_DEFAULTS
) -> DataFrame:
    """One row per plan and control key; a missing key gets its default.

    ``controls`` has rows (plan, key, value). A key that is there keeps its value,
    also NULL. A plan without control keys has one row with a NULL key.
    """
    # Texts are aggregated by sorting; rows are dealt out by plan first, so that no task sorts all that it has read.
    wide = controls.repartition(plan).groupBy(plan).agg(
        *[F.max(F.when(F.col("key") == key, F.struct(F.col("value").alias("v")))).alias(key) for key in defaults]
    )
    filled = F.array(
        *[
            F.struct(
                F.lit(key).alias("key"),
                F.when(F.col(key).isNull(), F.lit(default)).otherwise(F.col(f"{key}.v")).alias("value"),
                F.col(key).isNull().alias("defaulted"),
            )
            for key, default in defaults.items()
        ]
    )
    return wide.select(plan, F.inline(filled))


def clean_args(args: DataFrame, value: str = "value") -> DataFrame:
    """Drop empty values; a comma text becomes its trimmed parts, one part stays a scalar.

    Adds ``parts`` and ``is_list``.
    """
    kept = args.filter(F.col(value).isNotNull() & (F.col(value) != ""))
    parts = comma_list(F.col(value))
    return kept.withColumns({"parts": parts, "is_list": F.size(parts) > 1})


def cleaned_value(value: Column) -> Column:
    """The text of a cleaned value: its parts joined by comma, NULL if it is empty."""
    return F.when(value != "", F.array_join(comma_list(value), ","))


def overlay_params(base: DataFrame, override: DataFrame, keys: Sequence[str] = STEP_KEYS) -> DataFrame:
    """The base parameters with the cleaned override on top.

    The override wins and adds names. Steps that the base lacks are ignored, and so
    are steps whose base arguments are NULL, which is a base row with a NULL name.
    """
    keys = list(keys)
    names = [*keys, "name"]
    wanted = override.filter(F.col("name").isNotNull()).withColumn("_new", cleaned_value(F.col("value")))
    none = F.lit(None).cast("string")
    both = base.select(*names, "value", none.alias("_new"), F.lit(True).alias("_in_base")).unionByName(
        wanted.filter("_new IS NOT NULL").select(*names, none.alias("value"), "_new", F.lit(False).alias("_in_base"))
    )
    # One row per parameter; both branches below read this one exchange.
    merged = both.groupBy(*names).agg(
        F.max("value").alias("value"),
        F.max("_new").alias("_new"),
        F.max("_in_base").alias("_in_base"),
        F.max(F.col("_in_base") & F.col("name").isNotNull()).alias("_has_args"),
    )
    result = [
        *names,
        F.coalesce("_new", "value").alias("value"),
        F.when(F.col("_new").isNull(), "base").when(F.col("_in_base"), "override").otherwise("added").alias("origin"),
    ]
    with_args = merged.filter("_has_args").select(*keys).distinct()
    added = merged.filter("NOT _in_base").join(with_args, keys, "left_semi")
    return merged.filter("_in_base").unionByName(added).select(*result)


def overlay_paths(base: DataFrame, override: DataFrame, plan: str = "plan_id") -> DataFrame:
    """External paths with the override on top; a key that is there replaces even by NULL.

    Rows are (plan, pipeline, path_key, uri). ``override`` rows exist exactly for
    the keys it has. The model path is taken over only for inference. A NULL or
    empty inference dataset is flagged with its error code.
    """
    keys = [plan, "pipeline", "path_key"]
    usable = override.filter((F.col("path_key") != "model_uri") | (F.col("pipeline") == "inference")).select(
        *keys, F.col("uri").alias("_new"), F.lit(True).alias("_has")
    )
    uri = F.when(F.col("_has"), F.col("_new")).otherwise(F.col("uri"))
    unset = (F.col("path_key") == "dataset_uri") & (F.col("pipeline") == "inference") & F.coalesce("_has", F.lit(False))
    return base.join(usable, keys, "left").select(
        *keys, uri.alias("uri"), F.when(unset & (F.coalesce("_new", F.lit("")) == ""), "E122").alias("error_code")
    )


# Ranks grow with the set of values a kind can hold; 0 stands for boolean.
KIND_RANK = {"bool": 0, "int": 1, "float": 2, "string": 3}


def infer_types(params: DataFrame, by: Sequence[str] = ("step", "name"), value: str = "value") -> DataFrame:
    """The narrowest type that fits all values of a parameter, with the count per kind.

    boolean only if all values are boolean; boolean mixed with anything else is
    text. NULL fits every type.
    """
    kinds = params.withColumn("_kind", value_kind(F.col(value)))
    counts = kinds.groupBy(*by).agg(
        *[F.count_if(F.col("_kind") == kind).alias(f"n_{kind}") for kind in KIND_RANK],
        F.count("_kind").alias("_n"),
    )
    found = (
        F.when(F.col("_n") == 0, F.lit(None))
        .when(F.col("n_bool") == F.col("_n"), "bool")
        .when((F.col("n_string") > 0) | (F.col("n_bool") > 0), "string")
        .when(F.col("n_float") > 0, "float")
        .otherwise("int")
    )
    return counts.withColumn("type", found).drop("_n")


def select_ui_args(detail: DataFrame, chosen: DataFrame, keys: Sequence[str] = ("step", "name")) -> DataFrame:
    """Detail rows that the user chose."""
    return detail.join(chosen.select(*keys).distinct(), list(keys), "left_semi")


def unknown_ui_args(detail: DataFrame, chosen: DataFrame, keys: Sequence[str] = ("step", "name")) -> DataFrame:
    """Chosen names that have no detail."""
    return chosen.select(*keys).distinct().join(detail.select(*keys), list(keys), "left_anti")


def diff_plans(old: DataFrame, new: DataFrame, keys: Sequence[str] = PARAM_KEYS) -> DataFrame:
    """Parameters that were added, removed or changed, with old and new value."""
    keys = list(keys)
    left = old.select(*keys, F.col("value").alias("old_value"), F.lit(True).alias("_old"))
    right = new.select(*keys, F.col("value").alias("new_value"), F.lit(True).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    )
    return (
        left.join(right, keys, "full")
        .select(*keys, change.alias("change"), "old_value", "new_value")
        .filter("change IS NOT NULL")
    )


def merge_plan(old: DataFrame, new: DataFrame, pipeline: str = "all") -> DataFrame:
    """The old plan with the rows of one pipeline, or of all, replaced by the new ones."""
    if pipeline not in ("train", "inference", "all"):
        raise ValueError("pipeline must be one of train, inference, all")
    if pipeline == "all":
        return new
    return old.filter(F.col("pipeline") != pipeline).unionByName(new.filter(F.col("pipeline") == pipeline))
