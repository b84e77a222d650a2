"""Data contracts: each returns verdicts or violations as rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.constants import (
    IMAGE_EXTENSIONS,
    OPTIONAL_PLAN_KEYS,
    PLAN_KEYS,
    TABLE_EXTENSIONS,
    UNCHECKED_PLAN_KEYS,
)
from runloom.functions.text import INT_PATTERN, as_float, comma_list, is_number

# Limits of texts and the form of a solution name.
BYTE_LIMIT = 5000
CHAR_LIMIT = 500
NAME_BYTE_LIMIT = 100
NAME_PATTERN = r"^[a-zA-Z0-9-]+$"
LOWER_NAME_PATTERN = r"^[a-z0-9-]+$"


def check_outputs(files: DataFrame, runs: DataFrame | None = None, run: str = "run", ext: str = "ext") -> DataFrame:
    """Per run: one table or image file, or one table and one image file.

    ``runs`` adds the runs without any file. Only counters are kept per run.
    """
    found = files.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.col(ext).isin(*TABLE_EXTENSIONS)).alias("_tables"),
        F.count_if(F.col(ext).isin(*IMAGE_EXTENSIONS)).alias("_images"),
    )
    if runs is not None:
        found = runs.select(run).distinct().join(found, run, "left").fillna(0, ["n_files", "_tables", "_images"])
    reason = (
        F.when(~F.col("n_files").isin(1, 2), "file count")
        .when((F.col("n_files") == 1) & (F.col("_tables") + F.col("_images") != 1), "extension")
        .when((F.col("n_files") == 2) & ((F.col("_tables") != 1) | (F.col("_images") != 1)), "pair")
        .otherwise("")
    )
    return found.select(run, "n_files", (reason == "").alias("ok"), reason.alias("reason"))


def check_summary(runs: DataFrame, summaries: DataFrame, key: str = "folder") -> DataFrame:
    """Runs without a summary."""
    return runs.join(summaries.select(key), key, "left_anti")


def check_keys(
    found: DataFrame,
    template: Iterable[str] = PLAN_KEYS,
    optional: Iterable[str] = OPTIONAL_PLAN_KEYS,
    plan: str = "plan_id",
    key: str = "key",
) -> DataFrame:
    """(plan, problem, key): keys that are missing, get a default, or are not allowed.

    ``found`` has one row per plan and key; a plan without keys has one row with a
    NULL key. A missing ``control:*`` key gets its default and is no error. The
    template is a fixed list, so it becomes one flag per key and not a join.
    """
    template = list(template)
    allowed = [*template, *optional]
    child = F.substring_index(key, ":", -1)
    known = F.col(key).isin(*allowed) | (F.col(key).contains(":") & child.isin(*UNCHECKED_PLAN_KEYS))
    # One row per plan and unknown key, with the template keys seen beside it; both branches read this one exchange.
    has = [f"_has_{i}" for i in range(len(template))]
    marked = (
        found.withColumn("_unknown", F.when(~known, F.col(key)))
        .groupBy(plan, "_unknown")
        .agg(
            *[F.coalesce(F.max(F.col(key) == name), F.lit(False)).alias(flag) for flag, name in zip(has, template)],
            F.max(F.col("_unknown").isNotNull()).alias("_is_unknown"),
        )
    )
    absent = F.filter(
        F.array(*[F.when(~F.col(flag), F.lit(name)) for flag, name in zip(has, template)]),
        lambda name: name.isNotNull(),
    )
    missing = (
        marked.groupBy(plan)
        .agg(*[F.max(flag).alias(flag) for flag in has])
        .select(plan, F.explode(absent).alias(key))
        .withColumn("problem", F.when(F.col(key).startswith("control:"), "defaulted").otherwise("missing"))
    )
    unknown = marked.filter("_is_unknown").select(
        plan, F.col("_unknown").alias(key), F.lit("not_allowed").alias("problem")
    )
    return missing.unionByName(unknown).select(plan, "problem", key)


def match_steps(params: DataFrame, sources: DataFrame, by: Sequence[str] = ("plan_id", "pipeline")) -> DataFrame:
    """Per pipeline of ``sources``: whether both tables name the same steps equally often.

    Sorted lists are equal exactly if every step has the same count on both sides,
    so counts are compared and no list is built.
    """
    by = list(by)
    sides = params.select(*by, "step", F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        sources.select(*by, "step", F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    counts = sides.groupBy(*by, "step").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    return (
        counts.groupBy(*by)
        .agg(
            F.sum("_a").alias("n_param_steps"),
            F.sum("_b").alias("n_source_steps"),
            F.count_if(F.col("_a") != F.col("_b")).alias("n_unmatched"),
        )
        .filter("n_source_steps > 0")
        .withColumn("matches", F.col("n_unmatched") == 0)
    )


def find_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_text(df: DataFrame, text: str, name: str | None = None, lower: bool = False) -> DataFrame:
    """Add bytes_ok, chars_ok and, for a name column, name_ok and name_bytes_ok."""
    checks = {
        "bytes_ok": F.octet_length(text) < BYTE_LIMIT,
        "chars_ok": F.char_length(text) < CHAR_LIMIT,
    }
    if name is not None:
        checks["name_ok"] = F.col(name).rlike(LOWER_NAME_PATTERN if lower else NAME_PATTERN)
        checks["name_bytes_ok"] = F.octet_length(name) <= NAME_BYTE_LIMIT
    return df.withColumns(checks)


def spec_violations() -> Column:
    """Broken rules of an argument specification, in rule order.

    Uses the columns type, selectable, default and range; NULL means the field is
    absent, except for default, where NULL and empty are the same.
    """
    kind = F.col("type")
    default = F.coalesce(F.col("default"), F.lit(""))
    selectable, limits = comma_list(F.col("selectable")), comma_list(F.col("range"))
    is_whole = lambda part: part.rlike(INT_PATTERN)
    rules = [
        ("default required", (default == "") & (kind != "string")),
        ("one default", (kind == "single_selection") & (default != "") & (F.size(comma_list(default)) != 1)),
        ("several defaults", (kind == "multi_selection") & (default != "") & (F.size(comma_list(default)) < 2)),
        ("several selectable", F.col("selectable").isNotNull() & (F.size(selectable) < 2)),
        ("two range ends", F.col("range").isNotNull() & (F.size(limits) != 2)),
        (
            "whole range",
            F.col("range").isNotNull() & kind.isin("string", "int") & ~F.forall(limits, is_whole),
        ),
        ("number range", F.col("range").isNotNull() & (kind == "float") & ~F.forall(limits, is_number)),
    ]
    return F.filter(
        F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(rule)) for rule, broken in rules]),
        lambda rule: rule.isNotNull(),
    )


def check_arg_specs(specs: DataFrame) -> DataFrame:
    """Add the broken rules of every argument specification."""
    return specs.withColumn("violations", spec_violations())


def check_enum(df: DataFrame, column: str, allowed: Iterable) -> DataFrame:
    """Rows whose value is not in the allowed set; NULL is not in any."""
    return df.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def check_registry(new: DataFrame, existing: DataFrame, name: str = "name") -> DataFrame:
    """Whether a name may be registered, and its next version.

    ``existing`` has one row per name and version text; versions that are not
    numbers do not count. A new name must be unknown, an update must be known.
    """
    newest = existing.groupBy(name).agg(F.max(as_float(F.col("version"))).alias("_newest"), F.lit(True).alias("_known"))
    known = F.coalesce("_known", F.lit(False))
    problem = (
        F.when(F.col("is_update") & ~known, "unknown name")
        .when(~F.col("is_update") & known, "name exists")
        .when(F.col("is_update") & F.col("_newest").isNull(), "no numeric version")
        .otherwise("")
    )
    version = F.when(problem != "", F.lit(None)).when(F.col("is_update"), F.floor("_newest") + 1).otherwise(F.lit(1))
    return new.join(newest, name, "left").select(
        *new.columns, problem.alias("problem"), version.cast("bigint").alias("next_version")
    )
