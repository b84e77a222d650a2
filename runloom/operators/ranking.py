"""First and newest rows per key, and stage times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.times import epoch_micros

# Markers in requirement lines.
LINK_MARKER = "--index-url"
FORCE_MARKER = "--force-reinstall"

STAGES = ("setup", "load", "run", "save")


def requirement_key(line: Column) -> Column:
    """The package name of a requirement line without blanks and comment.

    The line is cut at its first ``<``, else ``>``, else ``=``; a left-over ``~``
    or ``!`` of the comparison goes too.
    """
    cut = F.lit(None).cast("string")
    for sign in ("=", ">", "<"):
        cut = F.when(line.contains(sign), F.substring_index(line, sign, 1)).otherwise(cut)
    return F.rtrim(F.coalesce(cut, line), F.lit("~!"))


def first_wins(requirements: DataFrame, step_no: str = "step_no", pos: str = "pos", line: str = "line") -> DataFrame:
    """One row per package, the earliest step and position wins; marker lines apart.

    ``section`` is ``package``, ``force-reinstall`` or ``link_install``. Comment and
    blank lines go. Marker lines are not compared by name, only an exact repeat
    within a step is dropped.
    """
    raw = F.col(line)
    bare = F.regexp_replace(F.replace(raw, F.lit(" "), F.lit("")), "#.*$", "")
    section = (
        F.when(raw.contains(LINK_MARKER), "link_install")
        .when(F.replace(raw, F.lit(" "), F.lit("")).contains(FORCE_MARKER), "force-reinstall")
        .otherwise("package")
    )
    # Packages compete by name over all steps, marker lines by their text within a step.
    rows = requirements.select(step_no, pos, raw.alias("_raw"), bare.alias("_bare"), section.alias("section"))
    is_package = F.col("section") == "package"
    competing = rows.filter(~is_package | (F.col("_bare") != "")).select(
        "section",
        F.when(is_package, requirement_key(F.col("_bare"))).otherwise(F.col("_raw")).alias("key"),
        F.when(~is_package, F.col(step_no)).alias("_within"),
        F.struct(step_no, pos, F.when(is_package, F.col("_bare")).otherwise(F.col("_raw")).alias("requirement")).alias("_row"),
    )
    return (
        competing.groupBy("section", "key", "_within")
        .agg(F.min("_row").alias("first"))
        .select("section", "key", f"first.{step_no}", f"first.{pos}", "first.requirement")
    )


def stage_durations(marks: DataFrame, key: str = "run", stage: str = "stage", time: str = "ts") -> DataFrame:
    """Seconds per stage and in total, rounded to 3 decimals.

    A mark is the end of its stage, ``start`` is the begin of the first one.
    """
    names = ("start", *STAGES)
    at = marks.groupBy(key).agg(
        *[F.max(F.when(F.col(stage) == name, epoch_micros(F.col(time)))).alias(f"_{name}") for name in names]
    )

    def seconds(begin: str, end: str) -> Column:
        # Rounded as whole milliseconds, so no binary fraction decides a tie.
        return F.floor((F.col(f"_{end}") - F.col(f"_{begin}") + 500) / 1000) / 1000

    spans = [seconds(begin, end).alias(f"{end}_seconds") for begin, end in zip(names, STAGES)]
    return at.select(key, *spans, seconds("start", "save").alias("total_seconds"))


def latest_by_key(files: DataFrame, model_name: str, by: Sequence[str] = (), path: str = "path") -> DataFrame:
    """The row with the largest key that holds ``model_name``, per group."""
    rest = [name for name in files.columns if name not in (*by, path)]
    return (
        files.filter(F.col(path).contains(model_name))
        .groupBy(*by)
        .agg(F.max(path).alias(path), *[F.max_by(name, path).alias(name) for name in rest])
        .filter(F.col(path).isNotNull())
    )
