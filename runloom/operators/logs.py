"""Ordered analysis of log lines.

Lines stand in a table with ``file`` and one or more order columns. ``chunk`` cuts a
file into pieces along that order; the default suits a line number, so that a piece
holds at most 2^16 lines.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.ordered import carry_forward
from runloom.functions.times import epoch_micros, parse_log_time

CHUNK_BITS = 16
SERVICE_CLASSES = {"USER": "USER", "SYS": "SYS"}


def _chunk(order: Sequence[str], chunk: Column | None) -> Column:
    return chunk if chunk is not None else F.shiftright(order[0], CHUNK_BITS)


def show_increments(
    lines: DataFrame,
    classes: Mapping[str, str],
    text: str = "text",
    order: Sequence[str] = ("line_no",),
    chunk: Column | None = None,
) -> DataFrame:
    """Lines that start with ``[SHOW``, with the seconds since the previous one of their class.

    ``classes`` maps a field of the line to its class, the first match wins; lines of no class are
    not timed. The
    first line of a class in a file has the increment 0.
    """
    classes = dict(classes)
    fields = F.split(text, r"\|")
    kind = F.lit(None).cast("string")
    for field, name in reversed(classes.items()):
        kind = F.when(F.array_contains(fields, field), name).otherwise(kind)
    shown = (
        lines.filter(F.col(text).startswith("[SHOW"))
        .select("file", *order, text, kind.alias("class"), epoch_micros(parse_log_time(F.try_element_at(fields, F.lit(2)))).alias("_at"))
        .filter("class IS NOT NULL")
    )
    timed = carry_forward(
        shown, ["file", "class"], order, _chunk(order, chunk), {"_before": F.col("_at")}, inclusive=False
    )
    seconds = (F.col("_at") - F.col("_before")) / F.lit(1e6)
    return timed.select("file", *order, "class", text, F.coalesce(seconds, F.lit(0.0)).alias("seconds"))


def error_tail(
    lines: DataFrame,
    message: str = "message",
    level: str = "level",
    order: Sequence[str] = ("line_no",),
    chunk: Column | None = None,
) -> DataFrame:
    """Every line from the first error of its file on; error lines carry the step named last.

    Takes parsed lines. A line is an error if its level is ERROR or its message
    holds ``[ERROR]``; a step is named by ``current step: <name>``.
    """
    said = F.coalesce(F.col(message), F.lit(""))
    is_error = F.coalesce(F.col(level) == "ERROR", F.lit(False)) | said.contains("[ERROR]")
    step = F.when(
        said.contains("current step"), F.regexp_replace(F.split_part(said, F.lit(":"), F.lit(2)), " ", "")
    )
    marked = lines.withColumn("is_error", is_error)
    read = carry_forward(
        marked,
        ["file"],
        order,
        _chunk(order, chunk),
        {"_step": step, "_started": F.when(F.col("is_error"), F.lit(True))},
    )
    return (
        read.filter(F.col("_started"))
        .withColumn("error_step", F.when(F.col("is_error"), F.coalesce("_step", F.lit(""))))
        .drop("_step", "_started")
    )
