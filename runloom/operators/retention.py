"""Size-based retention of runs."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import UTC, datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from runloom.constants import RUN_TYPES
from runloom.functions.times import epoch_seconds, folder_stamp
from runloom.operators.sinks import LEDGER_PARTITIONS, MONTH_DIGITS, read_ledger, write_ledger
from runloom.session import exists, remove

GROUP = "ptype"
EXACT = "decimal(38,0)"
# Start times are first summed in slots of 4096 seconds.
SLOT_BITS = 12
# Where a trimming keeps what it has decided; readers skip names with an underscore.
PENDING = "_retention"


def retention_plan(runs: DataFrame, limit_bytes: int) -> DataFrame:
    """The runs to delete so that all runs together fit into ``limit_bytes``.

    The excess is shared between the run types by their size. Within a type the
    oldest runs go first, until the share is reached; equal start times go by the
    hash of the folder, then by folder. A run goes exactly if the older ones
    amount to less than the share. Runs without a valid start time count in the
    size but are never deleted. ``size * excess`` and ``older * total`` are
    compared as whole numbers.

    Runs are not sorted. The last run to go is found, per type, from sums per slot
    of about an hour, then per second within the border slot, then per hash bucket
    within the border second, then run by run within that bucket. Each step is a
    small job that returns one border row per run type, so at most two rows; the
    next one filters by it down to the scan. The result is a filter of ``runs``
    without any shuffle.
    """
    timed = _timed(runs)
    return timed.filter(_gone(_last_runs(timed, limit_bytes))).select(GROUP, "folder", "size_bytes")


def _timed(runs: DataFrame) -> DataFrame:
    second = epoch_seconds(folder_stamp(F.col("folder")))
    return runs.filter(F.col(GROUP).isin(*RUN_TYPES)).select(
        GROUP, "folder", "size_bytes", F.col("size_bytes").cast(EXACT).alias("_size"), second.alias("_second")
    )


def _last_runs(timed: DataFrame, limit_bytes: int) -> dict[str, tuple[int, str, str]]:
    """Per type the last run to go, as its second, the hash of its folder and its folder."""
    spot = F.sha2("folder", 256)
    border = _first_border(timed.withColumn("_level", F.shiftright("_second", SLOT_BITS)), limit_bytes)
    slots = {p: (row["_level"] << SLOT_BITS, (row["_level"] + 1) << SLOT_BITS) for p, row in border.items()}
    border = _next_border(timed.filter(_within(slots)), F.col("_second"), border)
    seconds = {p: row["_level"] for p, row in border.items()}
    tied = timed.filter(_within({p: (at, at + 1) for p, at in seconds.items()}))
    border = _next_border(tied, F.substring(spot, 1, 4), border)
    bucket = _per_type({p: F.substring(spot, 1, 4) == row["_level"] for p, row in border.items()})
    border = _next_border(tied.filter(bucket), F.struct(spot.alias("spot"), "folder"), border)
    return {p: (seconds[p], row["_level"]["spot"], row["_level"]["folder"]) for p, row in border.items()}


def _gone(last: Mapping[str, tuple[int, str, str]]) -> Column:
    """The condition of a run to delete, on its type, folder and ``_second``."""
    place = F.struct(F.sha2("folder", 256), "folder")
    up_to = {p: (F.col("_second") < at) | (place <= F.struct(F.lit(spot), F.lit(folder))) for p, (at, spot, folder) in last.items()}
    return _within({p: (None, at + 1) for p, (at, _, _) in last.items()}) & _per_type(up_to)


def _per_type(conditions: Mapping[str, Column]) -> Column:
    """The condition of the row's type; false where a type has none."""
    return reduce(or_, [(F.col(GROUP) == p) & condition for p, condition in conditions.items()], F.lit(False))


def _within(spans: Mapping[str, tuple[int | None, int]]) -> Column:
    """Start times of each type's span, from its begin to before its end.

    Folder names begin with the time in a form that sorts like it, so the widest
    bounds also hold for the names and prune the scan.
    """
    if not spans:
        return F.lit(False)
    second, begins = F.col("_second"), [begin for begin, _ in spans.values()]
    inside = {p: (second < end) if begin is None else second.between(begin, end - 1) for p, (begin, end) in spans.items()}
    named = F.col("folder") < _stamp(max(end for _, end in spans.values()))
    if None not in begins:
        named &= F.col("folder") >= _stamp(min(begins))
    return named & _per_type(inside)


def _stamp(second: int) -> str:
    return datetime.fromtimestamp(second, UTC).strftime("%Y%m%dT%H%M%SZ")


def _first_border(slots: DataFrame, limit_bytes: int) -> dict[str, Row]:
    """The border slot per type, with the total and the share; empty within the limit.

    One row per type and slot reaches the windows: the hours of the time span.
    """
    sums = slots.groupBy(GROUP, "_level").agg(F.sum("_size").cast(EXACT).alias("_size"))
    total = sums.agg(F.sum("_size")).first()[0] or 0
    if total <= limit_bytes:
        return {}
    per_type, limit = Window.partitionBy(GROUP), F.lit(limit_bytes).cast(EXACT)
    shared = (
        sums.withColumn("_total", F.lit(total).cast(EXACT))
        .withColumn("_share", (F.sum("_size").over(per_type).cast(EXACT) * (F.col("_total") - limit)).cast(EXACT))
        .withColumn("_older", _sum_before("_level"))
    )
    return _newest_below_share(shared.filter(F.col("_level").isNotNull()))


def _next_border(rows: DataFrame, level: Column, border: Mapping[str, Row]) -> dict[str, Row]:
    """The border value of a finer level within the border so far."""

    def known(name: str) -> Column:
        return F.coalesce(*[F.when(F.col(GROUP) == p, F.lit(row[name]).cast(EXACT)) for p, row in border.items()])

    if not border:
        return {}
    sums = rows.groupBy(GROUP, level.alias("_level")).agg(F.sum("_size").cast(EXACT).alias("_size"))
    found = sums.withColumn("_older", (known("_older") + _sum_before("_level")).cast(EXACT))
    return _newest_below_share(found.withColumns({"_total": known("_total"), "_share": known("_share")}))


def _sum_before(level: str) -> Column:
    """The size of all older values of a level within the type; no time is the newest."""
    before = Window.partitionBy(GROUP).orderBy(F.asc_nulls_last(level)).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_size").over(before).cast(EXACT), F.lit(0).cast(EXACT))


def _newest_below_share(sums: DataFrame) -> dict[str, Row]:
    """Per type, the newest row whose older ones amount to less than the share."""
    below = sums.filter((F.col("_older") * F.col("_total")).cast(EXACT) < F.col("_share"))
    newest = below.groupBy(GROUP).agg(
        F.max("_level").alias("_level"),
        *[F.max_by(name, "_level").alias(name) for name in ("_older", "_total", "_share")],
    )
    return {row[GROUP]: row for row in newest.collect()}


def apply_retention(spark: SparkSession, ledger: str, limit_bytes: int) -> str:
    """Trim the ledger at this path and return the path. It is the ledger that ``append_run`` writes, with ``size_bytes``.

    Newer partitions are not touched. Those whose runs all go are removed, and those that keep some, as the
    border month of a run type does, are written anew in the same layout, by Spark's dynamic partition overwrite.

    What stays of the latter is first written beside the ledger, and then, as its last step, which partitions go.
    A call that stops before that has changed nothing; one that stops later is finished by the next call. Until then a
    partition may be missing, so runs are appended and read between calls, not during one.
    """
    finish_retention(spark, ledger)
    runs = read_ledger(spark, ledger)
    timed = _timed(runs)
    last = _last_runs(timed, limit_bytes)
    if not last:
        return ledger
    newest = _stamp(max(at for at, _, _ in last.values()))[:MONTH_DIGITS]
    old = runs.filter(F.col(GROUP).isin(*last) & (F.col("month") <= newest)).withColumn("_second", epoch_seconds(folder_stamp(F.col("folder"))))
    gone = F.coalesce(_gone(last), F.lit(False))
    counts = old.groupBy(*LEDGER_PARTITIONS).agg(F.count_if(gone).alias("gone"), F.count_if(~gone).alias("kept")).filter("gone > 0")
    # One row per month and run type.
    touched = [(row["ptype"], row["month"], row["kept"]) for row in counts.collect()]
    mixed = [F.struct(F.lit(p), F.lit(month)) for p, month, kept in touched if kept]
    kept = old.filter(F.struct(*LEDGER_PARTITIONS).isin(*mixed) & ~gone) if mixed else old.limit(0)
    pending = f"{ledger}/{PENDING}"
    write_ledger(kept.drop("_second"), f"{pending}/rows", "overwrite")
    removed = [(p, month) for p, month, n in touched if not n]
    spark.createDataFrame(removed, "ptype string, month string").coalesce(1).write.mode("overwrite").json(f"{pending}/removed")
    return finish_retention(spark, ledger)


def finish_retention(spark: SparkSession, ledger: str) -> str:
    """Carry out a trimming that was decided, if there is one; each part of it may be done again."""
    pending = f"{ledger}/{PENDING}"
    if exists(spark, f"{pending}/removed/_SUCCESS"):
        rows = read_ledger(spark, f"{pending}/rows", like=ledger)
        write_ledger(rows, ledger, "overwrite")
        for row in spark.read.schema("ptype string, month string").json(f"{pending}/removed").collect():
            remove(spark, f"{ledger}/ptype={row['ptype']}/month={row['month']}")
    remove(spark, pending)
    return ledger
