"""Status and failure events."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runloom.constants import ERROR_CODES
from runloom.session import exists, prepare, remove

# The last status of a run, and after how many batches the changes are folded into the table.
ENDED = ("save",)
FOLD_EVERY = 16


def latest_status(events: DataFrame, run: str = "run", seq: str = "seq", status: str = "status") -> DataFrame:
    """The status with the highest sequence number per run; batch or stream."""
    return events.groupBy(run).agg(F.max_by(status, seq).alias(status), F.max(seq).alias(seq))


def status_stream(events: DataFrame, root: str, checkpoint: str, keep: str = "1 hour", ended: Sequence[str] = ENDED) -> DataStreamWriter:
    """Keep the latest status per run (run, seq, status); ``current_status`` is the table of it.

    What a run has reached is state only as long as the run goes on: it goes with a status that ends the run, or when
    nothing came for the time ``keep``. An older event that comes after that is passed on once more, and
    the table still takes the newest. Every batch writes what changed, and every ``FOLD_EVERY`` batches the changes are
    folded into the table.
    """
    spark, kind = prepare(events.sparkSession), events.schema["run"].dataType.simpleString()
    length = int(spark.sql(f"SELECT CAST(INTERVAL {keep} AS INTERVAL DAY TO SECOND) AS t").first()["t"].total_seconds() * 1000)
    ends = set(ended)

    def newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = None
        for frame in frames:
            at = frame["seq"].to_numpy().argmax()
            found = (int(frame["seq"].iloc[at]), frame["status"].iloc[at])
            best = found if best is None or found[0] > best[0] else best
        if best is not None and (not state.exists or best[0] > state.get[0]):
            yield pd.DataFrame({"run": [key[0]], "seq": [best[0]], "status": [best[1]]})
            if best[1] in ends:
                if state.exists:
                    state.remove()
                return
            state.update((best[0],))
        state.setTimeoutDuration(length)

    changes = (
        events.filter("seq IS NOT NULL")
        .select("run", F.col("seq").cast("bigint").alias("seq"), "status")
        .groupBy("run")
        .applyInPandasWithState(newest, f"run {kind}, seq bigint, status string", "seq bigint", "update", GroupStateTimeout.ProcessingTimeTimeout)
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/changes/batch_id={batch_id}")
        if batch_id % FOLD_EVERY == FOLD_EVERY - 1:
            fold_status(spark, root, batch_id)

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def fold_status(spark: SparkSession, root: str, batch_id: int) -> None:
    """Fold the changes up to this batch into the table, then drop them and the table before; may run again."""
    target = f"{root}/table/upto={batch_id}"
    if not exists(spark, f"{target}/_SUCCESS"):
        current_status(spark, root).write.mode("overwrite").parquet(target)
    remove(spark, f"{root}/table/upto={batch_id - FOLD_EVERY}")
    for number in range(batch_id - FOLD_EVERY + 1, batch_id + 1):
        remove(spark, f"{root}/changes/batch_id={number}")


def current_status(spark: SparkSession, root: str) -> DataFrame:
    """run, seq, status of every run: the table and at most ``FOLD_EVERY`` batches of changes."""
    held = [f"{root}/{name}" for name in ("table", "changes") if exists(spark, f"{root}/{name}")]
    return latest_status(spark.read.option("recursiveFileLookup", "true").parquet(*held))


def error_table(spark: SparkSession) -> DataFrame:
    """The fixed error codes with name and comment."""
    return spark.createDataFrame(ERROR_CODES, "code string, error_name string, comment string")


def enrich_errors(events: DataFrame, codes: DataFrame | None = None, code: str = "code") -> DataFrame:
    """Add name and comment of an error code; unknown codes keep NULL.

    The built-in table has 11 rows and is broadcast; a table of the caller is left to the optimizer.
    """
    table = F.broadcast(error_table(events.sparkSession)) if codes is None else codes
    return events.join(table.withColumnRenamed("code", code), code, "left")
