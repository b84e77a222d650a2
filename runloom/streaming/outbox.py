"""What a batch of requests has reached, and scoring that gives errors as values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from runloom.session import exists, remove, touch

# Classes of error conditions that a row's values cause: data exceptions and errors raised by an expression.
DATA_ERRORS = ("22", "P0001")
# What Python code on an executor raises for want of memory, disk or network, whatever the row.
MACHINE_ERRORS = ("MemoryError", "OSError", "IOError", "ConnectionError", "BrokenPipeError", "TimeoutError", "EOFError")


def caused_by_a_row(error: BaseException) -> bool:
    """Whether a request is to blame for a failed job, by Spark's error condition; else the cluster is, or the service."""
    if not isinstance(error, PySparkException):
        return False
    state = error.getSqlState()
    if state:
        return state.startswith(DATA_ERRORS)
    if type(error).__name__ != "PythonException":
        return False
    raised = [line.split(":")[0].rsplit(".")[-1].strip() for line in str(error).splitlines() if line and not line[0].isspace()]
    return not any(name in MACHINE_ERRORS for name in raised)


def guarded(function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Callable[[DataFrame], DataFrame]:
    """A scoring from a function of pandas frames, with its errors as values.

    The function answers each frame with a frame of as many rows with the columns of ``schema``. If it raises, the
    frame is halved within its task until the rows that raise stand alone; these get the error in the column
    ``error``, which is NULL for all others. So a bad request costs a few more calls and no job. An error for want of
    memory or disk ends the task: it is not the rows' fault.
    """
    made = StructType.fromDDL(schema)
    kinds = to_arrow_schema(made)

    def answer(batch: pa.RecordBatch) -> list[tuple[pa.RecordBatch, str | None]]:
        try:
            found = pa.RecordBatch.from_pandas(function(batch.to_pandas())[made.names], kinds, preserve_index=False)
            if found.num_rows != batch.num_rows:
                raise ValueError(f"{found.num_rows} answers to {batch.num_rows} rows")
            return [(found, None)]
        except (MemoryError, OSError):
            raise
        except Exception as error:
            if batch.num_rows > 1:
                half = batch.num_rows // 2
                return answer(batch.slice(0, half)) + answer(batch.slice(half))
            return [(pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, f.type) for f in kinds], schema=kinds), f"{type(error).__name__}: {error}")]

    def transform(df: DataFrame) -> DataFrame:
        def apply(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                parts = answer(batch)
                found = pa.Table.from_batches([part for part, _ in parts]).combine_chunks()
                errors = [error for part, error in parts for _ in range(part.num_rows)]
                columns = [*batch.columns, *[c.combine_chunks() for c in found.columns], pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *made.names, "error"])

        return df.mapInArrow(apply, StructType([*df.schema.fields, *made.fields]).add("error", "string"))

    return transform


@dataclass(frozen=True)
class Outbox:
    """The steps of one batch, each a folder that is there whole or not at all.

    A batch that runs again goes on with the first step that is missing, so a message that was sent is not made
    anew. Steps named ``work/...`` are needed until the last step is done.
    """

    spark: SparkSession
    root: str
    batch_id: int

    def path(self, step: str) -> str:
        folder, _, name = step.partition("/")
        return f"{self.root}/{folder}/batch_id={self.batch_id}/{name}".rstrip("/")

    def done(self, step: str) -> bool:
        return exists(self.spark, f"{self.path(step)}/_SUCCESS")

    def close(self) -> None:
        remove(self.spark, self.path("work"))

    def step(self, step: str, rows: DataFrame, codec: str = "snappy") -> DataFrame:
        """The rows as the step has written them, now or before."""
        path = self.path(step)
        if not self.done(step):
            rows.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def isolated(self, step: str, rows: DataFrame, make: Callable[[DataFrame], DataFrame], failed: Callable[[DataFrame], DataFrame], codec: str = "snappy") -> DataFrame:
        """``make(rows)`` as a step, where a row that raises is ``failed(row)``.

        Only errors that a row causes count; any other one ends the batch, which then runs again. The rows are
        halved by the hash of their id until those that raise stand alone: two jobs per doubling of the batch. A
        scoring that is ``guarded`` or uses ``try_`` functions raises none of them.
        """
        if self.done(step):
            return self.spark.read.schema(make(rows).schema).parquet(f"{self.path(step)}/part*")
        place, written = F.xxhash64("request_id"), []

        def answer(some: DataFrame, name: str, depth: int) -> None:
            path = f"{self.path(step)}/{name}"
            try:
                made = make(some)
                made.write.mode("overwrite").option("compression", codec).parquet(path)
            except PySparkException as error:
                if not caused_by_a_row(error):
                    raise
                if depth < 64 and some.limit(2).count() > 1:
                    for bit in (0, 1):
                        answer(some.filter(F.shiftright(place, depth).bitwiseAND(F.lit(1)) == bit), f"{name}{bit}", depth + 1)
                    return
                made = failed(some)
                made.write.mode("overwrite").option("compression", codec).parquet(path)
            written.append(self.spark.read.schema(made.schema).parquet(path))

        remove(self.spark, self.path(step))
        answer(rows, "part", 0)
        found = reduce(DataFrame.unionByName, written)
        touch(self.spark, f"{self.path(step)}/_SUCCESS")
        return found
