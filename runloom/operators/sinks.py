"""Writers for outputs, artifacts, the run ledger and published prefixes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from runloom.constants import ARTIFACT_AREAS

LEDGER_PARTITIONS = ("ptype", "month")
# A folder begins with its start time, so its first digits are the month.
MONTH_DIGITS = 6
PREFIX_COLUMNS = ("name", "version", "pipeline", "area")


def balanced(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Gather rows by partition value for fewer files; adaptive execution splits the large ones."""
    return df.hint("rebalance", *columns)


def write_output(df: DataFrame, path: str) -> str:
    """A tabular result as csv parts with headers."""
    df.write.mode("overwrite").option("header", "true").csv(path)
    return path


def write_artifacts(
    areas: Mapping[str, DataFrame], target: str | None, ptype: str, run_id: str, codec: str = "gzip"
) -> list[str]:
    """Compressed artifacts, one sub-path per area; nothing is written without a target.

    ``models`` may stand for any run type, the other areas must belong to it.
    """
    if not target:
        return []
    unknown = set(areas) - {*ARTIFACT_AREAS[ptype], "models"}
    if unknown:
        raise ValueError(f"{ptype} runs have no such areas: {sorted(unknown)}")
    written = []
    for area, df in areas.items():
        path = f"{target}/{ptype}/{area}/run_id={run_id}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        written.append(path)
    return written


def run_id(start_time: Column, number: Column, name: Column) -> Column:
    """start-NNNNNNNN-name."""
    return F.concat_ws("-", start_time, F.lpad(number.cast("string"), 8, "0"), name)


def append_run(records: DataFrame, ledger: str, number: Column | None = None) -> str:
    """Append run records to the ledger, partitioned by type and month, in the order of their folders.

    Folders begin with the start time, so a reader that bounds them skips months and, within a file, row
    groups.

    ``records`` has ptype, start_time, name and failed. The id ends in a random
    number unless one is given; the folder of a failed run ends in ``-error``.
    """
    drawn = number if number is not None else F.floor(F.rand() * 100_000_000).cast("bigint")
    rows = records.withColumn("id", run_id(F.col("start_time"), drawn, F.col("name"))).withColumn(
        "folder", F.concat("id", F.when(F.col("failed"), F.lit("-error")).otherwise(F.lit("")))
    )
    return write_ledger(rows, ledger, "append")


def write_ledger(rows: DataFrame, ledger: str, mode: str) -> str:
    """Write runs in the layout of the ledger; with ``overwrite`` only the partitions that the rows hold are replaced."""
    placed = rows.withColumn("month", F.substring("folder", 1, MONTH_DIGITS))
    ordered = balanced(placed, LEDGER_PARTITIONS).sortWithinPartitions(*LEDGER_PARTITIONS, "folder")
    ordered.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*LEDGER_PARTITIONS).parquet(ledger)
    return ledger


def read_ledger(spark: SparkSession, ledger: str, like: str | None = None) -> DataFrame:
    """The runs of a ledger. The month stays text, whatever it looks like.

    With ``like`` the columns are those of another ledger, for one that may have no rows.
    """
    fields = spark.read.parquet(like or ledger).schema.fields
    named = [StructField(f.name, StringType()) if f.name in LEDGER_PARTITIONS else f for f in fields]
    return spark.read.schema(StructType(named)).parquet(ledger)


def replace_prefix(df: DataFrame, root: str, keep: bool = False, columns: Sequence[str] = PREFIX_COLUMNS) -> str:
    """Replace the published content below the prefixes that ``df`` holds.

    Other prefixes stay. With ``keep`` the new content is added without a delete,
    as for a model next to artifacts.
    """
    writer = balanced(df, columns).write.partitionBy(*columns)
    if keep:
        writer.mode("append").parquet(root)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)
    return root
