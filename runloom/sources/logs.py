"""Process logs: text lines to typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions.times import parse_log_time

# Fixed values: [time|service|level|file(line)|func()] message
LOG_LINE = r"^\[[^|]*\|[^|]*\|[^|]*\|[^|(]*\(\d+\)\|[^|]*\(\)\]"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The lines of log files with their file and place.

    Within a file, lines are ordered by ``(block_start, scan_order)``. Only the
    order inside a block depends on the scan, so a block is also the natural chunk
    for the ordered operators.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("scan_order"),
        F.col("value").alias("text"),
    )


def parse_log(lines: DataFrame, text: str = "text") -> DataFrame:
    """Add ts, service, level, source, source_line, func and message; NULL where a line has another form.

    The form is matched and the line is split once, however many columns are used.
    """
    split = lines.withColumn("_parts", F.when(F.col(text).rlike(LOG_LINE), F.split(text, r"\|", 5)))
    first, place, rest = F.col("_parts")[0], F.col("_parts")[3], F.col("_parts")[4]
    end = F.lit("()]")
    return split.withColumns(
        {
            "ts": parse_log_time(F.substring(first, 2, 40)),
            "service": F.col("_parts")[1],
            "level": F.col("_parts")[2],
            "source": F.substring_index(place, "(", 1),
            "source_line": F.substring_index(F.substring_index(place, "(", -1), ")", 1).cast("int"),
            "func": F.split_part(rest, end, F.lit(1)),
            "message": F.regexp_replace(F.substr(rest, F.locate("()]", rest) + 3), "^ ", ""),
        }
    ).drop("_parts")
