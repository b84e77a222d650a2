"""Results and failures of served requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.constants import ARTIFACTS_CHANNEL, SUMMARY_CHANNEL

CHANNELS = (SUMMARY_CHANNEL, ARTIFACTS_CHANNEL)
MESSAGE = "request_id bigint, channel string, status string, message string"


def route_failures(failures: DataFrame, state: str = "state", message: str = "message") -> DataFrame:
    """One fail message per channel that has not got a result yet.

    Before the summary both channels get it, after the summary only the artifacts
    channel, after the artifacts none.
    """
    open_channels = (
        F.when(F.col(state) == "init", F.array(*[F.lit(name) for name in CHANNELS]))
        .when(F.col(state) == "summary", F.array(F.lit(ARTIFACTS_CHANNEL)))
        .otherwise(F.array().cast("array<string>"))
    )
    return failures.select(
        "request_id",
        F.explode(open_channels).alias("channel"),
        F.lit("fail").alias("status"),
        F.col(message).alias("message"),
    )


def success_messages(answers: DataFrame, summary: Sequence[str]) -> DataFrame:
    """The message of each request that has a summary."""
    text = F.to_json(F.struct(*summary), {"ignoreNullFields": "false"})
    return answers.select("request_id", F.lit("success").alias("status"), text.alias("message"))


def read_channel(spark: SparkSession, root: str, channel: str) -> DataFrame:
    schema = MESSAGE.replace("channel string, ", "") + ", batch_id bigint"
    return spark.read.schema(schema).parquet(f"{root}/{channel}").withColumn("channel", F.lit(channel))


def progress(requests: DataFrame, root: str) -> DataFrame:
    """How far each request has got: ``init``, ``summary`` or ``artifacts``."""
    spark = requests.sparkSession
    reached = requests.select("request_id")
    for channel in CHANNELS:
        ids = read_channel(spark, root, channel).select("request_id", F.lit(True).alias(channel))
        reached = reached.join(ids, "request_id", "left")
    state = F.when(F.col(ARTIFACTS_CHANNEL), "artifacts").when(F.col(SUMMARY_CHANNEL), "summary").otherwise("init")
    return reached.select("request_id", state.alias("state"))
