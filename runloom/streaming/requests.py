"""Requests as a stream: envelope, payload, arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from runloom.functions.text import comma_list

REQUEST_ENVELOPE = "request_id bigint, seq bigint, plan_id bigint, ts timestamp, payload string"

STEPS = "array<struct<step: string, args: map<string,string>>>"
REQUEST_PAYLOAD = (
    "solution_metadata struct<metadata_version: string, pipeline: array<struct<"
    "type: string, "
    f"parameters: struct<selected_user_parameters: {STEPS}>, "
    "dataset_uri: string, artifact_uri: string, model_uri: string>>>"
)


# The same sections as maps, to tell a key that is null from one that is not there.
SECTION_KEYS = "solution_metadata struct<pipeline: array<map<string,string>>>"
PATHS = ("dataset_uri", "artifact_uri", "model_uri")


def request_stream(
    spark: SparkSession, source: str, fmt: str = "json", max_files: int | None = None, schema: str = REQUEST_ENVELOPE
) -> DataFrame:
    """An endless stream of requests below ``source``.

    ``seq`` is the order in which the producer queued the requests. ``max_files``
    bounds a micro-batch.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.load(source)


def queued_requests(records: DataFrame) -> DataFrame:
    """The request columns of records from a partitioned queue source.

    The record key is the plan, so all requests of a plan stand in one partition
    and ``offset`` is their order. Partition and offset identify a request.
    """
    place = F.shiftleft(F.col("partition").cast("bigint"), 48)
    return records.select(
        place.bitwiseOR(F.col("offset")).alias("request_id"),
        F.col("offset").alias("seq"),
        F.col("key").cast("string").try_cast("bigint").alias("plan_id"),
        F.col("timestamp").alias("ts"),
        F.col("value").cast("string").alias("payload"),
    )


def parse_requests(requests: DataFrame, ptype: str = "inference") -> DataFrame:
    """Add ``request``, the part of the payload for one run type, and ``error_code``.

    Every pipeline section of the type counts, one after the other: steps are joined, and a path
    that several sections name is that of the last one. A payload that cannot be read or has no
    pipeline section gets E111, one whose dataset is null or empty E122. A dataset that no section
    names is NULL without an error: the plan's last one holds. A bad request is a row like any other, so
    it cannot stop the stream.
    """
    def of_type(sections: str) -> Column:
        return F.filter(sections, lambda section: section["type"] == ptype)

    def last_named(name: str) -> Column:
        holders = F.filter("_keys", lambda section: F.map_contains_key(section, name))
        return F.try_element_at(F.try_element_at(holders, F.lit(-1)), F.lit(name))

    # Columns of their own, so that a payload is parsed once for each of the two and not once for each use.
    sections, named = F.from_json("payload", REQUEST_PAYLOAD), F.from_json("payload", SECTION_KEYS)
    read = requests.withColumns({"_sections": sections["solution_metadata"]["pipeline"], "_keys": named["solution_metadata"]["pipeline"]})
    steps = F.transform(of_type("_sections"), lambda section: F.coalesce(section["parameters"]["selected_user_parameters"], F.array().cast(STEPS)))
    read = read.select(*requests.columns, F.flatten(steps).alias("_steps"), of_type("_keys").alias("_keys"), F.col("_sections").isNotNull().alias("_readable"))
    request = F.struct(F.struct(F.col("_steps").alias("selected_user_parameters")).alias("parameters"), *[last_named(name).alias(name) for name in PATHS])
    parsed = read.withColumns({"request": request, "_named": F.exists("_keys", lambda section: F.map_contains_key(section, "dataset_uri"))})
    unset = F.col("_named") & (F.coalesce(F.col("request.dataset_uri"), F.lit("")) == "")
    coded = parsed.withColumn("error_code", F.when(~F.col("_readable"), "E111").when(unset, "E122"))
    return coded.drop("_steps", "_keys", "_readable", "_named")


def clean_argument(value: Column) -> Column:
    """An argument as text: lists by comma, NULL if it is empty."""
    items = F.from_json(value, "array<string>")
    text = F.when(value.startswith("["), F.array_join(items, ",")).when(value != "{}", value)
    return F.when(text != "", F.array_join(comma_list(text), ","))


def request_arguments(step: str, name: str) -> Column:
    """The cleaned argument that a request sets for one parameter, the last mention wins."""
    chosen = F.col("request.parameters.selected_user_parameters")
    values = F.transform(
        F.filter(chosen, lambda part: part["step"] == step),
        lambda part: clean_argument(F.try_element_at(part["args"], F.lit(name))),
    )
    return F.try_element_at(F.filter(values, lambda value: value.isNotNull()), F.lit(-1))


def drain(writer: DataStreamWriter) -> StreamingQuery:
    """Run a streaming query over all that is there, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
