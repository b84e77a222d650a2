"""Serve requests: overlay, load, run, save, batch by batch.

Two of Spark's stateful operators keep what outlives a batch, in RocksDB: the ids of all requests answered, and per plan
what its requests have set so far. A batch so costs the same however many came before it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runloom.constants import ARTIFACTS_CHANNEL, SUMMARY_CHANNEL
from runloom.functions.ordered import carry_forward
from runloom.operators.history import parameter_columns
from runloom.session import prepare
from runloom.streaming.outbox import Outbox
from runloom.streaming.requests import parse_requests, request_arguments
from runloom.streaming.results import route_failures, success_messages

CHUNK_BITS = 16
# Of plans in the state of a service. A checkpoint holds for one number only.
BUCKETS = 1 << 15
# Before all requests of a batch.
_FIRST = -(1 << 63)
# Folders of a batch: what it needs until it is done, and the artifacts it has written.
WORK, ARTIFACTS = "work", "artifacts"


@dataclass(frozen=True)
class Service:
    """What a request loop needs besides the requests.

    ``base`` has the plans' parameters as (plan_id, step, name, value), ``datasets``
    one row per ``dataset_uri``. ``parameters`` names the parameters that the
    scoring reads. ``score`` maps requests with dataset and parameter columns to a
    frame with the ``summary`` columns; where the first one is NULL there is no summary. A column ``error`` that is not
    NULL says that the run failed (see ``guarded``).

    ``artifacts`` maps the requests that have a summary to the rows of their artifacts, with ``request_id``; they are
    written compressed by ``codec``. A request that gets no row, or one whose ``error`` is not NULL, has no
    artifacts. Without ``artifacts`` there are none to write.
    """

    base: DataFrame
    datasets: DataFrame
    parameters: Mapping[str, Sequence[str]]
    score: Callable[[DataFrame], DataFrame]
    summary: Sequence[str]
    root: str
    artifacts: Callable[[DataFrame], DataFrame] | None = None
    codec: str = "gzip"

    @property
    def columns(self) -> list[str]:
        return [column_name(step, name) for step, name, _ in parameter_columns(self.parameters)]

    @property
    def carried(self) -> list[str]:
        """What a plan keeps from request to request: its parameters and the path of its dataset."""
        return [*self.columns, "dataset_uri"]

    @property
    def own(self) -> list[str]:
        return [f"_own_{name}" for name in self.carried]


def column_name(step: str, name: str) -> str:
    return f"{step}__{name}"


def serve(requests: DataFrame, service: Service, checkpoint: str) -> DataStreamWriter:
    """A streaming query that answers every request once, however late it comes.

    A request that is delivered again, with the same id, is dropped. The plans are read
    once, when the query is built. All requests of a batch are answered by the same
    few joins; what they need of plans and datasets is selected
    by their keys first, so a batch does not shuffle those tables.
    """
    spark = prepare(requests.sparkSession)
    plans = _plan_columns(service)
    plans.write.mode("overwrite").parquet(f"{service.root}/plans")
    stored = spark.read.schema(plans.schema).parquet(f"{service.root}/plans")
    rows = with_earlier(read_requests(requests.dropDuplicates(["request_id"]), service), service)
    return rows.writeStream.foreachBatch(lambda batch, batch_id: serve_batch(batch, batch_id, service, stored)).option(
        "checkpointLocation", checkpoint
    )


def read_requests(requests: DataFrame, service: Service) -> DataFrame:
    """The requests with what each sets itself."""
    own = [request_arguments(step, name).alias(f"_own_{column_name(step, name)}") for step, name, _ in parameter_columns(service.parameters)]
    return parse_requests(requests).select(
        "request_id", "seq", "plan_id", "error_code", F.nullif(F.col("request.dataset_uri"), F.lit("")).alias("_own_dataset_uri"), *own
    )


def with_earlier(rows: DataFrame, service: Service) -> DataFrame:
    """The rows of a stream, and before those of each plan one with what earlier batches set for it (``is_state``).

    The state of a plan is the newest value of each thing it keeps. Plans are kept in ``BUCKETS`` by their hash, since a call per
    plan takes longer than its rows where a batch has very many plans. Rows pass in pieces, so that a plan with very many
    requests takes no more memory than others. Whole numbers pass as text, since pandas has no nulls among them.
    """
    own = service.own

    def remember(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = {plan: values for plan, *values in json.loads(state.get[0])} if state.exists else {}
        newest: dict[str | None, list[tuple]] = {}
        for frame in frames:
            met = []
            for plan, seq, code, *given in zip(*(frame[name] for name in ("plan_id", "seq", "error_code", *own)), strict=True):
                plan = plan if isinstance(plan, str) else None
                if plan not in newest:
                    before = kept.get(plan, [None] * len(own))
                    met.append([True, None, None, plan, None, *before])
                    newest[plan] = [(_FIRST - 1, value) for value in before]
                if code == "E111":
                    continue
                found, at = newest[plan], int(seq) if isinstance(seq, str) else _FIRST
                for k, value in enumerate(given):
                    if isinstance(value, str) and at > found[k][0]:
                        found[k] = at, value
            if met:
                yield pd.DataFrame(met, columns=names, dtype=object)
            frame.insert(0, "is_state", False)
            yield frame[names]
        kept |= {plan: [value for _, value in found] for plan, found in newest.items()}
        state.update((json.dumps([[plan, *values] for plan, values in kept.items() if any(v is not None for v in values)]),))

    texts = ["request_id", "seq", "plan_id", "error_code", *own]
    names = ["is_state", *texts]
    as_text = rows.select(*[F.col(name).cast("string") for name in texts]).withColumn("_bucket", F.pmod(F.xxhash64("plan_id"), F.lit(BUCKETS)))
    passed = as_text.groupBy("_bucket").applyInPandasWithState(
        remember, "is_state boolean, " + ", ".join(f"`{n}` string" for n in texts), "kept string", "append", GroupStateTimeout.NoTimeout
    )
    return passed.select("is_state", *[F.col(name).cast(rows.schema[name].dataType) for name in texts])


def serve_batch(batch: DataFrame, batch_id: int, service: Service, plans: DataFrame) -> None:
    """Answer the requests of one batch in steps; one that runs again goes on where it stopped.

    Summaries go to the first channel, then artifacts are written, then the second channel tells of them. What
    fails before its summary fails in both channels, what fails after it only in the second.

    The requests are written first. All else reads them back in the session
    of the service, where adaptive execution is on; a stream's own session, which
    keeps state, has it off.
    """
    spark = plans.sparkSession
    outbox = Outbox(spark, service.root, batch_id)
    if outbox.done(ARTIFACTS_CHANNEL):
        outbox.close()
        return
    rows = outbox.step(f"{WORK}/requests", batch)
    requests = rows.filter("NOT is_state").drop("is_state")
    state = rows.filter("is_state").select("plan_id", *[F.col(f"_own_{name}").alias(name) for name in service.carried])
    answered = _answered(requests, state, plans, service, outbox)
    failed = F.col("error_code").isNotNull()
    early = route_failures(answered.filter(failed).select("request_id", F.lit("init").alias("state"), "error_code"), message="error_code")
    summaries = success_messages(answered.filter(~failed), service.summary)
    columns = ["request_id", "status", "message"]
    # The files of a channel follow the size of the batch.
    to = lambda channel, sent, *failures: sent.select(*columns).unionByName(
        _union([f.filter(F.col("channel") == channel).select(*columns) for f in failures])
    ).hint("rebalance")
    sent = outbox.step(SUMMARY_CHANNEL, to(SUMMARY_CHANNEL, summaries, early))
    if service.artifacts is None:
        outbox.step(ARTIFACTS_CHANNEL, sent)
    else:
        saved = _saved(answered.filter(~failed), service, outbox)
        late = summaries.join(saved, "request_id", "left_anti").select("request_id", F.lit("summary").alias("state"), F.lit("E162").alias("message"))
        outbox.step(ARTIFACTS_CHANNEL, to(ARTIFACTS_CHANNEL, summaries.join(saved, "request_id", "left_semi"), early, route_failures(late)))
    outbox.close()


def read_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """The artifacts of all batches."""
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/{ARTIFACTS}")


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    first, *others = frames
    for other in others:
        first = first.unionByName(other)
    return first


def _answered(requests: DataFrame, state: DataFrame, plans: DataFrame, service: Service, outbox: Outbox) -> DataFrame:
    """The requests with error_code and the columns of the scoring, summaries among them."""
    # Parameters of a request count even if its dataset is unset.
    readable = requests.filter("error_code IS NULL OR error_code <> 'E111'")
    effective = _with_parameters(readable, state, plans, service)
    unread = requests.filter("error_code = 'E111'").select("request_id", "error_code")

    def make(rows: DataFrame) -> DataFrame:
        return _verdict(service.score(_loaded(rows, service)), service)

    def failed(rows: DataFrame) -> DataFrame:
        code = F.coalesce("error_code", F.lit("E152"))
        return make(rows.limit(0)).unionByName(rows.select("request_id", code.alias("error_code")), allowMissingColumns=True)

    scored = outbox.isolated(f"{WORK}/answers", effective, make, failed)
    return scored.unionByName(unread, allowMissingColumns=True)


def _saved(answered: DataFrame, service: Service, outbox: Outbox) -> DataFrame:
    """The ids of requests whose artifacts are written."""

    def make(rows: DataFrame) -> DataFrame:
        made = service.artifacts(rows)
        return made if "error" in made.columns else made.withColumn("error", F.lit(None).cast("string"))

    def failed(rows: DataFrame) -> DataFrame:
        return make(rows.limit(0)).unionByName(rows.select("request_id", F.lit("raised").alias("error")), allowMissingColumns=True)

    written = outbox.isolated(ARTIFACTS, answered, make, failed, service.codec)
    return written.groupBy("request_id").agg(F.max(F.col("error").isNotNull()).alias("bad")).filter("NOT bad").select("request_id")


def _needed(table: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """The rows of a table whose key occurs in the requests."""
    return table.join(requests.select(key).distinct(), key, "left_semi")


def _loaded(effective: DataFrame, service: Service) -> DataFrame:
    """The requests with the columns of their dataset."""
    datasets = _needed(service.datasets.withColumn("_loaded", F.lit(True)), effective, "dataset_uri")
    return effective.join(datasets, "dataset_uri", "left")


def _verdict(scored: DataFrame, service: Service) -> DataFrame:
    raised = F.col("error").isNotNull() if "error" in scored.columns else F.lit(False)
    verdict = (
        F.when(F.col("error_code").isNotNull(), F.col("error_code"))
        .when(F.col("_loaded").isNull(), "E141")
        .when(raised, "E152")
        .when(F.col(service.summary[0]).isNull(), "E161")
    )
    return scored.withColumn("error_code", verdict).drop("_loaded")


def _plan_columns(service: Service) -> DataFrame:
    """One row per plan: the base value of every served parameter, and which steps have arguments."""
    served = service.base.filter(F.col("step").isin(*service.parameters) & F.col("name").isNotNull())
    values = [
        F.max(F.when((F.col("step") == step) & (F.col("name") == name), F.col("value"))).alias(
            f"_base_{column_name(step, name)}"
        )
        for step, name, _ in parameter_columns(service.parameters)
    ]
    steps = [F.max(F.col("step") == step).alias(f"_has_{step}") for step in service.parameters]
    return served.groupBy("plan_id").agg(*values, *steps)


def _with_parameters(requests: DataFrame, state: DataFrame | None, plans: DataFrame, service: Service) -> DataFrame:
    """Each request with the plan's parameters as they stand after it and all before it."""
    own = {name: F.col(f"_own_{name}") for name in service.carried}
    overlaid = carry_forward(requests, ["plan_id"], ["seq"], F.shiftright("seq", CHUNK_BITS), own, start=state)
    joined = overlaid.join(_needed(plans, requests, "plan_id"), "plan_id", "left")
    values = {}
    for step, name, _ in parameter_columns(service.parameters):
        column = column_name(step, name)
        values[column] = F.when(F.col(f"_has_{step}"), F.coalesce(column, f"_base_{column}"))
    unset = F.col("dataset_uri").isNull() & F.col("error_code").isNull()
    values["error_code"] = F.when(unset, "E122").otherwise(F.col("error_code"))
    return joined.withColumns(values).drop(*[name for name in plans.columns if name != "plan_id"])
