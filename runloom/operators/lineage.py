"""Which train run an inference run used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.constants import EXTERNAL_MODEL_ID, NO_TRAIN_ID
from runloom.functions.ordered import carry_forward
from runloom.functions.times import epoch_seconds, parse_stamp
from runloom.operators.history import run_status


def link_train_run(
    inference: DataFrame,
    train: DataFrame,
    plan: str = "name",
    wanted: str = "wanted_train_id",
    external: str = "external_model",
) -> DataFrame:
    """Add the train run that each inference run used.

    An external model comes first, then an id that was asked for, then the last
    successful train run of the same plan that ended at or before the inference
    run, else ``none``.

    The answer depends only on plan and second, so both sides are reduced to one
    row per plan and second before any ordering. A window then sees the seconds of
    one plan in a slot of 4096 seconds, or the slots of one plan, however many runs
    there are.
    """
    second = epoch_seconds(parse_stamp(F.col("end_time")))
    trained = (
        train.filter(run_status() == "success")
        .groupBy(plan, second.alias("_second"))
        .agg(F.max(F.struct("folder", "id"))["id"].alias("_trained"))
    )
    asked = inference.withColumn("_second", second)
    moments = (
        trained.unionByName(
            asked.select(plan, "_second").distinct().withColumn("_trained", F.lit(None).cast("string"))
        )
        .groupBy(plan, "_second")
        .agg(F.max("_trained").alias("_trained"))
    )
    slot = F.shiftright("_second", 12)
    latest = carry_forward(moments, [plan], ["_second"], slot, {"_latest": F.col("_trained")}).drop("_trained")
    linked = asked.join(latest, [plan, "_second"], "left")
    train_id = (
        F.when(F.col(external), F.lit(EXTERNAL_MODEL_ID))
        .when(F.coalesce(F.col(wanted), F.lit("")) != "", F.col(wanted))
        .otherwise(F.coalesce("_latest", F.lit(NO_TRAIN_ID)))
    )
    return linked.withColumn("train_id", train_id).drop("_second", "_latest")
