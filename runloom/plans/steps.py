"""Steps of a run. A step maps a frame, its arguments and the shared config to a new frame and config."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runloom.constants import INTERFACE_MODES
from runloom.session import exists, scratch_dir

Config = Mapping[str, Any]
StepCode = Callable[[DataFrame, Mapping[str, Any], Config], "DataFrame | tuple[DataFrame, Config]"]


class StepError(RuntimeError):
    """A step failed; the run stops there."""


@dataclass(frozen=True)
class Step:
    name: str
    code: StepCode
    args: Mapping[str, Any] = field(default_factory=dict)


def run_steps(
    data: DataFrame,
    steps: Sequence[Step],
    names: str | Iterable[str] = "all",
    config: Config | None = None,
    mode: str = "memory",
    root: str | None = None,
) -> tuple[DataFrame, Config]:
    """Chain steps into one plan: all in plan order, one by name, or a list in its own order.

    Nothing is computed here in memory mode. Config is read-only for a step; a
    step that changes it returns a new mapping.

    With ``root`` in file mode the result and the config of each step stay below it, and a run of the same plan goes on
    behind the last step that is whole there. The config must then be what JSON can hold.
    """
    by_name = {step.name: step for step in steps}
    if len(by_name) < len(steps):
        raise ValueError("step names must differ")
    wanted = list(by_name) if names == "all" else [names] if isinstance(names, str) else list(names)
    unknown = [name for name in wanted if name not in by_name]
    if unknown:
        raise ValueError(f"unknown steps {unknown}, the plan has {list(by_name)}")

    shared: Config = MappingProxyType(dict(config or {}))
    for number, name in enumerate(wanted):
        step, place = by_name[name], f"{root}/{number:03}-{name}" if root and mode == "file" else None
        if place and (known := _finished(data.sparkSession, place)):
            data, shared = known
            continue
        try:
            result = step.code(data, MappingProxyType(dict(step.args or {})), shared)
            data, new_config = result if isinstance(result, tuple) else (result, shared)
            data = interface(data, mode, name, place)
        except Exception as error:
            raise StepError(f"step {name} failed: {error}") from error
        shared = MappingProxyType(dict(new_config))
        if place:
            said = data.sparkSession.createDataFrame([(json.dumps(dict(shared)), data.schema.json())], HANDOVER)
            said.coalesce(1).write.mode("overwrite").json(f"{place}/handover")
    return data, shared


# What a step hands over beside its rows.
HANDOVER = "config string, schema string"


def _finished(spark: SparkSession, place: str) -> tuple[DataFrame, Config] | None:
    """The rows and the config of a step that is whole: the config is written last."""
    if not exists(spark, f"{place}/handover/_SUCCESS"):
        return None
    said = spark.read.schema(HANDOVER).json(f"{place}/handover").first()
    rows = spark.read.schema(StructType.fromJson(json.loads(said["schema"]))).parquet(f"{place}/rows")
    return rows, MappingProxyType(json.loads(said["config"]))


def interface(data: DataFrame, mode: str, label: str = "step", place: str | None = None) -> DataFrame:
    """Hand a frame to the next step: as a plan, or written and read back.

    ``file`` cuts the lineage and survives lost executors; the files go to the
    shared scratch folder, or to ``place``.
    """
    if mode not in INTERFACE_MODES:
        raise ValueError(f"mode must be one of {INTERFACE_MODES}")
    if mode == "memory":
        return data
    spark = data.sparkSession
    path = f"{place}/rows" if place else scratch_dir(spark, f"interface-{label}")
    data.write.mode("overwrite").parquet(path)
    return spark.read.schema(data.schema).parquet(path)


def native_step(transform: Callable[..., DataFrame]) -> StepCode:
    """A step from a function of (frame, **args) built of DataFrame operations; the first choice."""
    return lambda data, args, config: data.transform(lambda frame: transform(frame, **args))


def vector_step(
    column: str, function: Callable[..., pd.Series], return_type: str, inputs: Sequence[str]
) -> StepCode:
    """A step that adds a column from a function of (frame of the inputs, **args), run on Arrow batches."""

    def code(data: DataFrame, args: Mapping[str, Any], config: Config) -> DataFrame:
        fixed = dict(args)

        def batch(frame: pd.DataFrame) -> pd.Series:
            return function(frame, **fixed)

        return data.withColumn(column, F.pandas_udf(batch, return_type)(F.struct(*inputs)))

    return code


def pandas_step(function: Callable[..., pd.DataFrame], schema: StructType | str) -> StepCode:
    """A step from a function of (batch, **args) over pandas batches, whatever batches Spark forms.

    The function must not depend on which rows share a batch.
    """

    def code(data: DataFrame, args: Mapping[str, Any], config: Config) -> DataFrame:
        fixed = dict(args)

        def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield function(frame, **fixed)

        return data.mapInPandas(batches, schema)

    return code
