"""Ids of datasets, parameters and code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.constants import EMPTY_DATA_ID
from runloom.functions.hashing import content_hash64, digest_of_leaves, low64, ordered_digest, short_id


def file_hashes(files: DataFrame, content: str = "content") -> DataFrame:
    """Replace the content of every file by its 64-bit hash."""
    return files.withColumn("hash64", content_hash64(F.col(content))).drop(content)


def dataset_id(files: DataFrame, by: Sequence[str] = (), path: str = "path", hash64: str = "hash64") -> DataFrame:
    """One data id per group over the file hashes in path order, with the number of files.

    Without groups it is one id over all files, zeros if there are none. The hash of
    each file stays a row of ``files``; it is never gathered into a map.
    """
    return _named(ordered_digest(files, by, [path], F.col(hash64).cast("string")), by)


def ids_of_leaves(leaves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same from the leaves of the digest tree."""
    return _named(digest_of_leaves(leaves, by), by)


def _named(digest: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        return digest.select(*by, short_id(F.col("digest")).alias("data_id"), F.col("n_rows").alias("n_files"))
    return digest.agg(
        F.coalesce(F.max(short_id(F.col("digest"))), F.lit(EMPTY_DATA_ID)).alias("data_id"),
        F.coalesce(F.max("n_rows"), F.lit(0)).alias("n_files"),
    )


def param_id(params: DataFrame, plan: str = "plan_id") -> DataFrame:
    """One parameter id per plan over its ``step.name=value`` texts in step and name order.

    A parameter that is NULL counts as the text ``None``. Plans may span several
    pipelines; the pipeline then leads the text.
    """
    order = [name for name in ("pipeline", "step", "name") if name in params.columns]
    text = F.concat(F.concat_ws(".", *order), F.lit("="), F.coalesce(F.col("value"), F.lit("None")), F.lit("\n"))
    return ordered_digest(params, [plan], order, text).select(plan, short_id(F.col("digest")).alias("param_id"))


def group_digest(
    files: DataFrame, by: Sequence[str] = ("step",), path: str = "path", content: str = "content"
) -> DataFrame:
    """Per step, the low 64 bits of MD5 over the digests of its ``.py`` files in name order."""
    code = files.filter(F.col(path).endswith(".py")).select(*by, path, F.md5(content).alias("file_md5"))
    return ordered_digest(code, by, [path], F.col("file_md5"), "md5").select(
        *by, low64(F.col("digest")).alias("code_hash")
    )


def code_id(digests: DataFrame, by: Sequence[str] = (), order: Column | str = "step") -> DataFrame:
    """One code id per plan over its step digests in step order, with the digest of each step.

    ``order`` is the place of a step in its plan, where the table has one; else steps go by name.
    The id is the digest of the step digests joined in that order. A plan has few steps, so they
    are gathered as one map.
    """
    place = F.col(order) if isinstance(order, str) else order
    steps = F.sort_array(F.collect_list(F.struct(place.alias("at"), F.col("step"), F.col("code_hash"))))
    gathered = digests.groupBy(*by).agg(steps.alias("_steps")).filter(F.size("_steps") > 0)
    joined = F.array_join(F.transform("_steps", lambda s: s["code_hash"].cast("string")), "")
    return gathered.select(
        *by,
        short_id(F.md5(joined)).alias("code_id"),
        F.map_from_entries(F.transform("_steps", lambda s: F.struct(s["step"], s["code_hash"]))).alias("code_id_description"),
    )
