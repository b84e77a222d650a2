"""What the two classifiers share: a bounded labelled sample, features as rows, one fit, the model back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import stored

#: Documented bound of the labelled sample that a classifier is fitted on.
SAMPLE_ROWS = 12_000
#: Hashed features lie below this bound; a model never holds more weights.
DIMENSIONS = 1 << 22
_STEPS = 1 << 30

#: Called without arguments in each task, this makes the function from a text to its features.
Features = Callable[[], Callable[[str | None], tuple[np.ndarray, np.ndarray]]]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS, seed: int = 11) -> DataFrame:
    """doc_id, label, text of about `rows` labelled documents for which `learn` holds, chosen by a hash of the id.

    Rows without id or label teach nothing. Several labels of one document count as the largest, several
    texts of one document as the smallest. The chosen ids are bounded by `rows`, so they are broadcast.
    """
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(learn).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(_STEPS)) < int(share * _STEPS))
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit(sample: DataFrame, features: Features, learner: Callable[[np.ndarray, list], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Features are made in parallel; the bounded sample is then learnt in one task, in an order that the ids fix."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = features()
        for batch in batches:
            made = [of(t) for t in batch.column(1).to_pylist()]
            at = pa.array([i.astype("<u4").tobytes() for i, _ in made], pa.binary())
            values = pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), at, values], names=["key", "label", "at", "val"])

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        examples = [(np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for a, v in zip(group["at"], group["val"], strict=True)]
        model = learner(group["label"].to_numpy(float), examples)
        return pd.DataFrame({"name": list(model), "kind": [m.dtype.str for m in model.values()], "data": [m.tobytes() for m in model.values()]})

    prepared = sample.select(F.xxhash64(F.lit(5), "doc_id").alias("key"), "text", "label")
    made = stored(prepared.mapInArrow(rows, "key long, label int, at binary, val binary"), "examples")
    found = made.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "name string, kind string, data binary").collect()
    return {r["name"]: np.frombuffer(bytes(r["data"]), r["kind"]) for r in found}


def scorer(docs: DataFrame, model: dict[str, np.ndarray], judge_of: Callable) -> Callable[[Column], Column]:
    """A function of the text column; the model is bounded by DIMENSIONS and broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = judge_of(shared.value)
        for batch in texts:
            yield pd.Series([judge(t) for t in batch], dtype=float)

    return score


def logistic(margin: float) -> float:
    return 1 / (1 + np.exp(-min(max(margin, -30.0), 30.0)))


def places(known: np.ndarray) -> np.ndarray:
    """For each hashed feature its row in the model, or -1."""
    at = np.full(DIMENSIONS, -1, np.int32)
    at[known] = np.arange(len(known))
    return at
