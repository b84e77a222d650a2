"""A corpus from raw documents to token digests, as stages that each call one operator.

quality rules -> toxicity -> n-gram Jaccard join -> mixing sources -> BPE. Each stage works on all that the one
before it kept; its result is written as Parquet and read again as the next one's documents. All but the last
return the columns of the documents.

Defined results: null and empty texts have too few words, so the first stage rejects them. Documents without an id go
through all stages; in a group of near copies one with an id stays if there is one. Rows that repeat an id and its text
count as one document for the join, and the mix may repeat any row. Null sources are a source. Texts of any length are read whole.
The stages hand on the texts as they are: lines that a rule removes decide about the document only, since the
documents of a stage are those of the one before it. Columns keep their names, whatever they are. Without rows every
stage returns none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runloom.llm import bpe, mixing, ngram_join, quality_rules, toxicity
from runloom.llm.common import ship, stored, table
from runloom.llm.queries import tokenizer_path
from runloom.session import prepare


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules reject go; the others keep their text."""
    ship(prepare(spark))
    return quality_rules.keep(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or above the threshold go. The model is learnt from the labels of documents that are still there."""
    ship(prepare(spark))
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    ship(prepare(spark))
    return ngram_join.keep_one(docs, n=5, percent=75)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    ship(prepare(spark))
    return mixing.repeat(docs, weights=(1, 2, 3), share=1.0, max_epochs=3)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row of the mix."""
    ship(prepare(spark))
    return bpe.encode(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rules),
    ("toxicity", toxic),
    ("ngram_join", near_copies),
    ("mix_sources", mixture),
    ("bpe", tokens),
]

#: Training, connected components and token merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


__all__ = ["ORACLE_SQL", "STAGES", "run"]
