"""A saved forest as column expressions and as SQL text: a prediction that does not go through the model."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.plans.learning import LABEL, load_model


@dataclass(frozen=True)
class Node:
    """A node of a tree: shares of the classes, and for an inner node the condition of its left child."""

    shares: tuple[float, ...]
    condition: str | None
    left: int
    right: int


@dataclass(frozen=True)
class Forest:
    """The trees of a saved model over the columns of its input, and the names of its classes."""

    labels: list[str]
    trees: list[dict[int, Node]]

    def votes(self) -> Column:
        """Per class the sum of its shares in the leaves that a row reaches."""
        leaves = [F.expr(_nested(tree, 0, lambda shares: f"array({', '.join(f'{s!r}D' for s in shares)})")) for tree in self.trees]
        zeros = F.array(*[F.lit(0.0) for _ in self.labels])
        return F.aggregate(F.array(*leaves), zeros, lambda total, leaf: F.zip_with(total, leaf, lambda x, y: x + y))

    def add_prediction(self, df: DataFrame, column: str) -> DataFrame:
        """The class with the most votes, the first one of equals."""
        names = F.array(*[F.lit(name) for name in self.labels])
        voted = df.withColumn("_votes", self.votes())
        return voted.withColumn(column, F.get(names, (F.array_position("_votes", F.array_max("_votes")) - 1).cast("int"))).drop("_votes")

    def sql(self) -> str:
        """The predicted class as one SQL expression, for a forest of a few trees."""
        votes = [" + ".join(_nested(tree, 0, lambda shares, k=k: f"CAST('{shares[k]!r}' AS DOUBLE)") for tree in self.trees) for k in range(len(self.labels))]
        best = f"greatest({', '.join(votes)})"
        cases = " ".join(f"WHEN {vote} = {best} THEN '{_quoted(name)}'" for name, vote in zip(self.labels, votes, strict=True))
        return f"CASE {cases} END"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _nested(tree: dict[int, Node], at: int, leaf: Callable[[tuple[float, ...]], str]) -> str:
    node = tree[at]
    if node.condition is None:
        return leaf(node.shares)
    return f"CASE WHEN {node.condition} THEN {_nested(tree, node.left, leaf)} ELSE {_nested(tree, node.right, leaf)} END"


def _slots(model: PipelineModel) -> list[tuple[str, list[float] | None]]:
    """Per entry of the feature vector its SQL, a number or the place of a text among those of training, and the ends of its bins if it has some."""
    places = {}
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel) and not (stage.isSet("outputCol") and stage.getOutputCol() == LABEL):
            for name, output, labels in zip(stage.getInputCols(), stage.getOutputCols(), stage.labelsArray, strict=True):
                cases = " ".join(f"WHEN '{_quoted(text)}' THEN {k}.0" for k, text in enumerate(labels))
                places[output] = f"CASE CAST({name} AS STRING) {cases} ELSE {len(labels)}.0 END" if cases else "0.0", None
        if isinstance(stage, Bucketizer):
            for name, output, ends in zip(stage.getInputCols(), stage.getOutputCols(), stage.getSplitsArray(), strict=True):
                places[output] = f"CAST({name} AS DOUBLE)", ends
    assembler = next(stage for stage in model.stages if isinstance(stage, VectorAssembler))
    return [places.get(name, (f"CAST({name} AS DOUBLE)", None)) for name in assembler.getInputCols()]


def read_forest(spark: SparkSession, path: str) -> Forest:
    """The forest at the path to which ``fit_step`` saved it.

    Its nodes are read from the saved table; they are as many as the trees have, whatever the data they were grown on.
    """
    model = load_model(path)
    labels = next(s.labels for s in model.stages if isinstance(s, StringIndexerModel) and s.isSet("outputCol") and s.getOutputCol() == LABEL)
    digits, last = len(str(len(model.stages))), len(model.stages) - 1
    nodes = spark.read.parquet(f"{path}/stages/{last:0{digits}}_{model.stages[-1].uid}/data")
    slots, trees = _slots(model), {}
    for row in nodes.select("treeID", "nodeData.*").collect():
        total = sum(row["impurityStats"])
        shares = tuple(s / total for s in row["impurityStats"])
        condition = None if row["leftChild"] < 0 else _condition(slots, *row["split"])
        trees.setdefault(row["treeID"], {})[row["id"]] = Node(shares, condition, row["leftChild"], row["rightChild"])
    return Forest(list(labels), [trees[k] for k in sorted(trees)])


def _condition(slots: list[tuple[str, list[float] | None]], feature: int, values: list[float], categories: int) -> str:
    number, ends = slots[feature]
    if categories >= 0:
        return f"{number} IN ({', '.join(_double(v) for v in values)})"
    if ends is None:
        return f"{number} <= {_double(values[0])}"
    # The bins up to this one end before the next one begins; the last one holds infinity, and what is no number lies behind it.
    after = math.floor(values[0]) + 1
    return f"{number} < {_double(ends[after])}" if after < len(ends) - 1 else f"{number} <= {_double(math.inf)}"


def _double(value: float) -> str:
    return f"CAST('{'Infinity' if value == math.inf else repr(value)}' AS DOUBLE)"
