"""Train and scoring steps on Spark ML, and the choice of a model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from runloom.session import scratch_dir

FEATURES, LABEL, PREDICTION, RESULT, PROBABILITIES = "features", "label", "prediction", "predicted", "probabilities"
WEIGHT = "_weight"
#: Bins of a number column, and about the rows or blocks of alike rows that a forest grows on.
BINS, BLOCKS = 32, 1 << 19


def select_xy(df: DataFrame, x_columns: Sequence[str], y_column: str | None = None) -> DataFrame:
    """The feature columns and, if there is one, the label."""
    missing = [name for name in (*x_columns, *([y_column] if y_column else [])) if name not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*x_columns, *([y_column] if y_column else []))


def feature_stages(df: DataFrame, x_columns: Sequence[str], cuts: Mapping[str, Sequence[float]] | None = None) -> list:
    """Index text columns, put numbers into bins where there are ``cuts`` for them, and assemble all into one vector."""
    texts = [name for name in x_columns if not isinstance(df.schema[name].dataType, NumericType)]
    stages: list = []
    if texts:
        stages.append(
            StringIndexer(inputCols=texts, outputCols=[f"{name}_index" for name in texts], handleInvalid="keep")
        )
    binned = [name for name in x_columns if name in (cuts or {})]
    if binned:
        ends = [[float("-inf"), *cuts[name], float("inf")] for name in binned]
        stages.append(Bucketizer(inputCols=binned, outputCols=[f"{name}_bin" for name in binned], splitsArray=ends, handleInvalid="keep"))
    inputs = [f"{name}_index" if name in texts else f"{name}_bin" if name in binned else name for name in x_columns]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol=FEATURES, handleInvalid="keep")]


def bin_cuts(df: DataFrame, columns: Sequence[str]) -> dict[str, list[float]]:
    """Per number column the values that part its bins, of which there are ``BINS`` at most.

    Few different values have a bin each, with cuts halfway between them; others are parted by their quantiles over all rows.
    """
    if not columns:
        return {}
    numbers = {name: F.when(~F.isnan(F.col(name).cast("double")), F.col(name).cast("double")) for name in columns}
    shares = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    seen = df.agg(
        *[F.approx_count_distinct(n).alias(f"n{k}") for k, n in enumerate(numbers.values())],
        *[F.percentile_approx(n, shares, F.lit(10 * BINS * BINS)).alias(f"q{k}") for k, n in enumerate(numbers.values())],
    ).first()
    found = {name: seen[f"q{k}"] or [] for k, name in enumerate(columns)}
    few = [name for k, name in enumerate(columns) if seen[f"n{k}"] <= 2 * BINS]
    if few:
        values = df.agg(*[F.sort_array(F.collect_set(numbers[name])).alias(f"v{k}") for k, name in enumerate(few)]).first()
        for name, each in zip(few, values, strict=True):
            if len(each) <= BINS:
                found[name] = [x / 2 + y / 2 for x, y in zip(each, each[1:], strict=False)]
    # Zero has two signs, and both belong above a cut at zero.
    return {name: sorted({-0.0 if c == 0 else c for c in cuts if abs(c) != float("inf")}) for name, cuts in found.items()}


def _blocks(cells: DataFrame, total: int) -> DataFrame:
    """Cells of ``_n`` rows each as blocks with a weight; all blocks together weigh as much as there are rows.

    A row is a block up to ``BLOCKS`` rows. Beyond, a block stands for several rows of one cell, so that blocks are no more than
    ``BLOCKS`` and the cells.
    """
    most = F.lit(-(-total // BLOCKS)).cast("bigint")
    firsts = F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, most)
    return cells.withColumn("_first", F.explode(firsts)).withColumn(WEIGHT, F.least(most, F.col("_n") - F.col("_first")).cast("double")).drop("_n", "_first")


def fit_step(
    df: DataFrame,
    x_columns: Sequence[str],
    y_column: str,
    params: Mapping[str, Any],
    model_path: str | None = None,
    partitions: int | None = None,
) -> PipelineModel:
    """Train a forest of ``n_estimators`` trees and save it below the models area.

    A forest knows of a number only its bin, so that rows of the same bins, texts and label are alike to it. They are counted
    as cells first, over all rows, and the trees grow level by level over the cells, weighted by their rows. The bootstrap
    of a tree draws rows, or blocks of alike rows where there are more than ``BLOCKS`` of them. So only a
    few passes go over the data, which is written once for them; the blocks are spread over ``partitions``, or over two
    per core. Only cuts and split statistics reach the driver. A row without a label is an error, never left out.
    """
    forest = RandomForestClassifier(
        featuresCol=FEATURES,
        labelCol=LABEL,
        predictionCol=PREDICTION,
        weightCol=WEIGHT,
        # A bin more for what is no number.
        maxBins=BINS + 1,
        numTrees=int(params.get("n_estimators", 100)),
        maxDepth=int(params.get("max_depth", 5)),
        seed=int(params.get("seed", 42)),
    )
    spark = df.sparkSession
    label = StringIndexer(inputCol=y_column, outputCol=LABEL, stringOrderType="alphabetAsc", handleInvalid="error")
    data = select_xy(df, x_columns, y_column).withColumn(y_column, F.col(y_column).cast("string"))
    path, schema = scratch_dir(spark, "training"), data.schema
    data.write.parquet(path)
    data = spark.read.schema(schema).parquet(path)
    counts = data.agg(F.count(F.lit(1)).alias("n"), F.count(y_column).alias("labelled")).first()
    if counts["labelled"] < counts["n"]:
        raise ValueError(f"training rows without a label in {y_column}")
    cuts = bin_cuts(data, [name for name in x_columns if isinstance(schema[name].dataType, NumericType)])
    *stages, assembler = feature_stages(data, x_columns, cuts)
    before = Pipeline(stages=[*stages, label]).fit(data).stages
    features = before[:-1]
    # Bins are numbers in order; the names that come with them would make them categories.
    keys = [F.col(c).alias(c, metadata={}) if c.endswith("_bin") else F.col(c) for c in assembler.getInputCols()]
    cells = PipelineModel(list(before)).transform(data).select(*keys, LABEL).groupBy(*assembler.getInputCols(), LABEL).agg(F.count(F.lit(1)).alias("_n"))
    spread = partitions or 2 * spark.sparkContext.defaultParallelism
    blocks_path = scratch_dir(spark, "blocks")
    _blocks(cells, counts["n"]).repartition(spread).write.parquet(blocks_path)
    # Read with the metadata of the label, which names its classes.
    blocks = assembler.transform(spark.read.parquet(blocks_path))
    model = PipelineModel([*features, assembler, before[-1], forest.fit(blocks)])
    if model_path:
        model.write().overwrite().save(model_path)
    return model


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _indexes_label(stage) -> bool:
    return isinstance(stage, StringIndexerModel) and stage.isSet("outputCol") and stage.getOutputCol() == LABEL


def score_step(df: DataFrame, model: PipelineModel | str) -> DataFrame:
    """Add the predicted class as text and the probability of each class as a map. No label is needed."""
    model = load_model(model) if isinstance(model, str) else model
    indexer = next(stage for stage in model.stages if _indexes_label(stage))
    scorer = PipelineModel([stage for stage in model.stages if stage is not indexer])
    names = F.array(*[F.lit(name) for name in indexer.labels])
    return scorer.transform(df).withColumns(
        {
            RESULT: F.element_at(names, F.col(PREDICTION).cast("int") + 1),
            PROBABILITIES: F.map_from_arrays(names, vector_to_array("probability")),
        }
    )


def summarize_scores(
    predictions: DataFrame,
    run: str = "run",
    label: str = "label",
    probabilities: str | None = None,
    note: Column | None = None,
    date: str = "",
    version: str = "1.0",
) -> DataFrame:
    """One summary per run: probability per class, the likeliest class and its probability.

    The probability of a class is its share of the run's rows, or the mean over a
    map of ``probabilities`` that names every class in every row. Ties go to the
    smallest class. ``score`` is rounded to 6 decimals.
    """
    if probabilities:
        votes = predictions.select(run, F.explode(probabilities).alias("result", "_vote"))
    else:
        votes = predictions.select(run, F.col(label).cast("string").alias("result"), F.lit(1).alias("_vote"))
    counts = votes.groupBy(run, "result").agg(F.sum("_vote").alias("_w"), F.count(F.lit(1)).alias("_n"))
    n_rows = F.max("_n") if probabilities else F.sum("_n")
    # One row per run and class from here on.
    shares = counts.withColumn("_share", F.col("_w") / F.sum("_w").over(Window.partitionBy(run)))
    best = F.min(F.struct((-F.col("_share")).alias("s"), F.col("result").alias("r")))
    per_class = F.sort_array(F.collect_list(F.struct(F.col("result"), F.round("_share", 6).alias("share"))))
    summary = shares.groupBy(run).agg(
        best.alias("_best"), F.map_from_entries(per_class).alias("probability"), n_rows.alias("_rows")
    )
    text = note if note is not None else F.concat(F.lit("n"), F.col("_rows").cast("string"))
    return summary.select(
        run,
        F.lit(date).alias("date"),
        text.alias("note"),
        "probability",
        F.col("_best.r").alias("result"),
        F.round(-F.col("_best.s"), 6).alias("score"),
        F.lit(version).alias("version"),
    )


def pick_models(wanted: DataFrame, train_runs: DataFrame, root: str, wanted_id: str = "wanted_train_id") -> DataFrame:
    """Add the model path of the wanted train run to each row; NULL if there is no such run."""
    known = train_runs.select(
        F.col("folder").alias(wanted_id), F.concat(F.lit(f"{root}/"), "folder", F.lit("/models/")).alias("model_path")
    )
    return wanted.join(known, wanted_id, "left")


def pick_model(train_runs: DataFrame, train_id: str, root: str, shown: int = 20) -> str:
    """The model path of a train run; an unknown id raises with valid ids."""
    if not train_runs.filter(F.col("folder") == train_id).limit(1).count():
        valid = [row["folder"] for row in train_runs.select("folder").orderBy(F.desc("folder")).limit(shown).collect()]
        raise LookupError(f"no train run {train_id}; the newest ones are {valid}")
    return f"{root}/{train_id}/models/"
