"""Dataset ids that are renewed from the files that changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions.hashing import TREE_DIGITS, leaf_digests, leaf_of
from runloom.operators.identity import ids_of_leaves
from runloom.session import exists, remove, scratch_dir

# What is stored: file hashes, and the leaves of their digest tree. Both lie in folders by the inner node above them.
FILES, LEAVES, PART = "files", "leaves", "part"


def store_dataset(hashed: DataFrame, root: str, by: Sequence[str] = (), path: str = "path", hash64: str = "hash64") -> str:
    """Keep the hashes of a dataset's files below ``root`` so that its id can be renewed; returns ``root``."""
    rows = hashed.select(*by, F.col(path).alias("path"), F.col(hash64).alias("hash64"))
    _write(_placed(rows), root, FILES)
    _write(_leaves(_read(rows.sparkSession, root, FILES), by), root, LEAVES)
    return root


def renew_dataset(changes: DataFrame, root: str, by: Sequence[str] = (), path: str = "path", hash64: str = "hash64") -> None:
    """Take over changed, new and deleted files (``hash64`` is NULL); only leaves that hold one of them are hashed again.

    ``changes`` has one row per file. Of the stored hashes only the folders that hold such a leaf are read, at most
    256. The same changes may be given again, so a call that stopped is repeated.
    """
    spark, keys = changes.sparkSession, [*by, "path"]
    placed = _placed(changes.select(*by, F.col(path).alias("path"), F.col(hash64).alias("hash64")))
    placed.write.parquet(target := scratch_dir(spark, "changes"))
    placed = spark.read.schema(placed.schema).parquet(target)
    touched = sorted(row[PART] for row in placed.select(PART).distinct().collect())
    if not touched:
        return
    held = _read(spark, root, FILES).filter(F.col(PART).isin(touched))
    same = [held[key].eqNullSafe(placed[key]) for key in keys]
    merged = held.join(placed, [held[PART] == placed[PART], *same], "left_anti").unionByName(placed.filter("hash64 IS NOT NULL"))
    merged.write.partitionBy(PART).parquet(target := scratch_dir(spark, "merged"))
    merged = spark.read.schema(held.schema).parquet(target)
    _replace(merged, f"{root}/{FILES}", touched)
    leaves = placed.select(*by, "leaf").distinct()
    anew = merged.join(leaves, [*by, "leaf"], "left_semi") if not by else merged.join(leaves, [merged[c].eqNullSafe(leaves[c]) for c in (*by, "leaf")], "left_semi")
    kept = _read(spark, root, LEAVES).filter(F.col(PART).isin(touched))
    kept = kept.join(leaves, [kept[c].eqNullSafe(leaves[c]) for c in (*by, "leaf")], "left_anti")
    digests = _leaves(anew, by)
    kept.unionByName(digests).write.partitionBy(PART).parquet(target := scratch_dir(spark, "leaves"))
    _replace(spark.read.schema(kept.schema).parquet(target), f"{root}/{LEAVES}", touched)


def stored_id(spark: SparkSession, root: str, by: Sequence[str] = ()) -> DataFrame:
    """The ids of a stored dataset, from its leaves alone; equal to ``dataset_id`` of all its files."""
    return ids_of_leaves(_read(spark, root, LEAVES), by)


def _placed(rows: DataFrame) -> DataFrame:
    leaf = leaf_of(["path"])
    return rows.withColumn("leaf", leaf).withColumn(PART, F.substring("leaf", 1, TREE_DIGITS[1]))


def _leaves(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    digests = leaf_digests(rows, by, ["path"], F.col("hash64").cast("string"))
    return digests.withColumn(PART, F.substring("leaf", 1, TREE_DIGITS[1]))


def _write(rows: DataFrame, root: str, name: str) -> None:
    """Beside the rows a file without any keeps their columns, also for a dataset that has lost all its files."""
    rows.limit(0).write.mode("overwrite").parquet(f"{root}/columns/{name}")
    rows.hint("rebalance", PART).write.mode("overwrite").partitionBy(PART).parquet(f"{root}/{name}")


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{root}/columns/{name}").schema).parquet(f"{root}/{name}")


def _replace(rows: DataFrame, path: str, parts: Sequence[str]) -> None:
    """Write the folders of these parts anew; one without rows goes."""
    spark = rows.sparkSession
    left = {row[PART] for row in rows.select(PART).distinct().collect()}
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    for part in parts:
        if part not in left and exists(spark, f"{path}/{PART}={part}"):
            remove(spark, f"{path}/{PART}={part}")
