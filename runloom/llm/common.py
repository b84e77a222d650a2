"""What several operators share: word hashes, stored tables and distributed ranks.

Every operator takes the columns it needs by name and drops the others before it adds its own, so
other columns of an input, whatever they are called, cannot clash with them.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from functools import cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runloom.session import BYTES_PER_PARTITION, input_bytes, scratch_dir, sized_for

#: Words are what lies between these characters. bytes.split() of Python cuts at the same six.
BLANKS = r"[\x20\x09-\x0D]+"
_CACHED_WORDS = 150_000
SHUFFLE_BYTES = 1 << 24


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for words met lately. Each task makes its own, so that they end with it."""

    def __init__(self, normal=None):
        super().__init__()
        self.normal = normal

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(self.normal(word) if self.normal else word)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8 with A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that all bits depend on all others."""
    with np.errstate(over="ignore"):
        v = values ^ (values >> np.uint64(33))
        v = v * np.uint64(0xFF51AFD7ED558CCD)
        v = v ^ (v >> np.uint64(33))
        v = v * np.uint64(0xC4CEB9FE1A85EC53)
        return v ^ (v >> np.uint64(33))


def n_grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash per window of n word hashes."""
    count = len(hashes) - n + 1
    with np.errstate(over="ignore"):
        total = np.full(max(count, 0), n, np.uint64)
        for k in range(n if count > 0 else 0):
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count]
    return mixed(total)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder and read again, which cuts the lineage."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return sized(df.sparkSession.read.schema(df.schema).parquet(path))


def sized(df: DataFrame, size: int | None = None) -> DataFrame:
    """The same frame; shuffles from now on start with a partition per 16 MiB of it, beyond 1 TiB per 128 MiB.

    Without a size that of its files counts.
    """
    size = input_bytes(df) if size is None else size
    return sized_for(df, min(size // SHUFFLE_BYTES, (1 << 16) + size // BYTES_PER_PARTITION) * BYTES_PER_PARTITION)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANKS)
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def crc_rest(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor; null for a null id."""
    return F.crc32(doc_id.cast("string")) % divisor


def in_cells(df: DataFrame, group: str, key: str, rows_per_cell: int) -> DataFrame:
    """Add `cell`: each group is cut into cells of about rows_per_cell rows by the hash `key`.

    The number of cells of a group follows its row count, so that a hot group has as many more
    cells. Only counts per group are joined to the rows.
    """
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
    cells = F.ceil(F.col("_rows") / rows_per_cell)
    named = counts.select(F.col(group).alias("_group"), "_rows")
    cut = F.pmod(F.col(key), cells).cast("long")
    return df.join(named, F.col(group).eqNullSafe(F.col("_group"))).withColumn("cell", cut).drop("_group", "_rows")


def ranked(df: DataFrame, group: str, key: str, order: list[str], rows_per_cell: int = 4096) -> DataFrame:
    """Add `rank`, gapless from 0 within each group, without bringing a group to one task.

    Rows are cut into cells (see in_cells), counted per cell, and only the cells' counts are summed
    up in order; rows are numbered within their cell.
    """
    cut = in_cells(df, group, key, rows_per_cell)
    sizes = cut.groupBy(group, "cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(group).alias("_group"), F.col("cell").alias("_cell"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(group, "cell").orderBy(*order)
    numbered = cut.withColumn("_at", F.row_number().over(inside) - 1)
    joined = numbered.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("cell") == F.col("_cell")))
    return joined.withColumn("rank", F.col("_start") + F.col("_at")).drop("_group", "_cell", "_start", "_at", "cell")


@cache
def _package() -> str:
    """This package as a zip file of the driver."""
    import runloom

    home = os.path.dirname(os.path.dirname(os.path.abspath(runloom.__file__)))
    return shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="runloom-"), "runloom"), "zip", home, "runloom")


def ship(spark: SparkSession) -> SparkSession:
    """Let Spark hand this package to the Python workers, and whole texts to them in small batches."""
    spark.sparkContext.addPyFile(_package())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sized(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
