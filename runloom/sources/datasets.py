"""Input datasets: directories read as one frame, and listings of their files."""

from __future__ import annotations

import posixpath
from collections import Counter
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runloom.functions.hashing import low64
from runloom.functions.text import extension
from runloom.sources.files import digest_files, list_files


def _as_list(paths: str | Iterable[str] | None) -> list[str]:
    if not paths:
        return []
    return [paths] if isinstance(paths, str) else list(paths)


def _base_name(path: str) -> str:
    return posixpath.basename(posixpath.normpath(path))


def below(path: Column, root: str) -> Column:
    """The part of a file path below ``root``."""
    bare = root.split("://", 1)[1] if "://" in root else root.removeprefix("file:")
    marker = posixpath.normpath(bare) + "/"
    return F.substr(path, F.locate(marker, path) + F.lit(len(marker)))


def check_base_names(paths: str | Iterable[str] | None) -> list[str]:
    """The base names of the input paths; two paths may not share one."""
    names = [_base_name(path) for path in _as_list(paths)]
    repeated = sorted(name for name, count in Counter(names).items() if count > 1)
    if repeated:
        raise ValueError(f"input paths share these base names: {repeated}")
    return names


def empty_dataset(spark: SparkSession, schema: StructType | str | None = None) -> DataFrame:
    """The dataset of a run without input paths: no rows, still tagged."""
    base = spark.createDataFrame([], schema if schema is not None else StructType())
    return base.withColumn("base_dir", F.lit("").cast("string"))


def load_tagged(
    spark: SparkSession,
    paths: str | Iterable[str] | None,
    fmt: str = "parquet",
    schema: StructType | str | None = None,
    partitioned: bool = False,
    **options: str,
) -> DataFrame:
    """Read one or more directories as one dataset, each row tagged with ``base_dir``.

    The tag is a literal per path, so a filter on it drops the other scans.
    Files in sub-directories belong to the path they were found under. With
    ``partitioned`` the sub-directories are ``name=value`` and become columns, whose
    filters skip directories.
    """
    paths = _as_list(paths)
    if not paths:
        return empty_dataset(spark, schema)
    reader = spark.read.format(fmt).option("recursiveFileLookup", str(not partitioned).lower()).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    parts = [
        reader.load(path).withColumn("base_dir", F.lit(name)) for path, name in zip(paths, check_base_names(paths))
    ]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)


def file_manifest(spark: SparkSession, root: str, extensions: Iterable[str] = ()) -> DataFrame:
    """List all files below ``root``: path, sub-folder, name, extension, size.

    Tasks list the folders level by level; the driver holds no listing and no file is opened.
    """
    files = list_files(spark, root)
    return describe_files(files.withColumn("path", below(F.col("path"), root)), extensions)


def describe_files(files: DataFrame, extensions: Iterable[str] = (), path: Column | str = "path") -> DataFrame:
    """Split relative paths into sub-folder, name and extension; keep chosen extensions."""
    path = F.col(path) if isinstance(path, str) else path
    name = F.substring_index(path, "/", -1)
    described = files.withColumns(
        {
            "folder": F.regexp_extract(path, r"^(.*)/[^/]*$", 1),
            "name": name,
            "ext": extension(name),
        }
    )
    wanted = list(extensions)
    return described.filter(F.col("ext").isin(*wanted)) if wanted else described


def hash_files(spark: SparkSession, paths: str | Iterable[str] | None) -> DataFrame:
    """Path below its base directory and 64-bit content hash of every file, of whatever size.

    Files are spread over tasks by their path and read in pieces.
    """
    parts = []
    for path, base in zip(_as_list(paths), check_base_names(paths), strict=True):
        files = list_files(spark, path)
        spread = files.select("path").repartition(4 * spark.sparkContext.defaultParallelism, "path")
        parts.append(
            digest_files(spread).select(
                F.lit(base).alias("base_dir"),
                F.concat_ws("/", F.lit(base), below(F.col("path"), path)).alias("path"),
                low64(F.col("sha256")).alias("hash64"),
            )
        )
    if not parts:
        return spark.createDataFrame([], "base_dir string, path string, hash64 decimal(20,0)")
    return reduce(DataFrame.unionByName, parts)
