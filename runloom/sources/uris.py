"""Kinds of external paths and their bucket and key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions.text import base_name


def classify_uris(uris: DataFrame, uri: str = "uri") -> DataFrame:
    """Add kind, bucket, key, rejected and suspicious.

    A text with ``s3:/`` anywhere is remote; one that does not start with it is
    suspicious. A relative path must have a named parent directory.
    """
    text = F.col(uri)
    kind = F.when(text.contains("s3:/"), "s3").when(text.startswith("/"), "absolute").otherwise("relative")
    # netloc and path of scheme://netloc/path?query#fragment
    bucket = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(text, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    name = base_name(text)
    parent = F.when(name == "", F.lit("")).otherwise(F.split_part(text, name, F.lit(1)))
    return uris.withColumns(
        {
            "kind": kind,
            "bucket": bucket,
            "key": F.ltrim(path, F.lit("/")),
            "rejected": (kind == "relative") & parent.isin("./", "", "~/"),
            "suspicious": (kind == "s3") & ~text.startswith("s3:/"),
        }
    )


def profile_uris(uris: DataFrame, uri: str = "uri") -> DataFrame:
    """How many paths of each kind and bucket there are, and how many are rejected."""
    return (
        classify_uris(uris, uri)
        .groupBy("kind", "bucket")
        .agg(
            F.count(F.lit(1)).alias("n_uris"),
            F.count_if("rejected").alias("n_rejected"),
            F.count_if("suspicious").alias("n_suspicious"),
            F.count_if(F.col("key") == "").alias("n_without_key"),
        )
    )
