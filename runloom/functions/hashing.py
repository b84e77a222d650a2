"""Fingerprints as column expressions and as grouped digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hex digits of the key's MD5 that name the nodes of the digest tree, leaves first.
TREE_DIGITS = (4, 2)


def low64(hex_digest: Column) -> Column:
    """The low 64 bits of a hex digest as an unsigned number."""
    return F.conv(F.right(hex_digest, F.lit(16)), 16, 10).cast("decimal(20,0)")


def content_hash64(content: Column) -> Column:
    """The low 64 bits of SHA-256, unsigned. Takes text or binary."""
    return low64(F.sha2(content, 256))


def short_id(hex_digest: Column) -> Column:
    return F.substring(hex_digest, 1, 12)


def _digest(text: Column, algorithm: str) -> Column:
    return F.sha2(text, 256) if algorithm == "sha256" else F.md5(text)


def ordered_digest(
    df: DataFrame, by: Sequence[str], order: Sequence[str], text: Column, algorithm: str = "sha256"
) -> DataFrame:
    """One digest per group over the texts of its rows, with the number of rows.

    ``order`` must identify a row within its group. The digest is that of a fixed tree, the
    same for groups of any size: the MD5 of the key's values, joined by dots, says to which of
    65,536 leaves a row belongs. A leaf is the digest of its rows' texts in key order, an inner
    node that of its leaves in order, and the root that of the inner nodes. Nodes without rows
    do not appear, so a small group costs as many digests as it has rows. A task holds one
    leaf at most. Nothing runs when this is called.
    """
    algorithm = algorithm.lower()
    if algorithm not in ("sha256", "md5"):
        raise ValueError(f"unknown digest algorithm: {algorithm}")
    return digest_of_leaves(leaf_digests(df, by, order, text, algorithm), by, algorithm)


def leaf_of(order: Sequence[str]) -> Column:
    """The leaf that a row belongs to."""
    return F.substring(F.md5(F.concat_ws(".", *[F.col(name).cast("string") for name in order])), 1, TREE_DIGITS[0])


def leaf_digests(df: DataFrame, by: Sequence[str], order: Sequence[str], text: Column, algorithm: str = "sha256") -> DataFrame:
    """leaf, digest and n_rows of the leaves of each group's tree."""
    rows = df.select(*by, leaf_of(order).alias("leaf"), F.struct(*order).alias("_key"), text.alias("_text"))
    joined = rows.groupBy(*by, "leaf").agg(_ordered_concat("_text", "_key").alias("_text"), F.count(F.lit(1)).alias("n_rows"))
    return joined.select(*by, "leaf", _digest(F.col("_text"), algorithm).alias("digest"), "n_rows")


def digest_of_leaves(leaves: DataFrame, by: Sequence[str], algorithm: str = "sha256") -> DataFrame:
    """The digest of each group's tree from its leaves."""
    by = list(by)
    nodes = _level(leaves.withColumnRenamed("leaf", "_node"), by, algorithm, F.substring("_node", 1, TREE_DIGITS[1]))
    return _level(nodes, by, algorithm, None).filter("n_rows > 0").select(*by, "digest", "n_rows")


def _level(nodes: DataFrame, by: list[str], algorithm: str, above: Column | None) -> DataFrame:
    """The digest of the nodes' digests, joined in order within the node above, or within the group."""
    keys = [*by, *([above.alias("_above")] if above is not None else [])]
    joined = nodes.groupBy(*keys).agg(_ordered_concat("digest", "_node").alias("_text"), F.sum("n_rows").alias("n_rows"))
    return joined.withColumn("digest", _digest(F.col("_text"), algorithm)).drop("_text").withColumnRenamed("_above", "_node")


def _ordered_concat(text: str, key: str) -> Column:
    pairs = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(text).alias("t"))))
    return F.array_join(F.transform(pairs, lambda pair: pair["t"]), "")
