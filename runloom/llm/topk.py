"""Exact top-k by inner product with MaxScore pruning.

Every dimension of a vector is a query term and every candidate value a posting. Candidates are cut into
shards and queries into blocks; a task holds one shard and one block. Per query the largest contribution of
each term within the shard is its bound. Scores of a few likely candidates give a threshold; the terms whose
bounds together stay below it are non-essential. The essential postings are traversed for all candidates of the
shard, then the other terms are probed, strongest first, only for candidates that can still reach the
threshold. The winners of all shards are merged per query. Nothing is approximated.

Defined results: vectors that are null, hold null or non-finite components, or have no id take no part.
A shorter vector counts as filled up with zeros. Equal rows count once; ties go to the smaller id. With fewer
candidates than k all are returned. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runloom.llm.common import stored

SHARD_ROWS, BLOCK_ROWS = 4096, 1024
_SEED_TERMS, _STEP = 8, 8
_EXACT = 2**53


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * component) for each component."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def sound(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    good = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, vector in enumerate(vectors):
        out[row, : len(vector)] = vector
    return out


def _numbers(left: np.ndarray, right: np.ndarray) -> type:
    """Floats where every sum of products is exact in them, else Python's integers."""
    largest = [max((abs(int(m.min())), abs(int(m.max())))) if m.size else 0 for m in (left, right)]
    return np.float64 if largest[0] * largest[1] * max(1, left.shape[1]) < _EXACT else object


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def search(query: np.ndarray, own: int, ids: np.ndarray, rows: np.ndarray, high: np.ndarray, low: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(id, score) of the k best rows for a query; high and low hold each term's extreme values."""
    terms = np.maximum(query * high, query * low)
    spread = terms - np.minimum(query * high, query * low)
    order = np.argsort(-spread.astype(float), kind="stable")
    other = ids != own
    if other.sum() <= k:
        chosen = np.flatnonzero(other)
    else:
        first = order[:_SEED_TERMS]
        hint = np.where(other, (rows[:, first] @ query[first]).astype(float), -np.inf)
        seeds = np.argpartition(-hint, 2 * k - 1)[: 2 * k] if len(hint) > 2 * k else np.arange(len(hint))
        seeds = seeds[other[seeds]]
        threshold = np.sort(rows[seeds] @ query)[::-1][k - 1] if len(seeds) >= k else None
        # rest[i]: the most that the terms from place i on can add.
        rest = np.append(np.cumsum(terms[order][::-1])[::-1], 0)
        positive = np.append(np.cumsum(np.maximum(terms[order], 0)[::-1])[::-1], 0)
        split = len(order) if threshold is None else int(np.argmax(positive < threshold)) if (positive < threshold).any() else len(order)
        essential = order[:split]
        chosen = np.flatnonzero(other)
        partial = rows[:, essential] @ query[essential]
        partial = partial[chosen]
        while threshold is not None:
            able = partial + rest[split] >= threshold
            chosen, partial = chosen[able], partial[able]
            if split == len(order):
                break
            probe = order[split : split + _STEP]
            partial = partial + rows[np.ix_(chosen, probe)] @ query[probe]
            split += len(probe)
    scores = rows[chosen] @ query
    top = best(scores, ids[chosen], k)
    return [(int(ids[chosen[t]]), int(scores[t])) for t in top]


def _tile(k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        asked, held = group[group["asks"]], group[~group["asks"]]
        width = int(max(group["v"].map(len).max(), 1))
        queries, rows = _matrix(asked["v"].tolist(), width), _matrix(held["v"].tolist(), width)
        kind = _numbers(queries, rows)
        queries, rows, ids = queries.astype(kind), rows.astype(kind), held["vec_id"].to_numpy(np.int64)
        found: list[tuple[int, int, int]] = []
        if len(ids):
            high, low = rows.max(0), rows.min(0)
            for own, query in zip(asked["vec_id"].tolist(), queries, strict=True):
                found += [(own, i, s) for i, s in search(query, own, ids, rows, high, low, k)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return run


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by `every`, against all others."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & sound(F.col("v"))).select("vec_id", scaled(F.col("v"), scale).alias("v"))
    vectors = stored(vectors.dropDuplicates(["vec_id", "v"]), "topk-vectors")
    asks = F.col("vec_id") % every == 0
    rows, queries = vectors.agg(F.count(F.lit(1)), F.count(F.when(asks, 1))).first()
    shards, blocks = max(1, -(-rows // SHARD_ROWS)), max(1, -(-queries // BLOCK_ROWS))
    number = F.xxhash64("vec_id")
    # Each shard meets each block once: both sides are repeated in whole blocks, never in pairs of rows.
    held = vectors.select(F.pmod(number, F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    asked = vectors.where(asks).select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")).alias("shard"),
        F.pmod(number, F.lit(blocks)).cast("int").alias("block"),
        F.lit(True).alias("asks"),
        "vec_id",
        "v",
    )
    found = held.union(asked).groupBy("shard", "block").applyInPandas(_tile(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
