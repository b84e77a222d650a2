"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns some points of a ring; a document belongs to the first point at or after the hash of
its text, so equal texts meet. A shard holds no more rows than its share: what does not fit continues
clockwise to the next shard that has room. Shares differ by one row at most and sum up to all rows, so
counts are at most one apart, while most rows stay where the plain ring would put them.

How much of an arc goes to which shard depends on row counts per arc only. There are shards times
virtual nodes arcs, whatever the input, so this small table is settled on the driver; rows are then
numbered within their arc by distributed ranks, and a row's number says its shard and slot.

Defined results: a null text has size 1 and belongs with the empty ones; a null doc_id is an id of its
own; repeated rows are rows of their own with slots of their own. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import ranked, stored

VIRTUAL_NODES = 64


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> tuple[np.ndarray, list[int]]:
    """Places of the points in clockwise order, and the shard of each."""
    points = sorted((xxhash.xxh3_64_intdigest(f"shard {s} point {v}") >> 1, s) for s in range(shards) for v in range(virtual_nodes))
    return np.array([p for p, _ in points], np.int64), [s for _, s in points]


def clockwise(owners: list[int], arc: int) -> list[int]:
    """The distinct shards met from an arc on."""
    return list(dict.fromkeys(owners[arc:] + owners[:arc]))


def settle(counts: dict[int, int], owners: list[int], shards: int) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, shard, first slot) of each run of an arc's rows that go to one shard.

    All arcs fill the shard of their own point first; then what is left over goes one shard on, and
    so forth.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, done, runs = [0] * shards, dict.fromkeys(counts, 0), []
    routes = {arc: clockwise(owners, arc) for arc in counts}
    for hop in range(shards):
        for arc in sorted(counts):
            shard = routes[arc][hop]
            take = min(counts[arc] - done[arc], room[shard] - used[shard])
            if take:
                runs.append((arc, done[arc], shard, used[shard]))
                done[arc] += take
                used[shard] += take
    return runs


def arc_of(places: np.ndarray):
    """A function of 63-bit hashes: the first point at or after them, around the ring."""
    known = places.tolist()

    @F.pandas_udf("int")
    def arc(hashes: pd.Series) -> pd.Series:
        at = np.searchsorted(np.array(known, np.int64), hashes.to_numpy(np.int64), side="left")
        return pd.Series(at % len(known), dtype="int32")

    return arc


def place(docs: DataFrame, shards: int = 16, virtual_nodes: int = VIRTUAL_NODES, rows_per_cell: int = 2048) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and the shard of the plain ring."""
    spark = docs.sparkSession
    places, owners = ring(shards, virtual_nodes)
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("_place"),
    )
    rows = stored(
        slim.withColumn("arc", arc_of(places)("_place")).withColumn("_key", F.xxhash64("doc_id", "text_crc32", "size", "_place")), "shard-rows"
    )
    counts = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for arc, first, shard, slot in settle(counts, owners, shards):
        runs.setdefault(arc, []).append((first, shard, slot))
    schema = "_arc int, _home int, _runs array<struct<first: bigint, shard: int, slot: bigint>>"
    known = F.broadcast(spark.createDataFrame([(arc, owners[arc], parts) for arc, parts in sorted(runs.items())], schema))
    numbered = ranked(rows, "arc", "_key", ["_key", "doc_id", "text_crc32", "size"], rows_per_cell)
    own = F.element_at(F.filter("_runs", lambda r: r["first"] <= F.col("rank")), -1)
    return (
        numbered.join(known, F.col("arc") == F.col("_arc"))
        .withColumn("_run", own)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("_run.shard").alias("shard"),
            (F.col("_run.slot") + F.col("rank") - F.col("_run.first")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            F.col("_home").alias("home_shard"),
        )
    )


__all__ = ["arc_of", "clockwise", "place", "ring", "settle"]
