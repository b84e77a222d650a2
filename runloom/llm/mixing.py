"""Mixing sources to target weights by capped water-filling.

Sources in code-point order, null last, get the given weights in turn. The budget (a share of all
words) is dealt by weight; a source whose part exceeds max_epochs times its size is clamped there and
what is left over is dealt again among the others by weight, until no part is too large. The part of
a source divided by its size is its number of epochs: every document is taken the whole number of
times, and a seeded choice of documents once more for the fraction.

The choice is made in three parts of a source, by size and then in seeded order. The CELL_ROWS largest documents each add the
fraction of their size to an account, large size classes first and in seeded order within one, and a document is taken when the account
holds half its size. What the account is left with is dealt among the other documents: those between are taken at even steps of
their rank from a seeded start, which is off by about the largest of them, and the CELL_ROWS smallest settle by the account
what all others left. So a source differs from its target by about its smallest document; where the small ones cannot make up for it,
by about its largest document past the first CELL_ROWS, or by what the first ones left if there is nothing else.

Defined results: null and empty texts have size 0 and are taken as often as the whole epochs say, which
adds no words. Null is a source of its own. Repeated rows are documents of their own. If all sizes
are 0, every target is 0. An empty table gives an empty table.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runloom.llm.common import ranked, stored, word_count

WEIGHTS = (1, 2, 3)
CELL_ROWS = 1000


def source_table(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, weight: one row per source, numbered without one task for all of them."""
    sums = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sums")
    # Sorting deals sources out by ranges; an id has its range in the upper 31 bits.
    placed = stored(sums.orderBy(F.col("source").isNull(), F.col("source")).withColumn("_id", F.monotonically_increasing_id()), "mix-order")
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn(
        "_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    numbered = placed.withColumn("_part", part).join(starts, "_part")
    place = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (place % len(weights)).cast("int"))
    return stored(numbered.select("source", "source_size", weight.cast("long").alias("weight")), "mix-sources")


def water_level(sources: DataFrame, share: float = 1.0, max_epochs: int = 3) -> float:
    """Words per unit of weight for the sources that are not clamped.

    Each round is one small aggregation; it ends when no further source is clamped.
    """
    sums = lambda rows: rows.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weight = (x or 0 for x in sums(sources))
    budget = min(total * share, float(total * max_epochs))
    level = budget / weight if weight else 0.0
    while True:
        clamped = F.col("source_size") * float(max_epochs) <= F.col("weight") * level
        held, _ = (x or 0 for x in sums(sources.where(clamped)))
        _, free = (x or 0 for x in sums(sources.where(~clamped)))
        if not free:
            return level
        raised = (budget - held * max_epochs) / free
        if raised <= level:
            return level
        level = raised


def _choose(rows: pd.DataFrame) -> pd.DataFrame:
    """The account over the rows of one source, from `start` on. `left` is what it holds at the end."""
    rows = rows.assign(size_class=np.frexp(rows["size"].to_numpy(float))[1])
    rows = rows.sort_values(["size_class", "luck", "doc_key", "text_key"], ascending=[False, True, True, True], kind="stable")
    account, more = float(rows["start"].iloc[0]), []
    for size, part in zip(rows["size"].tolist(), rows["fraction"].tolist(), strict=True):
        account += size * part
        taken = size > 0 and part > 0 and account >= size / 2
        account -= size * taken
        more.append(int(taken))
    return rows.assign(times=rows["whole"] + np.array(more, np.int64), left=account)[[*_CHOSEN, "left"]]


_CHOSEN = ["doc_id", "source", "text_key", "size", "source_size", "target", "times"]


def _by_rank(sized: DataFrame) -> DataFrame:
    """Add `rank` from 0 by falling size within each source, and `_rows` of the source, without one task for a source."""
    order = [F.col("source"), F.col("size").desc(), F.col("luck"), F.col("doc_key"), F.col("text_key"), F.col("_row_id")]
    rows = sized.withColumn("_row_id", F.monotonically_increasing_id())
    # Sorting deals rows out by ranges; an id has its range in the upper 31 bits.
    placed = stored(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "mix-ranks")
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    counts = placed.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    source = Window.partitionBy("source")
    before = source.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("source").alias("_of"), F.col("_part").alias("_at"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(source).alias("_rows")
    )
    joined = placed.join(starts, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_at")))
    return joined.withColumn("rank", F.col("_start") + F.col("_id") - F.col("_first")).drop("_of", "_at", "_first", "_start", "_id", "_part", "_row_id")


def _plan(docs: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The slim table of documents, and per source its target, whole epochs and fraction."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sized = stored(
        docs.select(F.col("doc_id").alias("doc_id"), key.alias("doc_key"), F.xxhash64(key, text).alias("text_key"), F.col("source").alias("source"), word_count(text).alias("size")),
        "mix-sized",
    )
    sources = source_table(sized, weights)
    level = water_level(sources, share, max_epochs)
    target = F.least(F.col("weight") * F.lit(level), F.col("source_size") * float(max_epochs))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = sources.withColumn("target", target).select(
        F.col("source").alias("_source"),
        "source_size",
        "target",
        F.floor(epochs).cast("long").alias("whole"),
        (epochs - F.floor(epochs)).alias("fraction"),
    )
    luck = F.xxhash64(F.lit(seed), "doc_key", "text_key")
    return sized.withColumn("luck", luck), plan


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = 3, seed: int = 7
) -> DataFrame:
    """doc_id, text_key, size, source_size, target, times: how often the mix takes each row of the documents.

    text_key is a hash of the id and the text.
    """
    sized, plan = _plan(docs, weights, share, max_epochs, seed)
    with_plan = lambda rows: rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    beside = lambda rows, sums: rows.join(sums, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")
    empty = with_plan(sized.where("size = 0")).withColumn("times", F.col("whole"))
    full = with_plan(_by_rank(sized.where("size > 0")))
    kind = full.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, source string, text_key long, size long, source_size long, target double, times long, left double"
    of = F.col("source").alias("_of")

    def settled(rows: DataFrame) -> DataFrame:
        return stored(rows.groupBy("source").applyInPandas(_choose, schema), "mix-settled")

    large = settled(full.where(F.col("rank") < CELL_ROWS).withColumn("start", F.lit(0.0)))
    rest = full.where(F.col("rank") >= CELL_ROWS)
    over = large.groupBy(of).agg(F.first("left").alias("_left"))
    words = rest.groupBy(of).agg(F.sum("size").alias("_words"))
    dealt = stored(over.join(words.withColumnRenamed("_of", "_other"), F.col("_of").eqNullSafe(F.col("_other"))).drop("_other"), "mix-left")
    share = F.least(F.greatest(F.col("fraction") + F.col("_left") / F.col("_words"), F.lit(0.0)), F.lit(1.0))
    rest = beside(rest, dealt).withColumn("_share", F.when(F.col("fraction") > 0, share).otherwise(F.lit(0.0)))
    # Even steps of the rank from a seeded start.
    first = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 20)) / (1 << 20)
    step = lambda k: F.floor(k * F.col("_share") + first)
    is_small = F.col("rank") >= F.col("_rows") - CELL_ROWS
    between = rest.where(~is_small).withColumn("times", F.col("whole") + step(F.col("rank") + 1) - step(F.col("rank")))
    took = F.sum(F.col("size") * (F.col("fraction") - (F.col("times") - F.col("whole"))))
    carried = stored(between.groupBy(of).agg(took.alias("_between")), "mix-between")
    start = F.col("_left") + F.coalesce("_between", F.lit(0.0))
    small = settled(beside(rest.where(is_small), carried).withColumn("start", start))
    return large.select(*_CHOSEN).unionByName(small.select(*_CHOSEN)).unionByName(between.select(*_CHOSEN)).unionByName(empty.select(*_CHOSEN))


def score(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and the words that the mix takes of the document."""
    mixed = mix(docs, **options)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times")


def repeat(docs: DataFrame, **options) -> DataFrame:
    """The documents with all their columns, each as often as the mix takes it.

    Rows that repeat id, source and text share their copies evenly: each gets the whole number, and the rest goes to
    as many of them as there are copies left. Only documents that are taken are joined back.
    """
    taken = mix(docs, **options).groupBy("text_key", F.col("source").alias("_source")).agg(F.sum("times").alias("_times"), F.count(F.lit(1)).alias("_rows"))
    taken = stored(taken.where("_times > 0"), "mix-taken").withColumnRenamed("text_key", "_key")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), docs["source"].alias("_from"), F.xxhash64(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), text).alias("_hash"))
    rows = rows.withColumn("_row_id", F.monotonically_increasing_id())
    joined = rows.join(taken, (F.col("_hash") == F.col("_key")) & F.col("_from").eqNullSafe(F.col("_source")))
    copies = F.expr("explode(array_repeat(0, cast(_n AS int)))")
    pick = lambda part: part.select("row", copies.alias("_copy")).select("row.*")
    single = pick(joined.where("_rows = 1").withColumn("_n", F.col("_times")))
    if taken.where("_rows > 1").isEmpty():
        return single
    # Rows are numbered as they are scanned, so that even a third of all rows with one id is cut into cells.
    same, luck = F.xxhash64("_key", "_source").alias("_same"), F.xxhash64("_row_id").alias("_luck")
    several = joined.where("_rows > 1").select("row", "_times", F.col("_rows").alias("_of"), "_row_id", same, luck)
    numbered = ranked(several, "_same", "_luck", ["_luck", "_row_id"])
    return single.union(pick(numbered.withColumn("_n", F.expr("_times div _of + IF(rank < _times % _of, 1, 0)"))))


__all__ = ["mix", "repeat", "score", "source_table", "water_level"]
