"""Ordered look-back that does not gather a whole key in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.session import scratch_dir


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    values: Mapping[str, Column],
    inclusive: bool = True,
    start: DataFrame | None = None,
) -> DataFrame:
    """Add, per row, the newest non-null value at or before it within its key.

    ``keys`` hold no NULL, and ``order`` identifies a row within its key.

    A plain window over ``keys`` puts a hot key on one task. Here a key is cut
    into chunks along its order, where ``chunk`` must not fall as ``order``
    rises. One aggregation with map-side partials gives the newest value of each
    chunk; a window over these few rows gives the value each chunk starts with;
    the row windows then run per ``(keys, chunk)``.

    With ``inclusive=False`` the row itself does not count. ``start`` holds, per
    key, values from before the first row, in columns named like ``values``.
    """
    keys = list(keys)
    chunked = df.withColumns({"_chunk": chunk, **{f"_now_{name}": column for name, column in values.items()}})
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])

    newest = chunked.groupBy(*keys, "_chunk").agg(
        *[
            F.max_by(f"_now_{name}", F.when(F.col(f"_now_{name}").isNotNull(), position)).alias(f"_last_{name}")
            for name in values
        ]
    )
    before_chunk = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.select(
        *keys,
        "_chunk",
        *[F.last(f"_last_{name}", ignorenulls=True).over(before_chunk).alias(f"_carry_{name}") for name in values],
    )
    if start is not None:
        initial = start.select(*keys, *[F.col(name).alias(f"_start_{name}") for name in values])
        carried = carried.join(initial, keys, "left").select(
            *keys,
            "_chunk",
            *[F.coalesce(f"_carry_{name}", f"_start_{name}").alias(f"_carry_{name}") for name in values],
        )

    within = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    )
    joined = chunked.join(carried, [*keys, "_chunk"], "left")
    found = {
        name: F.coalesce(F.last(f"_now_{name}", ignorenulls=True).over(within), F.col(f"_carry_{name}"))
        for name in values
    }
    return joined.select(*df.columns, *[column.alias(name) for name, column in found.items()])


def with_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """The rows with their place in a total order, gapless from 0, without one task for all rows.

    Rows are sorted by ranges and written with the number of their range and their place in it;
    the sizes of the ranges before, one number per partition, are then added.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, "ranked")
    df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.schema(f"{df.select('*')._jdf.schema().toDDL()}, _id bigint").parquet(path)
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    starts, total = [], 0
    for row in sizes:
        starts.append((row["_part"], total))
        total += row["n"]
    before = F.broadcast(spark.createDataFrame(starts, "_part bigint, _start bigint"))
    place = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(before, "_part").withColumn(name, place).drop("_part", "_start", "_id")
