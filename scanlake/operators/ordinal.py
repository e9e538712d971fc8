"""Numbering and running totals that do not gather a key in one task.

`Window.partitionBy(report).orderBy(pos)` sends a whole report to one task; one
report may hold a third of all rows.  Both operators below split a key first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanlake.session import stable

BLOCK_BITS = 20


def prefix_sums(
    df: DataFrame, keys: Sequence[str], pos: str, sums: dict[str, Column],
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Add running totals per key in `pos` order, counting the row itself.

    `pos` is a long, unique per key, so a block of 2**block_bits consecutive
    values holds a bounded number of rows.  Block totals (one row per block) are
    accumulated first; the rows then add their own block's running total to the
    sum of the blocks before it.  Keys must not be NULL.
    """
    blocked = df.withColumn("_block", F.shiftright(F.col(pos).cast("long"), block_bits))
    for name, value in sums.items():
        blocked = blocked.withColumn("_v_" + name, value)
    group = [*keys, "_block"]
    totals = blocked.groupBy(*group).agg(
        *[F.sum("_v_" + n).alias("_t_" + n) for n in sums]
    )
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *group,
        *[F.coalesce(F.sum("_t_" + n).over(before), F.lit(0)).alias("_o_" + n) for n in sums],
    )
    within = W.partitionBy(*group).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    out = blocked.join(offsets, group)
    for n in sums:
        out = out.withColumn(n, F.sum("_v_" + n).over(within) + F.col("_o_" + n))
    return out.drop(
        "_block", *["_v_" + n for n in sums], *["_o_" + n for n in sums]
    )


def number_by_pos(df: DataFrame, keys: Sequence[str], pos: str, name: str) -> DataFrame:
    """Row number per key in the order of a unique long position."""
    return prefix_sums(df, keys, pos, {name: F.lit(1).cast("long")})


def number_by_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str,
    partitions: int | None = None,
) -> DataFrame:
    """Row number per key in an arbitrary total order.

    Rows are range-partitioned by (keys, order), so a large key spreads over many
    partitions.  The ranged rows are checkpointed: their partition and their place
    in it are then fixed, and a row's number is its place plus the counts of the
    earlier partitions of its key.
    """
    lead = [F.col(k) for k in keys]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stable(
        df.repartitionByRange(n, *lead, *order)
        .sortWithinPartitions(*lead, *order)
        .withColumn("_num_id", F.monotonically_increasing_id())
        .withColumn("_num_part", F.shiftright("_num_id", 33))
    )
    counts = ranged.groupBy(*keys, "_num_part").agg(
        F.count("*").alias("_n"), F.min("_num_id").alias("_num_first")
    )
    before = W.partitionBy(*keys).orderBy("_num_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_num_part", "_num_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_num_before")
    )
    return (
        ranged.join(offsets, [*keys, "_num_part"])
        .withColumn(name, F.col("_num_before") + F.col("_num_id") - F.col("_num_first") + 1)
        .drop("_num_id", "_num_part", "_num_first", "_num_before")
    )


def first_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int
) -> DataFrame:
    """The first k rows per key, with their rank as `_rank`.

    A rank filter with a small constant lets Spark keep only k rows per key and
    map task before the shuffle, so a hot key stays small.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
