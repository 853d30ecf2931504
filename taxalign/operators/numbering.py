"""Exact numbering of tables and of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..staging import stage


def positions(df: DataFrame, order: list[str | Column], out: str = "n") -> DataFrame:
    """Add 1, 2, 3, … over the whole table in the given (total) order.

    A range-partitioned sort may cut the table anywhere; a row's place is its place in its
    partition and the row counts of the partitions before (one small row each).
    """
    ordered = stage(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per sort partition, so a single-task window and a broadcast are bounded
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(
        out, F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_offset")


def number_within(df: DataFrame, keys: list[str], order: list[str | Column], out: str = "n") -> DataFrame:
    """Add 1, 2, 3, … within each key in the given (total) order.

    A window would put a whole group into one task; here a number is the distance of a
    row's place in the table to the place where its group starts.
    """
    placed = positions(df, [*keys, *order], "_pos")
    starts = placed.groupBy(*keys).agg(F.min("_pos").alias("_start"))
    return placed.join(starts.hint("merge"), keys).withColumn(out, F.col("_pos") - F.col("_start") + 1).drop("_pos", "_start")
