"""The composition table of RCC-5, derived from models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import rcc5


def set_relation(s: Column, t: Column) -> Column:
    """Relation of two nonempty sets given as bit masks."""
    common = s.bitwiseAND(t)
    return (F.when(s == t, rcc5.EQ).when(common == s, rcc5.LT).when(common == t, rcc5.GT)
            .when(common == 0, rcc5.DISJOINT).otherwise(rcc5.OVERLAP)).cast("int")


def derive_table(spark: SparkSession, points: int = 7) -> DataFrame:
    """(r, s, composed): what A?C can be, over all triples of nonempty subsets of some points.

    A triple is one number, so the models are a range and need no join.
    """
    n = (1 << points) - 1
    a, b, c = (F.floor(F.col("id") / d).cast("bigint") % n + 1 for d in (n * n, n, 1))
    models = spark.range(n ** 3).select(set_relation(a, b).alias("r"), set_relation(b, c).alias("s"), set_relation(a, c).alias("t"))
    return models.groupBy("r", "s").agg(F.bit_or("t").alias("composed"))
