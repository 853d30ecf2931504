"""Comparison of a computed list of changes with a curated one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Categories of the curated list and the computed categories they equal.
CATEGORIES = {"add": "de novo", "rename": "spelling change", "split (promotion)": "split", "lump (demotion)": "lump"}


def normalize_category(category: Column) -> Column:
    out = category
    for theirs, ours in CATEGORIES.items():
        out = F.when(category == theirs, ours).otherwise(out)
    return out


def _keyed(diff: DataFrame, label: str) -> DataFrame:
    """One row per pair of names: the last one, when the table has an order."""
    keys = ["B name", "A name"]
    if "_ord" in diff.columns:
        return diff.groupBy(*keys).agg(F.max_by("category", "_ord").alias(label))
    return diff.groupBy(*keys).agg(F.max("category").alias(label))


def joined_diffs(curated: DataFrame, computed: DataFrame) -> DataFrame:
    """Full outer join on both names; `-` where a list lacks the pair."""
    j = _keyed(curated, "curated").join(_keyed(computed, "computed"), ["B name", "A name"], "full")
    side = lambda c: F.coalesce(normalize_category(F.col(c)), F.lit("-"))
    return j.select("A name", "B name", side("curated").alias("curated category"), side("computed").alias("computed category"))


def compare_diffs(curated: DataFrame, computed: DataFrame) -> DataFrame:
    """Rows where the two lists differ."""
    return joined_diffs(curated, computed).filter(F.col("curated category") != F.col("computed category"))


def diff_counts(curated: DataFrame, computed: DataFrame) -> DataFrame:
    j = joined_diffs(curated, computed)
    both = (F.col("curated category") != "-") & (F.col("computed category") != "-")
    return j.agg(F.count("*").alias("in_either"), F.count_if(both).alias("in_both"))
