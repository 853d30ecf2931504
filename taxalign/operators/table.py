"""Operators for any table of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def project(df: DataFrame, keep: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """Keep columns in the order given, ignoring unknown ones; then drop."""
    names = [c for c in keep if c in df.columns] if keep else list(df.columns)
    return df.select(*[c for c in names if c not in set(drop or ())])


def sort_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Order by keys as strings, ties by the whole row."""
    text = [F.col(c).cast("string") for c in [*keys, *df.columns]]
    return df.orderBy(*text)


def conform(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of another header in its order; '' where this table has none."""
    return df.select(*[F.coalesce(F.col(c), F.lit("")) .alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def stable_hash(*columns: Column | str, digits: int = 8) -> Column:
    """Leading hex digits of the SHA-1 of the `^`-joined values."""
    values = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns]
    return F.substring(F.sha1(F.concat_ws("^", *values)), 1, digits)


def row_counts(df: DataFrame, column: str = "mode") -> DataFrame:
    """Rows per value of a column."""
    return df.groupBy(column).agg(F.count("*").alias("n"))
