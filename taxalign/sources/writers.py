"""Tables to files; each writes one folder of part files, in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.table import row_counts


#: Values as they are: blanks at either end belong to them.
_CSV = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "",
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.drop("_ord").write.mode(mode).csv(path, **_CSV)


def write_exemplars(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_csv(table, path, mode)


def write_alignment(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_csv(report, path, mode)


def scatter(df: DataFrame, dest: str, column: str = "mode", mode: str = "errorifexists") -> DataFrame:
    """One sub-folder per value of ``column``, the column itself left out; returns the counts."""
    df.write.mode(mode).partitionBy(column).csv(dest, **_CSV)
    return row_counts(df, column)
