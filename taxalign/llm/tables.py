"""Intermediate tables in the folder that the cluster names for them."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame

from taxalign.staging import stage


def write(df: DataFrame, label: str, merge: bool = True) -> DataFrame:
    """Write ``df`` and return a scan of it: the plan is cut, lost executors cost nothing."""
    out = stage(df, label, merge)
    out._written_at = out.inputFiles() and out.inputFiles()[0].rpartition("/")[0]
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``write`` that nothing reads any more."""
    for table in tables:
        folder = getattr(table, "_written_at", None)
        if folder:
            spark = table.sparkSession
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Have the driver collect its garbage.

    Executors keep the shuffle files of finished steps until the driver has; a loop of many
    small steps would fill their disks before it does so by itself.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` begins with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = f"_{name}"
    return name
