"""Materialised intermediate tables.

Long plans and driver loops are cut by writing a Parquet table into the shared
folder named by ``spark.checkpoint.dir`` and reading it back.  The table outlives
lost executors and is column-pruned by its readers.  Its size in files says little about
its size in memory: sorted ids, paths and repeated names shrink by a factor of ten and
more, and rows that are exploded after the scan count for nothing.  So its joins are merge
joins; one that should be a broadcast asks for it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables, as the cluster configures it.

    Only a local master gets a folder of its own when the setting is absent: on a
    cluster a machine-local path would not be seen by the other executors.
    """
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{_SETTING} must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="taxalign-")
    spark.conf.set(_SETTING, folder)
    return folder


def _app_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/taxalign-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_app_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str = "step", merge: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it, which is not broadcast unasked.

    Without ``merge`` the optimizer goes by the size of the files: for tables of ids that do not shrink.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out.hint("merge") if merge else out


def _hadoop_folder(spark: SparkSession):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_app_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def has_staged(spark: SparkSession) -> bool:
    """Whether this application's folder of intermediate tables exists."""
    files, path = _hadoop_folder(spark)
    return files.exists(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete every intermediate table this application has written."""
    files, path = _hadoop_folder(spark)
    files.delete(path, True)
