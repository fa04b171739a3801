"""Intermediate results that are computed once and survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Only a local session may go without the setting; it gets a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="orderloom-"))
    return context.getCheckpointDir()


def settle(table: DataFrame) -> DataFrame:
    """Compute the table now into the shared folder and go on from there."""
    context = table.sparkSession.sparkContext
    folder = shared_folder(table.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return table.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table of this application, in the shared folder."""
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove the application's intermediate tables; frames that read them cannot be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/scratch-{spark.sparkContext.applicationId}"
