"""Intermediate tables, written to the shared folder and read again.

A written table cuts the lineage, survives lost executors, and unlike a
checkpoint brings no constraints of the old plan with it: those of an iteration
would make each round slower to plan than the one before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from orderloom.operators.staging import shared_folder


def scratch(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def land(table: DataFrame) -> DataFrame:
    """Write the table now, and go on from what is written."""
    spark = table.sparkSession
    folder = f"{scratch(spark)}/{uuid.uuid4().hex}"
    table.write.parquet(folder)
    return spark.read.schema(table.schema).parquet(folder)


def clear(spark: SparkSession) -> None:
    """Remove the application's intermediate tables; frames that read them cannot be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
