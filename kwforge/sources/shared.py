"""The folder that a cluster shares, and results that are written there to cut their lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: A written table of more rows than MANY in files of fewer bytes than SMALL looks small to the planner, and is not.
MANY, SMALL = 1 << 18, 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where the session has no such setting and runs in local mode (tests), a temporary folder is set; a cluster
    must name its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kwforge-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir() or found
    return found.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write a result to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a reread of the files, never the work before them. All cuts of an application lie in one
    folder, named by it; those that a returned DataFrame still reads can only go once that is read.

    The planner judges a table by the bytes of its files, and pairs take some eighty times as much in memory as in files.
    So a table of many rows in small files is marked for sort-merge joins: else the driver would broadcast it whole. The
    other side can still be broadcast, by a hint of its own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kwforge/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    back = spark.read.schema(schema).parquet(path)
    return back.hint("merge") if _bytes(spark, path) < SMALL and back.count() > MANY else back


def _bytes(spark: SparkSession, folder: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a written table that nothing needs any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
