"""Cut lineage by writing an intermediate table to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tsalign-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """This application's own part of the work folder; it goes when the application ends."""
    folder = f"{work_folder(spark)}/tsalign/{spark.sparkContext.applicationId}"
    path, system = _located(spark, folder)
    if not system.exists(path):
        system.mkdirs(path)
        system.deleteOnExit(path)
    return folder


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application now; frames built on them can no longer run."""
    path, system = _located(spark, f"{work_folder(spark)}/tsalign/{spark.sparkContext.applicationId}")
    system.delete(path, True)


def _located(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def durable(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet and return a scan of the written files.

    Three uses. Row places taken from a physical partitioning must not be
    recomputed differently by two consumers. A lost executor re-reads files and
    recomputes nothing upstream. And the size of a small table becomes known
    from its files, so Catalyst broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges it above. The files
    stay until the application ends or :func:`clear_scratch` is called.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
