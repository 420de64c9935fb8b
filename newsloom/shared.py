"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one, and only if all tasks run on the driver's machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = java.get() if java.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="newsloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/newsloom-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def replace_table(df: DataFrame, path: str) -> None:
    """Put `df` in the place of the Parquet table under `path`, from which it may read.

    It is written beside the table first; then two renames swap them and the old one is deleted. A failure before the swap leaves
    the table as it was, one between the renames leaves it under `path` + `.old-` and a name.
    """
    spark = df.sparkSession
    jvm, name = df.sparkSession._jvm, uuid.uuid4().hex
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in ("", f".new-{name}", f".old-{name}"))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.parquet(fresh.toString())
    if files.exists(target) and not files.rename(target, old):
        raise OSError(f"cannot move {path} aside")
    if not files.rename(fresh, target):
        files.rename(old, target)
        raise OSError(f"cannot put the new table at {path}")
    files.delete(old, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    Cuts the lineage: later stages survive a lost executor by reading files, not by recomputing.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
