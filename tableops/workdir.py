"""Working folders that driver and executors share, and the few file-system calls that Spark's readers don't offer."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below spark.checkpoint.dir, or on a local master below a local one where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Deletes a folder and all in it, in whatever store the path names; False if there was none."""
    system, jvm_path = _file_system(spark, path)
    return system.delete(jvm_path, True)


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match the pattern; none if the folders above don't exist."""
    system, jvm_path = _file_system(spark, pattern)
    return [str(status.getPath()) for status in system.globStatus(jvm_path) or []]


def file_sizes(spark: SparkSession, pattern: str) -> list[int]:
    """Bytes of each path that matches the pattern."""
    system, jvm_path = _file_system(spark, pattern)
    return [status.getLen() for status in system.globStatus(jvm_path) or []]


def move_folder(spark: SparkSession, path: str, folder: str) -> None:
    """Moves a folder into another of the same store, which is made if it isn't there. Contents aren't copied."""
    system, target = _file_system(spark, folder)
    system.mkdirs(target)
    # With its whole new name: some stores put a folder in the place of an empty one.
    if not system.rename(spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(target, path.rsplit("/", 1)[1])):
        raise RuntimeError(f"could not move {path}")


def move_files(spark: SparkSession, pattern: str, folder: str) -> int:
    """Moves the files that match into a folder of the same store, under new names; returns their number. Contents aren't copied."""
    system, target = _file_system(spark, folder)
    paths = glob_paths(spark, pattern)
    for path in paths:
        if not system.rename(spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(target, f"compacted-{uuid.uuid4().hex}.parquet")):
            raise RuntimeError(f"could not move {path}")
    return len(paths)
