"""Writing tables, intermediate tables and named files."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableops.workdir import delete_folder, work_dir


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_partitioned(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    df.write.mode("overwrite").partitionBy(*columns).parquet(path)


def replace_partitions(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Rewrites only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


class TempTables:
    """Intermediate tables of one job, written and read back. Dropping deletes their files, and is repeatable."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def materialize(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table of that name; one that had the name before is replaced once the new one is written."""
        path = work_dir(self.spark, name)
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, df: DataFrame, name: str) -> DataFrame:
        if name not in self.paths:
            return self.materialize(df, name)
        append(df, self.paths[name])
        return self.spark.read.schema(df.schema).parquet(self.paths[name])

    def drop(self, name: str) -> None:
        """Frames over the table can't be read any more."""
        path = self.paths.pop(name, None)
        if path is not None:
            delete_folder(self.spark, path)

    def drop_all(self) -> None:
        for name in list(self.paths):
            self.drop(name)


def empty_like(df: DataFrame) -> DataFrame:
    return df.limit(0)


def export_named(df: DataFrame, key: str, path: str) -> None:
    """One folder of files for each key value."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).parquet(path)


def copy_files(manifest: DataFrame) -> DataFrame:
    """Copies files (source, target) on executors; returns source, target and status. Names with a leading underscore are skipped."""

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            status = []
            for source, target in zip(batch["source"], batch["target"], strict=True):
                if posixpath.basename(source).startswith("_"):
                    status.append("SKIP")
                    continue
                try:
                    (a, read), (b, write) = pafs.FileSystem.from_uri(source), pafs.FileSystem.from_uri(target)
                    b.create_dir(posixpath.dirname(write), recursive=True)
                    with a.open_input_stream(read) as inp, b.open_output_stream(write) as out:
                        while data := inp.read(8 << 20):
                            out.write(data)
                    status.append("SUCCESS")
                except Exception as failure:  # the report is the result
                    status.append(f"FAIL: {failure}")
            yield batch.assign(status=status)

    return manifest.select("source", "target").repartition(F.col("source")).mapInPandas(copy, "source string, target string, status string")
