"""An index of value ranges by file, so that a read opens only the files that can hold what it asks for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableops.sources.files import list_files
from tableops.workdir import glob_paths


def _is_float(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.DoubleType, T.FloatType))


class RangeIndex:
    """Least and greatest value of chosen columns in each Parquet file of a folder, partition folders included.

    The index is a table of its own, one row a file: update() reads only files that it doesn't have yet. Files that are gone
    are passed over, and files that came since the last update are read whatever they hold, so that a read is always
    right. Files are taken not to change under their name, as Spark writes them. Of the index only the paths of files to
    read come to the driver, as they must for any scan. A row of null in a column lies in no range of it, nor does NaN.
    """

    def __init__(self, spark: SparkSession, data: str, schema: T.StructType, index: str, columns: Sequence[str]):
        self.spark, self.data, self.schema, self.index, self.columns = spark, data.rstrip("/"), schema, index.rstrip("/"), list(columns)

    def _bounds_schema(self) -> T.StructType:
        bounds = [T.StructField(f"{name}_{c}", self.schema[c].dataType) for c in self.columns for name in ("least", "greatest")]
        return T.StructType([T.StructField("path", T.StringType()), T.StructField("n_rows", T.LongType()), *bounds])

    def _files(self) -> DataFrame:
        if not glob_paths(self.spark, self.data):
            return self.spark.createDataFrame([], "path string")
        return list_files(self.spark, self.data).where(F.col("path").endswith(".parquet")).select("path")

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.data).parquet(*paths)

    def known(self) -> DataFrame:
        """path, n_rows, and least_c and greatest_c of each column c, of the files that have been indexed."""
        if not glob_paths(self.spark, f"{self.index}/*.parquet"):
            return self.spark.createDataFrame([], self._bounds_schema())
        return self.spark.read.schema(self._bounds_schema()).parquet(self.index).dropDuplicates(["path"])

    def update(self) -> int:
        """Indexes files that are new, and says how many they were."""
        new = [row["path"] for row in self._files().join(self.known(), "path", "left_anti").collect()]
        if new:
            # Scans give a path as a URI, listings as it is.
            uri = F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")
            path = F.regexp_replace(F.url_decode(uri), "^file:///", "file:/").alias("path")
            value = {c: F.when(~F.isnan(c), F.col(c)) if _is_float(self.schema[c]) else F.col(c) for c in self.columns}
            bounds = [f(value[c]).alias(f"{name}_{c}") for c in self.columns for name, f in (("least", F.min), ("greatest", F.max))]
            self._read(new).groupBy(path).agg(F.count("*").alias("n_rows"), *bounds).write.mode("append").parquet(self.index)
        return len(new)

    def files_for(self, ranges: Mapping[str, tuple]) -> DataFrame:
        """Paths of the files that may hold rows whose columns lie in ranges: column -> (low, high), both included, None for no bound."""
        may = F.lit(True)
        for c, (low, high) in ranges.items():
            may = may if low is None else may & (F.col(f"greatest_{c}") >= F.lit(low))
            may = may if high is None else may & (F.col(f"least_{c}") <= F.lit(high))
        listed = self._files().join(self.known(), "path", "left")
        return listed.where(F.col("n_rows").isNull() | F.coalesce(may, F.lit(False))).select("path")

    def read(self, ranges: Mapping[str, tuple]) -> DataFrame:
        """The rows within all ranges, from the files that may hold them. The list of files is made when it is called."""
        return self._read([row["path"] for row in self.files_for(ranges).collect()]).where(self._within(ranges)).select(*self.schema.names)

    def _within(self, ranges: Mapping[str, tuple]) -> Column:
        found = F.lit(True)
        for c, (low, high) in ranges.items():
            if low is None and high is None:
                continue
            if _is_float(self.schema[c]):
                found = found & ~F.isnan(c)
            found = found if low is None else found & (F.col(c) >= F.lit(low))
            found = found if high is None else found & (F.col(c) <= F.lit(high))
        return found
