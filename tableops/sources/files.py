"""Reading files and tables, in batches and once-only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableops.functions.columns import cast_projection


#: Times in text files, to the microsecond.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, casts: Mapping[str, str]) -> DataFrame:
    return cast_projection(spark.read.schema(schema).json(path), casts)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, casts: Mapping[str, str], header: bool = True) -> DataFrame:
    return cast_projection(spark.read.schema(schema).option("header", header).csv(path), casts)


def read_text_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Lines as text, with the fields of the JSON in them."""
    return spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*")


def ingest_once(spark: SparkSession, src: str, dst: str, checkpoint: str, schema: T.StructType | str) -> None:
    """Appends the files of src that earlier calls with this checkpoint have not loaded."""
    stream = spark.readStream.schema(schema).json(src)
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(dst).awaitTermination()


def ingest_full(spark: SparkSession, src: str, dst: str, schema: T.StructType | str) -> None:
    """Loads all files of src anew."""
    spark.read.schema(schema).json(src).write.mode("overwrite").parquet(dst)


def rescue_bad_records(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """df with the JSON's fields, and the whole text in `_rescued` where it doesn't fit the schema."""
    whole = T.StructType([*schema.fields, T.StructField("_rescued", T.StringType())])
    parsed = F.from_json(column, whole, {"columnNameOfCorruptRecord": "_rescued"})
    return df.withColumn("__json", parsed).select(*df.columns, "__json.*")


def with_file_metadata(df: DataFrame) -> DataFrame:
    return df.withColumns({"file_path": F.col("_metadata.file_path"), "file_name": F.col("_metadata.file_name")})


def read_between(df: DataFrame, column: str, start: Column, end: Column | None = None, limit: int | None = None) -> DataFrame:
    """Rows from start to end (now, if not given), at most `limit` of them by time if that is asked for."""
    kept = df.where(F.col(column).between(start, F.current_timestamp() if end is None else end))
    return kept if limit is None else kept.orderBy(column).limit(limit)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and modification time of the files below path; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def event_name(path: Column) -> Column:
    """The file's name without folders and endings, other characters as underscores."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+?)(\.[A-Za-z0-9]+)*$", 1), r"[^A-Za-z0-9]+", "_")
