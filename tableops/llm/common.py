"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import ctypes.util
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableops.workdir import delete_folder


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on a local master a new local one where that is unset (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Inside, Arrow batches hold at most `rows` rows: for what is materialized there and has wide rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def frugal(run):
    """run, for mapInArrow, in a worker that gives freed memory back when a task ends: workers live on beside the next stages'."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(ctypes.util.find_library("c") or None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return task


def discard(df: DataFrame) -> None:
    """Delete the folder of a materialized df that nothing reads any more."""
    delete_folder(df.sparkSession, df._folder)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return column.fill_null("").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def texts_of(column: pa.Array) -> list[str]:
    """Strings of a string column; null counts as empty."""
    return column.fill_null("").to_pylist()


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the signed ones Spark has."""
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)


def ddl(df: DataFrame, *more: str) -> str:
    """The schema of df, and further fields, as text."""
    return ", ".join([*(f"`{name}` {kind}" for name, kind in df.dtypes), *more])


def attach(rows: DataFrame, groups: DataFrame, keys: Sequence[str], spread: Sequence[str], salts: int = 16, how: str = "left") -> DataFrame:
    """Join rows to groups (at most one per key) so that a hot key is dealt over `salts` tasks.

    Each row takes one of the salts by the hash of its `spread` columns; groups are repeated for each
    salt, so groups should be the small side (only keys with more than one row, say).
    """
    salted = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    return dealt.join(salted, [*keys, "__salt"], how).drop("__salt")


#: Column that tells rows of one id apart by their whole text; see with_row_hash.
ROW_HASH = "__row_hash"


def with_row_hash(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn(ROW_HASH, F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))


#: Ids and row hashes of at most so many rows (some 100 bytes each) are sent to all tasks instead of shuffling texts to them.
BROADCAST_ROWS = 200_000


def matching(docs: DataFrame, chosen: DataFrame, key: str, text: str, how: str, *more: str) -> DataFrame:
    """Rows of docs joined, by id and row hash, with chosen (read twice): semi, anti, or inner with columns `more` of chosen first.

    docs may have columns of any name: they travel as one. Of more than BROADCAST_ROWS, wide rows are hashed, never sorted.
    """
    row_hash = F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    left = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(f"`{key}`").alias("left_id"), row_hash.alias("left_hash"))
    few = chosen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    right = chosen.select(F.col(key).alias("right_id"), F.col(ROW_HASH).alias("right_hash"), *more).hint("broadcast" if few else "shuffle_hash")
    joined = left.join(right, F.col("left_id").eqNullSafe(F.col("right_id")) & (F.col("left_hash") == F.col("right_hash")), how)
    return joined.select(*more, "doc") if how == "inner" else joined.select("doc.*")
