"""Streams over files and tables, and micro-batch upserts that a replay does not change."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tableops.functions.columns import with_audit_columns
from tableops.operators.stored import COMMIT, StoredTable, few_rows
from tableops.operators.upsert import apply_changes, dedup_latest, scd2_merge, splice_changes, upsert
from tableops.workdir import delete_folder, glob_paths


def stream_files(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "json", glob: str | None = None, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(kind)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_table(spark: SparkSession, path: str, schema: T.StructType | str, max_files: int | None = None, after: Column | None = None) -> DataFrame:
    """Rows appended to a table, from the first one for which `after` (a condition on a version column, say) holds."""
    stream = stream_files(spark, path, schema, "parquet", "*.parquet", max_files)
    return stream if after is None else stream.where(after)


def start_stream(stream: DataFrame, checkpoint: str, path: str | None = None, batch: Callable[[DataFrame, int], None] | None = None, partition_by: Sequence[str] = (), **trigger) -> StreamingQuery:
    """Starts the stream: appended to path, or handed to a batch function. trigger is that of Spark (all there is now, by default)."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    if batch is not None:
        return writer.foreachBatch(batch).start()
    writer = writer.format("parquet").outputMode("append")
    return (writer.partitionBy(*partition_by) if partition_by else writer).start(path)


def run_available(stream: DataFrame, checkpoint: str, path: str | None = None, batch: Callable[[DataFrame, int], None] | None = None, partition_by: Sequence[str] = ()) -> None:
    """Runs the stream over what there is, and waits for it."""
    start_stream(stream, checkpoint, path, batch, partition_by).awaitTermination()


def full_refresh(spark: SparkSession, checkpoint: str, *paths: str) -> None:
    """Forgets what a stream has read and written, so that its next run starts anew; repeatable."""
    for path in (checkpoint, *paths):
        delete_folder(spark, path)


def fan_out(stream: DataFrame, key: str, path: str, checkpoint: str) -> None:
    """One table a key value, by one stream and one listing; a replayed batch writes the same folder again."""
    run_available(stream, checkpoint, batch=lambda df, n: df.write.mode("overwrite").partitionBy(key).parquet(f"{path}/batch={n}"))


def stream_staging(stream: DataFrame, path: str, checkpoint: str, at: Column | None = None) -> None:
    run_available(with_audit_columns(stream, at), checkpoint, path, partition_by=["processed_date"])


def tumbling_average(stream: DataFrame, ts: str, columns: Sequence[str], size: str, lateness: str) -> DataFrame:
    """Averages by tumbling window; a window comes out once the watermark has passed its end."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    found = timed.groupBy(F.window(ts, size).alias("w")).agg(*(F.avg(c).alias(f"avg_{c}") for c in columns), F.count("*").alias("n"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), *(f"avg_{c}" for c in columns), "n")


def stream_dedup(stream: DataFrame, keys: Sequence[str], ts: str, lateness: str) -> DataFrame:
    """Rows whose key has not been met within the lateness."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(keys))


class VersionedTable:
    """A table as one folder a batch: batch n is made from the newest batch before it, so a replay writes the same again.

    Which batches there are is read from the folders each time (those whose write was completed), never kept in
    memory: a stream that is started again after a failure goes on from them. The newest `keep` versions stay.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keep: int = 3):
        if keep < 2:
            raise ValueError("a replay of the newest version needs the one before it: keep 2 or more")
        self.spark, self.path, self.schema, self.keep = spark, path, schema, keep

    def versions(self) -> list[int]:
        done = glob_paths(self.spark, f"{self.path}/v=*/_SUCCESS")
        return sorted(int(p.rsplit("/", 2)[1].removeprefix("v=")) for p in done)

    def _read(self, versions: list[int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={versions[-1]}")

    def before(self, n: int) -> DataFrame:
        return self._read([v for v in self.versions() if v < n])

    def write(self, df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={n}")
        for old in self.versions()[: -self.keep]:
            delete_folder(self.spark, f"{self.path}/v={old}")

    def latest(self) -> DataFrame:
        return self._read(self.versions())

    def merge(self, batch: DataFrame, n: int, change: Callable[[DataFrame, DataFrame], DataFrame], only_keys: bool = False) -> None:
        self.write(change(self.before(n), batch), n)


def stream_upsert(stream: DataFrame, table: StoredTable | VersionedTable, keys: Sequence[str], order: Sequence[Column], checkpoint: str, condition: str | None = None) -> None:
    """Upserts each batch's first row of a key in the order given; condition is SQL over t and s that an update must meet (see upsert).

    A stored table is rewritten only in the buckets of the batch, and a batch known to be small is broadcast.
    """

    def change(old: DataFrame, batch: DataFrame) -> DataFrame:
        rows = few_rows(batch) if isinstance(table, StoredTable) else None
        return upsert(old, dedup_latest(batch, keys, order), keys, condition=condition, source_rows=rows, checked=True)

    run_available(stream, checkpoint, batch=lambda df, n: table.merge(df, n, change, only_keys=True))


def stream_changes(stream: DataFrame, table: StoredTable, keys: Sequence[str], sequence: str, checkpoint: str, delete_when: Column | None = None) -> None:
    """Applies a change feed whose batches come in any order: the table keeps each row's sequence value, and deleted rows as tombstones (`_deleted`)."""
    run_available(stream, checkpoint, batch=lambda df, n: table.merge(df, n, lambda old, feed: apply_changes(old, feed, keys, sequence, delete_when, tombstones=True, source_rows=few_rows(feed)), only_keys=True))


def stream_scd2(stream: DataFrame, table: StoredTable | VersionedTable, keys: Sequence[str], compare: Sequence[str], effective: str, checkpoint: str, latest_only: bool = True, delete_when: Column | None = None) -> None:
    """Versions of each key from a stream. A stored table, with _kind, takes batches in any order (see splice_changes).

    latest_only keeps only each batch's last change of a key.
    """

    def change(old: DataFrame, batch: DataFrame) -> DataFrame:
        if isinstance(table, VersionedTable):
            return scd2_merge(old, batch, keys, compare, effective)
        changes = dedup_latest(batch, keys, [F.col(effective).desc()]) if latest_only else batch
        return splice_changes(old, changes, keys, effective, compare, delete_when)

    run_available(stream, checkpoint, batch=lambda df, n: table.merge(df, n, change, only_keys=True))


def follow_changes(table: StoredTable, checkpoint: str, apply: Callable[[DataFrame, int], None], start: int = 0) -> None:
    """Hands the change rows of each version of a table from `start` on to apply (rows, batch number), and remembers how far it came.

    The stream is of commits, one row a version, so that it never meets the files of a version that isn't complete.
    """

    def batch(commits: DataFrame, n: int) -> None:
        versions = sorted(row["version"] for row in commits.where("bucket IS NULL").select("version").collect() if row["version"] >= start)
        if versions:
            apply(table.changes(versions), n)

    run_available(stream_files(table.spark, f"{table.path}/commits", COMMIT, "parquet", "*.parquet"), checkpoint, batch=batch)
