"""Stored tables: one that a merge rewrites only where its batch touches it and that tells what each version changed, and a log with snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableops.operators.upsert import BROADCAST_ROWS, NAMED_ROWS, apply_changes, as_of_version, change_feed
from tableops.workdir import delete_folder, file_sizes, glob_paths, move_folder, work_dir

#: A commit has a row for each bucket, and one without a bucket.
COMMIT = "bucket int, at long, version long"


#: Batches are broadcast only if their files, as stored, have at most so many bytes (and BROADCAST_ROWS rows).
BROADCAST_BYTES = 16 << 20
#: Buckets that hold more files than this on average, under this size, are written together again.
LOOSE_FILES, LOOSE_BYTES = 4, 4 << 20


def few_rows(batch: DataFrame) -> int | None:
    """The number of rows of a written batch if they are few and short enough to be broadcast, else None."""
    files = batch.inputFiles()
    if not files:
        return 0 if batch.isEmpty() else None
    size = batch.sparkSession.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0]
    rows = batch.count() if size <= BROADCAST_BYTES else None
    return rows if rows is not None and rows <= BROADCAST_ROWS else None


class StoredTable:
    """Rows in buckets by the hash of their keys; a version is a list of where each bucket was written last.

    data/version__=N/bucket__=B   rows of bucket B, as version N wrote them
    changes/version__=N            what version N changed, as rows of a change feed; if it only filled empty buckets, its data say it
    commits/version__=N            for each bucket that has rows, the version that wrote it; written last, once the others are complete

    A merge finds the buckets of its batch, reads and rewrites those alone, and lists the others where they were. A version
    that is there is never written again, so a replayed batch changes nothing; one that failed half way has no commit, and
    is overwritten. The lists hold at most one row a bucket, whatever the size of the table. The data of the newest `keep` versions stay;
    lists and changes stay until forget_changes.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = 64, keep: int = 3, row_keys: Sequence[str] | None = None):
        """row_keys tell rows apart in the change feed (keys by default); rows are dealt to buckets by keys."""
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        self.buckets, self.keep, self.row_keys = buckets, keep, list(row_keys or keys)

    def committed(self) -> list[int]:
        """All versions whose changes can be read."""
        return sorted(int(p.rsplit("/", 2)[1].removeprefix("version__=")) for p in glob_paths(self.spark, f"{self.path}/commits/version__=*/_SUCCESS"))

    def versions(self) -> list[int]:
        """The versions whose rows can be read."""
        return self.committed()[-self.keep :]

    def hash_of(self) -> Column:
        return F.xxhash64(*(F.col(k).cast(self.schema[k].dataType) for k in self.keys))

    def bucket_of(self) -> Column:
        return F.pmod(self.hash_of(), F.lit(self.buckets)).cast("int")

    def places(self, version: int | None) -> dict[int, int]:
        """bucket -> the version whose folder has its rows."""
        if version is None:
            return {}
        listed = self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits/version__={version}")
        return {row["bucket"]: row["at"] for row in listed.where("bucket IS NOT NULL").collect()}

    def _rows(self, places: dict[int, int]) -> DataFrame:
        if not places:  # an empty relation that the optimizer knows to be one, so that a first merge joins nothing
            return self.spark.range(0).where("false").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields))
        whole = T.StructType([*self.schema.fields, T.StructField("version__", T.LongType()), T.StructField("bucket__", T.IntegerType())])
        reader = self.spark.read.schema(whole).option("basePath", f"{self.path}/data")
        return reader.parquet(*(f"{self.path}/data/version__={at}/bucket__={b}" for b, at in sorted(places.items()))).select(*self.schema.names)

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or an earlier one that is still kept."""
        there = self.versions()
        if version is not None and version not in there:
            raise ValueError(f"version {version} is not kept; there are {there}")
        return self._rows(self.places(version if version is not None else there[-1] if there else None))

    latest = read

    def _among(self, df: DataFrame, named: DataFrame, how: str) -> DataFrame:
        """Rows whose key's hash is among the named (or is not)."""
        return df.withColumn("__hash", self.hash_of()).join(F.broadcast(named), "__hash", how).select(*df.columns)

    def _loose(self, places: dict[int, int]) -> bool:
        sizes = [n for b, at in places.items() for n in file_sizes(self.spark, f"{self.path}/data/version__={at}/bucket__={b}/*.parquet")]
        return len(sizes) > LOOSE_FILES * len(places) and sum(sizes) < LOOSE_BYTES * len(sizes)

    def merge(self, batch: DataFrame, version: int, change: Callable[[DataFrame, DataFrame], DataFrame], only_keys: bool = False, stable: bool = False) -> None:
        """Makes a version: change(rows of the buckets that batch has keys of, batch) gives those buckets' new rows.

        only_keys says that change leaves rows alone whose keys batch doesn't have: it gets none but the others, or few more, the rest
        are written as they are, and the feed compares none of them. stable says that batch is read from files that stay until the
        merge is done, and gives the same rows each time: then it isn't written first.
        """
        there = self.versions()
        if version in there:
            return
        if there and there[-1] > version:
            raise ValueError(f"version {version} would come after {there[-1]}")
        # Written once, so that buckets and rows can't differ between two evaluations of the batch.
        staged_path = None if stable else work_dir(self.spark, "batch")
        if staged_path:
            batch.write.parquet(staged_path)
            batch = self.spark.read.schema(batch.schema).parquet(staged_path)
        places = self.places(there[-1] if there else None)
        # At most one row a bucket.
        touched = {row["b"]: row["count"] for row in batch.groupBy(self.bucket_of().alias("b")).count().collect()} if places else {}
        stood = {b: at for b, at in places.items() if b in touched}
        old = self._rows(stood)
        named = batch.select(self.hash_of().alias("__hash")).distinct() if only_keys and stood and sum(touched.values()) <= NAMED_ROWS else None
        met = old if named is None else self._among(old, named, "left_semi")
        placed = lambda df: df.select(*self.schema.names).withColumn("bucket__", self.bucket_of())
        # A large bucket is written by several tasks, small ones share one.
        if named is None or self._loose(stood):
            made = change(met, batch)
            made = placed(made if named is None else made.select(*self.schema.names).unionByName(self._among(old, named, "left_anti"))).hint("rebalance", F.col("bucket__"))
        else:
            # Rows that stay are read by bucket already.
            made = placed(change(met, batch)).hint("rebalance", F.col("bucket__")).unionByName(placed(self._among(old, named, "left_anti")))
        made.write.mode("overwrite").partitionBy("bucket__").parquet(f"{self.path}/data/version__={version}")
        written = {int(p.rsplit("=", 1)[1]) for p in glob_paths(self.spark, f"{self.path}/data/version__={version}/bucket__=*")}
        new = {b: at for b, at in places.items() if b not in touched} | {b: version for b in written}
        delete_folder(self.spark, f"{self.path}/changes/version__={version}")
        if stood:
            now = self._rows({b: version for b in written})
            if named is not None:
                now = self._among(now, named, "left_semi")
            elif only_keys:
                keys = batch.select(*(F.col(k).cast(self.schema[k].dataType).alias(f"__{k}") for k in self.keys)).distinct()
                on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys]
                met, now = old.join(keys, on, "left_semi"), now.join(keys, on, "left_semi")
            feed = change_feed(met, now, self.row_keys).withColumn("_commit_version", F.lit(version).cast("long"))
            feed.write.mode("overwrite").parquet(f"{self.path}/changes/version__={version}")
        rows = [F.struct(F.lit(b).cast("int").alias("bucket"), F.lit(at).cast("long").alias("at"), F.lit(version).cast("long").alias("version")) for b, at in [(None, None), *sorted(new.items())]]
        self.spark.range(1, numPartitions=1).select(F.inline(F.array(*rows))).write.mode("overwrite").parquet(f"{self.path}/commits/version__={version}")
        if staged_path:
            delete_folder(self.spark, staged_path)
        self._vacuum([*there, version][-self.keep :], {version: new})

    def _told(self) -> set[int]:
        """Versions that have change rows of their own; the others that are committed only inserted what they wrote."""
        return {int(p.rsplit("/", 2)[1].removeprefix("version__=")) for p in glob_paths(self.spark, f"{self.path}/changes/version__=*/_SUCCESS")}

    def _vacuum(self, kept: list[int], known: dict[int, dict[int, int]]) -> None:
        """Deletes folders of buckets that no kept version names; those that are a version's only record of its inserts become its changes."""
        named = {(at, b) for version in kept for b, at in (known.get(version) or self.places(version)).items()}
        inserts = set(self.committed()) - self._told()
        for path in glob_paths(self.spark, f"{self.path}/data/version__=*/bucket__=*"):
            at, bucket = (int(x.rsplit("=", 1)[1]) for x in path.rsplit("/", 2)[1:])
            if at <= kept[-1] and (at, bucket) not in named:
                if at in inserts:
                    move_folder(self.spark, path, f"{self.path}/changes/version__={at}")
                else:
                    delete_folder(self.spark, path)

    def changes(self, versions: Iterable[int]) -> DataFrame:
        """Change rows of versions, from their own files: insert, update_preimage, update_postimage, delete."""
        kind, at = T.StructField("_change_type", T.StringType()), T.StructField("_commit_version", T.LongType())
        versions, told = list(versions), self._told()
        paths = [f"{self.path}/changes/version__={v}" for v in versions if v in told]
        parts = [self.spark.read.schema(T.StructType([kind, *self.schema.fields, at])).parquet(*paths)] if paths else []
        for v in versions:
            # The data of a version are moved, bucket by bucket, once no kept version needs them.
            folders = [] if v in told else [p for part in ("data", "changes") for p in glob_paths(self.spark, f"{self.path}/{part}/version__={v}/bucket__=*")]
            if folders:
                rows = self.spark.read.schema(self.schema).parquet(*folders)
                parts.append(rows.select(F.lit("insert").alias("_change_type"), *self.schema.names, F.lit(v).cast("long").alias("_commit_version")))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], T.StructType([kind, *self.schema.fields, at]))

    def forget_changes(self, before: int) -> None:
        """Deletes the change rows of versions under `before`, which no reader needs any more."""
        for version in self.committed()[: -self.keep]:
            if version < before:
                delete_folder(self.spark, f"{self.path}/commits/version__={version}")
                delete_folder(self.spark, f"{self.path}/changes/version__={version}")


class VersionLog:
    """An append-only log of changes by version, with snapshots: a version is read from the nearest one before it and the changes after that.

    log/version__=N         rows that version N sets, and `_deleted`
    snapshots/version__=N   the table as it stood at version N
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)

    def _written(self, part: str) -> list[int]:
        # Spark moves a version's folder here once its write has succeeded; a snapshot is whole when its mark is there.
        found = glob_paths(self.spark, f"{self.path}/{part}/version__=*" + ("/_SUCCESS" if part == "snapshots" else ""))
        return sorted(int(p.removesuffix("/_SUCCESS").rsplit("=", 1)[1]) for p in found)

    def append(self, changes: DataFrame, version: int) -> None:
        """Writes a version's changes, at most one a key; a repeated call writes the same again."""
        self.append_all(changes.withColumn("_version", F.lit(version).cast("long")))

    def append_all(self, changes: DataFrame) -> None:
        """Writes several versions at once, told apart by _version; those that are there already are written again."""
        rows = changes.select(*self.schema.names, "_deleted", F.col("_version").alias("version__"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version__").parquet(f"{self.path}/log")

    def tail(self, after: int, version: int) -> DataFrame:
        """Changes of the versions after one, up to another, with _version: no other file is listed or read."""
        fields = T.StructType([*self.schema.fields, T.StructField("_deleted", T.BooleanType()), T.StructField("version__", T.LongType())])
        paths = [f"{self.path}/log/version__={v}" for v in self._written("log") if after < v <= version]
        if not paths:
            return self.spark.createDataFrame([], fields).withColumnRenamed("version__", "_version")
        return self.spark.read.schema(fields).option("basePath", f"{self.path}/log").parquet(*paths).withColumnRenamed("version__", "_version")

    def as_of(self, version: int) -> DataFrame:
        """The table as it stood at a version."""
        start = max((v for v in self._written("snapshots") if v <= version), default=None)
        tail = self.tail(-1 if start is None else start, version)
        if start is None:
            return as_of_version(tail, self.keys, version)
        snapshot = self.spark.read.schema(self.schema).parquet(f"{self.path}/snapshots/version__={start}")
        base = snapshot.withColumns({"_deleted": F.lit(False), "_version": F.lit(start).cast("long")})
        return as_of_version(base.unionByName(tail), self.keys, version)

    def snapshot(self, version: int) -> None:
        """Writes a version whole, from the snapshot before it."""
        self.as_of(version).write.mode("overwrite").parquet(f"{self.path}/snapshots/version__={version}")

    def revert(self, version: int) -> DataFrame:
        """Change rows that bring the newest version back to an earlier one."""
        newest = max(self._written("log"), default=version)
        return change_feed(self.as_of(newest), self.as_of(version), self.keys).where("_change_type <> 'update_preimage'")


def apply_feed(target: DataFrame, changes: DataFrame, keys: Sequence[str], source_rows: int | None = None, stable: bool = False) -> DataFrame:
    """Target after the change rows of one or more versions: what a reader of the feed makes of its copy. For stable see apply_changes."""
    last = changes.where("_change_type <> 'update_preimage'")
    return apply_changes(target, last, keys, "_commit_version", delete_when=F.col("_change_type") == "delete", source_rows=source_rows, stable=stable)
