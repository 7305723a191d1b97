"""Aggregates, windows, numbering and reports of the gold layer."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableops.functions.columns import ntz
from tableops.workdir import delete_folder, move_files, work_dir


def star_join(fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str]], where: Column | str | None = None, how: str = "inner") -> DataFrame:
    """fact with its dimensions (frame, foreign key, its key), one after the other; a key of an earlier dimension may lead to a later one.

    A condition over all columns is pushed to where its columns come from; Spark broadcasts what is small.
    """
    out = fact
    for dim, foreign, key in dims:
        out = out.join(dim, F.col(foreign) == F.col(key), how)
    return out if where is None else out.where(where)


def averages(columns: Sequence[str]) -> list[Column]:
    return [F.avg(c).alias(f"avg_{c}") for c in columns]


def hourly_summary(df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, ntz(F.date_trunc("hour", F.col(ts))).alias("hour")).agg(*averages(columns))


def row_count_by_grain(df: DataFrame, ts: str, grain: str | None) -> DataFrame:
    """Rows with a time, by day, hour, minute, month or year, or in all."""
    if grain in (None, "all"):
        return df.agg(F.count(ts).alias("n_rows"))
    return df.groupBy(ntz(F.date_trunc(grain, F.col(ts))).alias("bucket")).agg(F.count(ts).alias("n_rows"))


def table_extent(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("least"), F.max(column).alias("greatest"), F.count(F.lit(1)).alias("n_rows"))


def moving_average(df: DataFrame, order: Sequence[str], columns: Sequence[str], n: int, partition_by: Sequence[str]) -> DataFrame:
    """Averages over a row and the n rows before it in its partition."""
    w = Window.partitionBy(*partition_by).orderBy(*order).rowsBetween(-n, 0)
    return df.withColumns({f"ma_{c}": F.avg(c).over(w) for c in columns})


def _ranged(df: DataFrame, order: Sequence[Column | str], partitions: int | None, name: str, sort: bool = True) -> DataFrame:
    """df dealt by range and written with __range, one sorted file a range; rows of equal order values are dealt by their hash.

    Written, so that ranges can't differ between a first and a second pass over them.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = work_dir(spark, name)
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    hashed = df.withColumn("__hash", F.xxhash64(*df.columns))
    dealt = hashed.repartitionByRange(n, *columns, "__hash").withColumn("__range", F.spark_partition_id())
    (dealt.sortWithinPartitions(*columns, "__hash") if sort else dealt).write.parquet(path)
    return spark.read.parquet(path)


def assign_sequence(df: DataFrame, order: Sequence[str], start: int = 1, name: str = "seq", partitions: int | None = None) -> DataFrame:
    """df numbered without gaps from start, in order; no task sees more than its range of rows, however many have the same order value.

    One shuffle: ranges are written in order, and a row's number is its place in its file after the rows of the ranges before;
    one count a range comes to the driver. Rows of equal order are numbered by their hash. Runs when it is called.
    """
    spark = df.sparkSession
    stored = _ranged(df, order, partitions, "ranged")
    total, offsets = start, []
    for row in stored.groupBy("__range").count().orderBy("__range").collect():
        offsets.append((row["__range"], total))
        total += row["count"]
    before = spark.createDataFrame(offsets, "__range int, __before long")
    placed = stored.select(*df.columns, "__range", F.col("_metadata.row_index").alias("__place"))
    return placed.join(F.broadcast(before), "__range").select(*df.columns, (F.col("__before") + F.col("__place")).cast("long").alias(name))


def running_sum(df: DataFrame, part: Sequence[str], order: Sequence[str], value: str, name: str = "running", ties: bool = True, descending: bool = False, partitions: int | None = None) -> DataFrame:
    """df with the sum of value over the rows of its part up to the row in order, a hot part dealt over many tasks.

    Two levels: rows are dealt by range of (part, order), the sums of a part in each range are added up over the ranges before (at
    most one row a range), and rows are added up inside their range. With ties, rows of equal order all get the sum with all
    of them, as a RANGE frame gives; these are added up first. Without, they follow each other by their hash. Runs when it is called.
    """
    by = [F.desc(c) if descending else F.col(c) for c in order]
    summed = df.groupBy(*part, *order).agg(F.sum(value).alias("__v")) if ties else df.withColumn("__v", F.col(value))
    stored = _ranged(summed, [*part, *by], partitions, "prefix", sort=False)
    of_range = stored.groupBy("__range", *part).agg(F.sum("__v").alias("__t"))
    before = F.sum("__t").over(Window.partitionBy(*part).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = of_range.select(F.col("__range").alias("__r"), *(F.col(c).alias(f"__{k}") for k, c in enumerate(part)), F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.sum("__v").over(Window.partitionBy("__range", *part).orderBy(*by, "__hash").rowsBetween(Window.unboundedPreceding, 0))
    on = [F.col("__range") == F.col("__r"), *(F.col(c).eqNullSafe(F.col(f"__{k}")) for k, c in enumerate(part))]
    rows = stored.withColumn("__inside", inside).join(offsets, on).withColumn(name, F.col("__inside") + F.col("__before"))
    if not ties:
        return rows.select(*df.columns, name)
    found = rows.select(*(F.col(c).alias(f"__{k}") for k, c in enumerate([*part, *order])), name)
    return df.join(found, [F.col(c).eqNullSafe(F.col(f"__{k}")) for k, c in enumerate([*part, *order])]).select(*df.columns, name)


def resume_identity(existing: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """new numbered on from the greatest key there is."""
    top = existing.agg(F.max(key)).first()[0] or 0
    return assign_sequence(new, order, top + 1, key)


def moving_average_global(df: DataFrame, order: Sequence[str], columns: Sequence[str], n: int, chunk: int = 4096) -> DataFrame:
    """Averages over a row and the n before it in the whole order, exactly, without one task for all rows.

    Numbered rows are cut into chunks; the last n rows of each chunk are also sent to the next.
    """
    size = max(chunk, n)
    rows = assign_sequence(df, order, 0, "__seq").withColumn("__chunk", F.floor(F.col("__seq") / size))
    next_too = F.when(F.col("__seq") % size >= size - n, F.array(F.col("__chunk"), F.col("__chunk") + 1)).otherwise(F.array("__chunk"))
    spread = rows.withColumn("__at", F.explode(next_too))
    w = Window.partitionBy("__at").orderBy("__seq").rowsBetween(-n, 0)
    out = spread.withColumns({f"ma_{c}": F.avg(c).over(w) for c in columns})
    return out.where("__at = __chunk").drop("__seq", "__chunk", "__at")


def recent_window(df: DataFrame, ts: str, interval: str) -> DataFrame:
    """Rows within the interval of the latest time in the data; that time is read first, so that it filters the scan."""
    latest = df.agg(F.max(ts)).first()[0]
    return df.where(F.col(ts) >= F.lit(latest).cast(dict(df.dtypes)[ts]) - F.expr(f"INTERVAL {interval}"))


def top_n_per(df: DataFrame, part: Sequence[str], metric: Column, n: int) -> DataFrame:
    """Rows ranked at most n by the metric in their part, ties kept."""
    rank = F.dense_rank().over(Window.partitionBy(*part).orderBy(metric.desc()))
    return df.withColumn("rnk", rank).where(F.col("rnk") <= n)


def top_n_global(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of an order that is total, with their rank; no global sort is needed for them."""
    return df.orderBy(*order).limit(n).withColumn("rnk", F.row_number().over(Window.orderBy(*order)))


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the order given; the remaining columns break ties, so that the winner is certain."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(F.struct(*order).alias("order"), F.struct(*rest).alias("r"))
    return df.groupBy(*keys).agg(F.max(ranked).alias("m")).select(*keys, "m.r.*")


def bin_rows(df: DataFrame, order: Sequence[str], column: str, size: int) -> DataFrame:
    """Rows in order, `size` to a bin: the bin's number and its values."""
    rows = assign_sequence(df, order, 1, "__seq").withColumn("bin", F.ceil(F.col("__seq") / size))
    return rows.groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("__seq", column))).alias("v")).select("bin", F.transform("v", lambda x: x[column]).alias("names"))


def array_allocate(slots: DataFrame, names: DataFrame, parent: str, have: str, room: str, order: str, name: str) -> DataFrame:
    """Adds new names to the slots of a parent by running count of free places: the k-th slot gets the next `room` names, last names first.

    Names are numbered in their parent and slots' rooms added up, both by running_sum; a slot's places, as many as there are names
    for, are then joined to the names of those numbers. No row holds more names than its slot gets. Rooms are not negative.
    """
    given = names.select(F.col(parent).alias("__parent"), F.col(name).alias("__name")).where(F.col("__name").isNotNull())
    numbered = running_sum(given.withColumn("__one", F.lit(1)), ["__parent"], ["__name"], "__one", "__at", ties=False, descending=True)
    there = given.groupBy("__parent").agg(F.count("*").alias("__n"))
    placed = running_sum(slots, [parent], [order], room, "__run", ties=False)
    last = F.least(F.col("__run"), F.col("__n"))
    first = F.col("__run") - F.col(room) + 1
    places = placed.where(F.col(room) > 0).join(there, F.col(parent) == F.col("__parent")).where(first <= last)
    places = places.select(F.col("__parent"), "__run", F.explode(F.sequence(first, last)).alias("__at"))
    taken = places.join(numbered.select("__parent", "__at", "__name"), ["__parent", "__at"])
    held = taken.groupBy(F.col("__parent").alias("__p"), F.col("__run").alias("__end")).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__name"))), lambda x: x["__name"]).alias("__new"))
    out = placed.join(held, (F.col(parent) == F.col("__p")) & (F.col("__run") == F.col("__end")) & (F.col(room) > 0), "left")
    return out.withColumn(have, F.array_union(have, F.coalesce("__new", F.array().cast("array<string>")))).select(*slots.columns)


def column_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """Rows, nulls, distinct values, least and greatest (as text) of every column, in one pass."""
    distinct = F.countDistinct if exact else F.approx_count_distinct
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in df.columns:
        aggs += [F.sum(F.col(c).isNull().cast("long")).alias(f"n_{c}"), distinct(c).alias(f"d_{c}"), F.min(c).cast("string").alias(f"a_{c}"), F.max(c).cast("string").alias(f"b_{c}")]
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("__n").alias("n_rows"), F.col(f"n_{c}").alias("n_nulls"), F.col(f"d_{c}").alias("n_distinct"), F.col(f"a_{c}").alias("least"), F.col(f"b_{c}").alias("greatest")) for c in df.columns))
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


PROFILE = "column_name string, n_rows long, n_nulls long, least_number double, greatest_number double, least_text string, greatest_text string, values binary, spread binary"


def profile_state(df: DataFrame) -> DataFrame:
    """What a part of a table adds to its profile: a row a column, with counts, extremes and sketches of distinct values and of quantiles.

    States are stored and merged (merge_profiles), so that a table that grows is profiled by reading its new files alone. One pass.
    """
    aggs, rows = [F.count(F.lit(1)).alias("__n")], []
    none = lambda kind: F.lit(None).cast(kind)
    for k, (c, kind) in enumerate(df.dtypes):
        number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
        value = F.col(f"`{c}`").cast("double" if number else "string")
        aggs += [F.count(F.col(f"`{c}`")).alias(f"n{k}"), F.min(value).alias(f"a{k}"), F.max(value).alias(f"b{k}"), F.hll_sketch_agg(F.col(f"`{c}`").cast("string")).alias(f"d{k}")]
        aggs += [F.kll_sketch_agg_double(value).alias(f"q{k}")] if number else []
        pick = lambda name, when, kind: F.col(name) if when else none(kind)
        fields = [F.lit(c), F.col("__n"), F.col("__n") - F.col(f"n{k}"), pick(f"a{k}", number, "double"), pick(f"b{k}", number, "double"), pick(f"a{k}", not number, "string"), pick(f"b{k}", not number, "string"), F.col(f"d{k}"), pick(f"q{k}", number, "binary")]
        rows.append(F.struct(*(f.alias(name.split()[0]) for f, name in zip(fields, PROFILE.split(", "), strict=True))))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def merge_profiles(states: DataFrame) -> DataFrame:
    """One state a column from those of any parts, in any order."""
    total = [F.sum(c).alias(c) for c in ("n_rows", "n_nulls")] + [F.min(c).alias(c) for c in ("least_number", "least_text")] + [F.max(c).alias(c) for c in ("greatest_number", "greatest_text")]
    merged = states.groupBy("column_name").agg(*total, F.hll_union_agg("values").alias("values"), F.kll_merge_agg_double("spread").alias("spread"))
    return merged.select(*(c.split()[0] for c in PROFILE.split(", ")))


def read_profile(state: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Counts, extremes, distinct values (within about 2 %) and quantiles (ranks within about 1.5 %) that a state tells."""
    at = F.when(F.col("greatest_number").isNotNull(), F.array(*(F.kll_sketch_get_quantile_double("spread", F.lit(float(q))) for q in quantiles)))
    return state.select("column_name", "n_rows", "n_nulls", F.hll_sketch_estimate("values").alias("n_distinct"), "least_number", "greatest_number", "least_text", "greatest_text", at.alias("quantiles"))


def rank_layout_columns(usage: DataFrame, table: str, column: str, measures: Sequence[str]) -> DataFrame:
    """Columns of each table by the sum of their measures, each scaled to 0..1 in its table."""
    w = Window.partitionBy(table)
    score = F.lit(0.0)
    for m in measures:
        span = F.max(m).over(w) - F.min(m).over(w)
        score = score + F.when(span > 0, (F.col(m) - F.min(m).over(w)) / span).otherwise(F.lit(0.0))
    scored = usage.withColumn("score", F.round(score, 6))
    return scored.withColumn("rnk", F.dense_rank().over(w.orderBy(F.desc("score"), column)))


def run_state(log: DataFrame) -> DataFrame:
    """Latest status, start, end and duration of each run in an append-only log (run_id, status, at)."""
    done = F.max(F.when(F.col("status") != "RUNNING", F.col("at")))
    runs = log.groupBy("process", "run_id").agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.min("at").alias("started"), done.alias("ended"))
    return runs.withColumn("seconds", F.round(F.unix_micros(F.col("ended").cast("timestamp")) / 1e6 - F.unix_micros(F.col("started").cast("timestamp")) / 1e6, 3))


def mark_stale(runs: DataFrame) -> DataFrame:
    """Runs that never ended and are older than the newest running one of their process become STALE, ended when that began."""
    # Aggregated before it is joined, so that the runs of one process need not meet in one task.
    newest_of = runs.where("status = 'RUNNING'").groupBy(F.col("process").alias("__process")).agg(F.max("started").alias("__newest"))
    newest = F.col("__newest")
    stale = (F.col("started") < newest) & (~F.col("status").isin("SUCCESS", "FAIL", "STALE") | F.col("ended").isNull())
    joined = runs.join(newest_of, F.col("process").eqNullSafe(F.col("__process")), "left")
    return joined.withColumns({"status": F.when(stale, "STALE").otherwise(F.col("status")), "ended": F.when(stale, newest).otherwise(F.col("ended"))}).select(*runs.columns)


def last_success_watermark(runs: DataFrame, processes: DataFrame, default: str = "1900-01-01 00:00:00") -> DataFrame:
    """Start of each process's newest successful run, or the default."""
    found = runs.where("status = 'SUCCESS'").groupBy("process").agg(F.max("started").alias("watermark"))
    return processes.join(found, "process", "left").withColumn("watermark", F.coalesce("watermark", F.lit(default).cast("timestamp_ntz")))


def latest_metrics(log: DataFrame) -> DataFrame:
    """Last value of each metric of each process, from a log whose metrics column is a JSON object of numbers."""
    flat = log.select("process", "at", "run_id", F.explode(F.from_json("metrics", "map<string,double>")).alias("metric", "value"))
    return flat.groupBy("process", "metric").agg(F.max_by("value", F.struct("at", "run_id")).alias("value"))


def zorder_write(df: DataFrame, path: str, columns: Sequence[str], files: int, bits: int = 5) -> None:
    """Writes df clustered by several columns at once: each is cut at its quantiles, and the buckets' bits are interleaved."""
    share = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = df.select(*(F.percentile_approx(F.col(c).cast("double"), share, 10_000).alias(c) for c in columns)).first()
    key = F.lit(0).cast("long")

    def bucket(c: str) -> Column:
        # A plain sum of comparisons, so that it stays in generated code.
        return sum(((F.col(c).cast("double") >= float(x)).cast("int") for x in sorted(set(cuts[c] or []))), F.lit(0))

    buckets = {c: bucket(c) for c in columns}
    for b in range(bits):
        for k, c in enumerate(columns):
            bit = F.shiftright(F.col(f"__b_{c}"), b).bitwiseAND(F.lit(1)).cast("long")
            key = key.bitwiseOR(F.shiftleft(bit, b * len(columns) + k))
    marked = df.withColumns({f"__b_{c}": F.coalesce(v, F.lit(0)) for c, v in buckets.items()}).withColumn("__z", key)
    marked.repartitionByRange(files, "__z").sortWithinPartitions("__z").drop("__z", *(f"__b_{c}" for c in columns)).write.mode("overwrite").parquet(path)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files at path, summed by Spark from their listing; contents are not read."""
    return spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def compact(df: DataFrame, path: str, total_bytes: int, target_bytes: int = 128 << 20) -> int:
    """Rewrites df, stored in total_bytes (see stored_bytes), as files of about the target size; returns their number."""
    files = max(1, -(-total_bytes // target_bytes))
    df.repartition(files).write.mode("overwrite").parquet(path)
    return files


#: Files that are packed into bins together: a group of a listing, in one task.
LISTED = 10_000


def plan_compaction(files: DataFrame, target_bytes: int = 128 << 20, small_share: float = 0.75) -> DataFrame:
    """path and bin of the files (path, length) under small_share of the target: bins of at most the target, first-fit decreasing.

    Files of one folder share bins; a large folder's listing is packed in groups of about LISTED. A bin of one file is left out.
    """
    small = files.where(F.col("length") < small_share * target_bytes).withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    groups = small.groupBy("folder").agg((F.floor(F.count("*") / LISTED) + 1).alias("groups"))
    dealt = small.join(groups, "folder").withColumn("part", F.pmod(F.xxhash64("path"), F.col("groups")))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "path"], ascending=[False, True])
        room: list[int] = []
        bins = []
        for length in rows["length"]:
            k = next((k for k, r in enumerate(room) if r >= length), len(room))
            if k == len(room):
                room.append(target_bytes)
            room[k] -= length
            bins.append(k)
        rows = rows.assign(bin=bins)
        return rows[rows.groupby("bin")["path"].transform("size") > 1][["path", "length", "folder", "part", "bin"]]

    return dealt.groupBy("folder", "part").applyInPandas(pack, "path string, length long, folder string, part long, bin int")


def compact_small(spark: SparkSession, path: str, target_bytes: int = 128 << 20, small_share: float = 0.75) -> int:
    """Rewrites the small files of a Parquet folder as files of about the target size, and leaves the others as they are; returns the number of new files.

    Rows of a bin go to one new file; large files are not read. New files are written beside the folder and moved in once they are
    complete, then the old ones are deleted: a reader in between meets rows twice, so none should read meanwhile (or read a
    StoredTable, whose merges do as much by their commits). Partition columns aren't known here: compact each such folder by itself.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.col("_metadata.file_path").alias("path"), "length")
    staged, plan_path = work_dir(spark, "compacting"), work_dir(spark, "plan")
    plan_compaction(listed, target_bytes, small_share).write.parquet(plan_path)
    plan = spark.read.parquet(plan_path).select("path", F.concat_ws("-", F.col("part").cast("string"), F.col("bin").cast("string")).alias("bin"))
    bins = plan.select("bin").distinct().count()
    if not bins:
        return 0
    # The size is in the listing, so that large files aren't opened; the join picks those that share a bin.
    few = spark.read.parquet(path).where(F.col("_metadata.file_size") < int(small_share * target_bytes)).select("*", F.col("_metadata.file_path").alias("__path"))
    named = few.join(plan.select(F.col("path").alias("__path"), F.col("bin").alias("__bin")), "__path").drop("__path")
    named.repartition(bins, "__bin").write.partitionBy("__bin").option("maxRecordsPerFile", 0).parquet(staged)
    old = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", F.col("_metadata.file_path").alias("__path"))
    gone = old.join(plan.select(F.col("path").alias("__path")), "__path", "left_semi").select("path")
    gone_path = work_dir(spark, "gone")
    gone.write.parquet(gone_path)
    made = move_files(spark, f"{staged}/*/*.parquet", path)
    for row in spark.read.parquet(gone_path).toLocalIterator():  # names only, a part of them at a time
        delete_folder(spark, row["path"])
    for folder in (staged, plan_path, gone_path):
        delete_folder(spark, folder)
    return made


def write_with_bloom(df: DataFrame, path: str, columns: Sequence[str], distinct: int = 1_000_000) -> None:
    writer = df.write.mode("overwrite")
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(distinct))
    writer.parquet(path)
