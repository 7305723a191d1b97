"""A run log followed as a stream: the state of each run, and runs that nobody has heard of for too long."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableops.functions.columns import ntz
from tableops.operators.analytics import mark_stale
from tableops.operators.stored import StoredTable
from tableops.streaming.streams import run_available

KEYS = ["process", "run_id"]
TIMES = ["status_at", "started", "ended", "timed_out"]


def run_table_schema(log: T.StructType) -> T.StructType:
    """Columns of the stored table of runs: what is known of each, as parts that merge in any order."""
    keys = [T.StructField(k, log[k].dataType) for k in KEYS]
    return T.StructType([*keys, T.StructField("status", T.StringType()), *(T.StructField(c, T.TimestampNTZType()) for c in TIMES)])


def merge_parts(parts: DataFrame) -> DataFrame:
    """One row a run: its newest status (of one time the greatest), first and last times, and when it was last given up."""
    newest = F.struct("status_at", "status")
    return parts.groupBy(*KEYS).agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), newest)).alias("status"),
        *(F.min(c).alias(c) if c == "started" else F.max(c).alias(c) for c in TIMES),
    )


def run_parts(log: DataFrame) -> DataFrame:
    """One row a run of what a log of (process, run_id, status, at) says of it: a part that merge_parts adds to others.

    Rows without time or status say nothing and are left out.
    """
    at, status = F.col("at"), F.col("status").cast("string")
    said = log.where("at IS NOT NULL AND status IS NOT NULL").select(*KEYS, status.alias("status"), at.alias("status_at"), at.alias("started"), F.when(status != "RUNNING", at).alias("ended"), ntz(F.lit(None)).alias("timed_out"))
    return merge_parts(said)


def merge_log(table: StoredTable, log: DataFrame, version: int, timeout: timedelta, lateness: str) -> None:
    """Makes a version of a stored table of runs from more of their log, by one grouping of both.

    The watermark is `lateness` before the newest time met, which the table holds, so that a stream that starts again finds it
    there. Rows not after it, as it stood before this log, are dropped. Open runs that said nothing for `timeout` before it, as
    this log leaves it, are given up, whether the log names them or not. What comes of them later is merged, and a logged end
    counts for more than a time-out.
    """
    if version in table.versions():
        return
    wait, late = F.make_dt_interval(secs=F.lit(timeout.total_seconds())), F.expr(f"INTERVAL {lateness}")
    known = [v for v in table.versions() if v < version]
    before = table.read(known[-1]) if known else None
    # As text, so that no time zone plays a part.
    met = before.agg(F.max("status_at").cast("string")).first()[0] if known else None
    fresh = log.where("at IS NOT NULL AND status IS NOT NULL")
    if met is not None:
        fresh = fresh.where(F.col("at") > ntz(F.lit(met)) - late)
    last = fresh.agg(F.greatest(F.max("at"), ntz(F.lit(met))).cast("string")).first()[0]
    mark = ntz(F.lit(last)) - late
    overdue = (F.col("status") == "RUNNING") & (F.col("status_at") + wait < mark)
    parts = run_parts(fresh)
    if known:
        # Runs that the table can give up are named by empty parts, so that their buckets are merged too.
        silent = before.where(overdue & (F.col("timed_out").isNull() | (F.col("timed_out") < F.col("status_at") + wait)))
        parts = parts.unionByName(silent.select(*KEYS, *(F.lit(None).cast(table.schema[c].dataType).alias(c) for c in ("status", *TIMES))))

    def change(old: DataFrame, new: DataFrame) -> DataFrame:
        return merge_parts(old.unionByName(new)).withColumn("timed_out", F.greatest("timed_out", F.when(overdue, F.col("status_at") + wait)))

    table.merge(parts, version, change, only_keys=True)


def follow_runs(log: DataFrame, table: StoredTable, timeout: timedelta, lateness: str, checkpoint: str) -> None:
    """Brings a stored table of runs (keys process and run_id) up to date with all there is of a log, and waits for it."""
    run_available(log, checkpoint, batch=lambda df, n: merge_log(table, df, n, timeout, lateness))


def followed_runs(table: StoredTable, timeout: timedelta) -> DataFrame:
    """Runs as run_state and mark_stale give them, where open runs also are STALE that said nothing for `timeout`, ended at its end.

    A run given up is open again if it speaks again. Whether a newer run makes one STALE is decided here and not kept: when
    the newer one ends, the one before it may be the newest that is running.
    """
    wait = F.make_dt_interval(secs=F.lit(timeout.total_seconds()))
    given_up = (F.col("status") == "RUNNING") & (F.col("timed_out") >= F.col("status_at") + wait)
    runs = table.read().withColumns({"status": F.when(given_up, "STALE").otherwise(F.col("status")), "ended": F.when(given_up, F.col("timed_out")).otherwise(F.col("ended"))})
    return mark_stale(runs.select(*KEYS, "status", "started", "ended"))
