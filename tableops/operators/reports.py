"""Reports over logs and facts, for any table with the columns they name. Averages come unrounded."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableops.functions.columns import date_key_to_date, ntz
from tableops.operators.analytics import _ranged


def bucketed_view(raw: DataFrame, where: Column | str, ts: str, grain: str, aggs: Mapping[str, Column], name: str = "bucket") -> DataFrame:
    """Aggregates by time bucket of the rows that meet a condition on raw columns, which is what a scan can prune by; the bucket is made after it."""
    return raw.where(where).groupBy(ntz(F.date_trunc(grain, ts)).alias(name)).agg(*(c.alias(n) for n, c in aggs.items()))


def date_key_report(fact: DataFrame, key: str, low: int, high: int, aggs: Mapping[str, Column], source: str | None = None, name: str = "day") -> DataFrame:
    """Aggregates a day of the rows whose yyyymmdd key lies between low and high, both included.

    source names the timestamp column a key was derived from: its range reaches the scan where that of the key can't.
    Rows without a key are left out; a key within the range that is no date is an error, or null where the session is not ANSI.
    """
    rows = fact.where(F.col(key).between(low, high))
    if source is not None:
        first, last = (F.to_date(F.lit(str(n)), "yyyyMMdd") for n in (low, high))
        rows = rows.where((F.col(source) >= first.cast("timestamp_ntz")) & (F.col(source) < F.date_add(last, 1).cast("timestamp_ntz")))
    return rows.groupBy(date_key_to_date(key).alias(name)).agg(*(c.alias(n) for n, c in aggs.items()))


def cost_report(runs: DataFrame, keys: Sequence[str], ts: str, value: str, since: Column | str) -> DataFrame:
    """Total, average and number of runs a key since a time, the days with runs, and runs a day.

    Days are made distinct before they are counted, with sums kept beside them, so that rows are combined before the one shuffle by key and day.
    """
    at = F.lit(since).cast("timestamp_ntz") if isinstance(since, str) else since
    value_sum, value_n = F.sum(value).alias("__sum"), F.count(value).alias("__values")
    days = runs.where(F.col(ts) >= at).groupBy(*keys, F.to_date(ts).alias("__day")).agg(value_sum, value_n, F.count("*").alias("__n"))
    total, n, n_days = F.sum("__sum"), F.sum("__n"), F.count("__day")
    return days.groupBy(*keys).agg(total.alias("total"), F.try_divide(total, F.sum("__values")).alias("average"), n.alias("n"), n_days.alias("n_days"), F.try_divide(n, n_days).alias("per_day"))


def runs_per_hour(runs: DataFrame, ts: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Number of runs and their average value an hour, for each key if there are keys."""
    return runs.groupBy(*keys, ntz(F.date_trunc("hour", ts)).alias("hour")).agg(F.count("*").alias("n"), F.avg(value).alias(f"avg_{value}"))


def json_metric_by_hour(log: DataFrame, keys: Sequence[str], ts: str, column: str, field: str) -> DataFrame:
    """Average of a number in a JSON column by key and hour; text that is no JSON or no number counts as none."""
    number = F.expr(f"try_cast(get_json_object(`{column}`, '$.{field}') AS DOUBLE)")
    return log.groupBy(*keys, ntz(F.date_trunc("hour", ts)).alias("hour")).agg(F.avg(number).alias(f"avg_{field}"))


def ordered_string_agg(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, separator: str, name: str = "texts") -> DataFrame:
    """One string a key: its texts in order, trimmed on the right, joined; null texts are left out. Equal order values go by text.

    The result is one value a key, so a key's texts meet in one task whatever the plan.
    """
    pieces = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), F.rtrim(text).alias("t")))))
    joined = F.array_join(F.transform(pieces, lambda p: p["t"]), separator)
    return df.groupBy(*keys).agg(F.when(F.count(text) > 0, joined).alias(name))


def previous_value(df: DataFrame, part: Sequence[str], order: Sequence[str], column: str, name: str, partitions: int | None = None) -> DataFrame:
    """df with the column's value in the row before, in order, of the same part; a hot part is dealt over many tasks.

    Rows are dealt by range of (part, order). The first row of a part in a range takes the last value of the nearest range before that
    has the part: at most one row a range and part. Rows of equal order follow each other by their hash. Runs when it is called.
    """
    stored = _ranged(df, [*part, *order], partitions, "previous", sort=False)
    held = F.struct(F.col(column).alias("v"))
    last = stored.groupBy("__range", *part).agg(F.max_by(held, F.struct(*order, "__hash")).alias("__last"))
    before = F.lag("__last").over(Window.partitionBy(*part).orderBy("__range"))
    edges = last.select(F.col("__range").alias("__r"), *(F.col(c).alias(f"__{k}") for k, c in enumerate(part)), before.alias("__before"))
    inside = F.lag(held).over(Window.partitionBy("__range", *part).orderBy(*order, "__hash"))
    on = [F.col("__range") == F.col("__r"), *(F.col(c).eqNullSafe(F.col(f"__{k}")) for k, c in enumerate(part))]
    return stored.withColumn("__inside", inside).join(edges, on).select(*df.columns, F.coalesce("__inside", "__before")["v"].alias(name))


def lag_gap(df: DataFrame, part: Sequence[str], order: Sequence[str], ts: str, name: str = "gap", partitions: int | None = None) -> DataFrame:
    """df with the seconds since the row before of the same part: null in its first row, or where a time is null."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    found = previous_value(df, part, order, ts, "__previous", partitions)
    return found.withColumn(name, seconds(ts) - seconds("__previous")).drop("__previous")


def table_update_gaps(history: DataFrame, part: Sequence[str], order: Sequence[str], ts: str, operation: str, operations: Sequence[str], grain: str = "hour", partitions: int | None = None) -> DataFrame:
    """Average seconds between a table's versions, of the operations named, by time bucket; history has a row a version."""
    chosen = history.where(F.col(operation).isin(*operations)).select(*dict.fromkeys([*part, *order, ts]))
    gaps = lag_gap(chosen, part, order, ts, "__gap", partitions)
    return gaps.groupBy(*part, ntz(F.date_trunc(grain, ts)).alias(grain)).agg(F.avg("__gap").alias("avg_gap"))
