"""The driver's tables, and pipeline inputs that are derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableops.operators.analytics import star_join


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with every seventh repeated (a little larger in value), and no user in every eleventh."""
    e = events(spark, sf_dir).withColumn("user_id", F.when(F.col("event_id") % 11 != 0, F.col("user_id")))
    return e.unionByName(e.where("event_id % 7 = 0").withColumn("value", F.col("value") + 1))


DIRTY = """dirty AS (
    SELECT event_id, ts, CASE WHEN event_id % 11 <> 0 THEN user_id END AS user_id, event_type, value, props FROM events
    UNION ALL
    SELECT event_id, ts, CASE WHEN event_id % 11 <> 0 THEN user_id END, event_type, value + 1, props FROM events WHERE event_id % 7 = 0)"""


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of keys (user_id, event_type): band is the compared column."""
    return events(spark, sf_dir).select("user_id", "event_type", F.floor(F.col("value") / 50).cast("long").alias("band"), "ts", "event_id")


KEYED = "keyed AS (SELECT user_id, event_type, CAST(floor(value / 50) AS BIGINT) AS band, ts, event_id FROM events)"


def runs_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only run log: each event starts a run of its type, and one in four ends it well, one badly, one not at all."""
    e = events(spark, sf_dir).select(F.col("event_type").alias("process"), F.col("event_id").alias("run_id"), F.col("ts").alias("at"), F.col("value"), F.col("props").alias("metrics"))
    starts = e.select("process", "run_id", F.lit("RUNNING").alias("status"), "at")
    done = (F.col("at").cast("timestamp") + F.make_dt_interval(secs=F.floor("value") + 1)).cast("timestamp_ntz")
    ends = e.where("run_id % 4 < 3").select("process", "run_id", F.when(F.col("run_id") % 4 == 2, "FAIL").otherwise("SUCCESS").alias("status"), done.alias("at"))
    return starts.unionByName(ends)


RUNS = """log AS (
    SELECT event_type AS process, event_id AS run_id, 'RUNNING' AS status, ts AS logged FROM events
    UNION ALL
    SELECT event_type, event_id, CASE WHEN event_id % 4 = 2 THEN 'FAIL' ELSE 'SUCCESS' END, ts + to_seconds(CAST(floor(value) AS BIGINT) + 1)
    FROM events WHERE event_id % 4 < 3),
  runs AS (
    SELECT process, run_id, arg_max(status, (logged, status)) AS status, min(logged) AS started,
           max(CASE WHEN status <> 'RUNNING' THEN logged END) AS ended FROM log GROUP BY process, run_id)"""


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order and customer; date_key is the order date as yyyymmdd."""
    li, o, c = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    joined = star_join(li, [(o, "l_orderkey", "o_orderkey"), (c, "o_custkey", "c_custkey")])
    return joined.withColumn("date_key", F.date_format("o_orderdate", "yyyyMMdd").cast("int"))


STAR = """star AS (
    SELECT *, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
