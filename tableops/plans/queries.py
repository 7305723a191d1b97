"""Registered queries: each operator applied to the driver's tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableops.functions import columns as C
from tableops.operators import analytics as A
from tableops.operators import compare as J
from tableops.operators import reports as R
from tableops.operators import upsert as U
from tableops.operators.stored import StoredTable, VersionLog, apply_feed, few_rows
from tableops.operators.views import GroupedView
from tableops.plans.tables import DIRTY, KEYED, RUNS, STAR, dirty_events, events, keyed, runs_log, star, table
from tableops.sources import evolving, files, sinks
from tableops.sources.skipping import RangeIndex
from tableops.streaming import run_log as L
from tableops.streaming import streams as S
from tableops.workdir import work_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
EVENT_CASTS = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double"}
EVENTS_SQL = "SELECT event_id, ts, user_id, event_type, value FROM events"


#: Averages in results are rounded; a little is added first, so that values half-way round alike in any engine.


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 1e-7, 4) for c in columns})


# Scans and sources


def _as_json(spark: SparkSession, d: str, parts: int = 4) -> str:
    path = work_dir(spark, "events-json")
    events(spark, d).repartition(parts, "event_id").write.option("timestampNTZFormat", files.MICROS).json(path)
    return path


@query(EVENTS_SQL)
def ingest_json(spark, d):
    return files.read_json(spark, _as_json(spark, d), EVENT_SCHEMA, EVENT_CASTS)


@query(EVENTS_SQL)
def ingest_csv(spark, d):
    path = work_dir(spark, "events-csv")
    events(spark, d).drop("props").write.option("header", True).option("timestampNTZFormat", files.MICROS).csv(path)
    return files.read_csv(spark, path, "event_id string, ts string, user_id string, event_type string, value string", EVENT_CASTS)


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def ingest_text_json(spark, d):
    path = work_dir(spark, "props-text")
    events(spark, d).select("props").write.text(path)
    return files.read_text_json(spark, path, "k long")


@query(EVENTS_SQL)
def ingest_once(spark, d):
    src, dst, checkpoint = _as_json(spark, d), work_dir(spark, "once"), work_dir(spark, "once-state")
    for _ in range(2):  # the second run finds nothing new
        files.ingest_once(spark, src, dst, checkpoint, EVENT_SCHEMA)
    return C.cast_projection(spark.read.schema(EVENT_SCHEMA).parquet(dst), EVENT_CASTS)


@query(EVENTS_SQL)
def ingest_full(spark, d):
    src, dst = _as_json(spark, d), work_dir(spark, "full")
    for _ in range(2):
        files.ingest_full(spark, src, dst, EVENT_SCHEMA)
    return C.cast_projection(spark.read.parquet(dst), EVENT_CASTS)


@query(EVENTS_SQL)
def stream_file_ingest(spark, d):
    src, dst = _as_json(spark, d), work_dir(spark, "stream")
    S.run_available(S.stream_files(spark, src, EVENT_SCHEMA, glob="*.json", max_files=2), work_dir(spark, "state"), dst)
    return C.cast_projection(spark.read.schema(EVENT_SCHEMA).parquet(dst), EVENT_CASTS)


@query("""SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
    CASE WHEN event_id % 5 = 0 THEN '{"k": "x' || event_id || '"}' END AS _rescued FROM events""")
def rescue_bad_records(spark, d):
    bad = F.concat(F.lit('{"k": "x'), F.col("event_id"), F.lit('"}'))
    df = events(spark, d).select("event_id", F.when(F.col("event_id") % 5 == 0, bad).otherwise(F.col("props")).alias("value"))
    schema = T.StructType([T.StructField("k", T.LongType())])
    return files.rescue_bad_records(df, "value", schema).drop("value")


@query("""SELECT CASE WHEN doc_id % 14 <> 1 THEN doc_id END AS doc_id, CAST(n_chars AS DOUBLE) + doc_id % 2 * 0.5 AS n_chars,
    CASE WHEN doc_id % 14 <> 1 THEN lang END AS lang,
    CASE WHEN doc_id % 2 = 1 AND doc_id % 14 <> 1 THEN source END AS source,
    CASE WHEN doc_id % 14 = 1 THEN '{"doc_id": "x' || doc_id || '", "n_chars": ' || n_chars || '.5}' END AS _rescued FROM documents""")
def ingest_evolving(spark, d):
    """Two runs over JSON lines: the second brings a new field, a wider type and ids that the hint refuses."""
    src, out, state = (work_dir(spark, n) for n in ("evolving-json", "evolving", "evolving-state"))
    docs, odd = table(spark, d, "documents"), F.col("doc_id") % 2 == 1
    bad = F.concat(F.lit('{"doc_id": "x'), "doc_id", F.lit('", "n_chars": '), "n_chars", F.lit(".5}"))
    first = docs.where(~odd).select(F.to_json(F.struct("doc_id", "n_chars", "lang")))
    wide = F.to_json(F.struct("doc_id", (F.col("n_chars") + F.lit(0.5)).alias("n_chars"), "lang", "source"))
    for lines in (first, docs.where(odd).select(F.when(F.col("doc_id") % 14 == 1, bad).otherwise(wide))):
        lines.toDF("value").write.mode("append").text(src)
        evolving.ingest_evolving(spark, src, out, state, {"doc_id": "bigint"})
    return evolving.read_evolving(spark, out)


@query("SELECT 'events.parquet' AS file_name, count(*) AS n FROM events UNION ALL SELECT 'orders.parquet', count(*) FROM orders")
def file_row_counts(spark, d):
    name = lambda x: F.regexp_extract("file_path", r"([a-z]+\.parquet)(/[^/]*)?$", 1).alias("file_name")
    count = lambda t: files.with_file_metadata(table(spark, d, t)).groupBy(name(t)).agg(F.count("*").alias("n"))
    return count("events").unionByName(count("orders"))


@query("SELECT event_id, TIMESTAMP '2024-02-01 10:00:00' AS ingest_timestamp, TIMESTAMP '2024-02-01 10:00:00' AS processed_watermark, DATE '2024-02-01' AS processed_date FROM events")
def audit_columns(spark, d):
    return C.with_audit_columns(events(spark, d).select("event_id"), F.lit("2024-02-01 10:00:00").cast("timestamp_ntz"))


@query("SELECT event_id, value FROM events")
def stream_table_passthrough(spark, d):
    dst = work_dir(spark, "stream")
    stream = S.stream_table(spark, _stream_source(spark, d), EVENT_SCHEMA)
    S.run_available(stream.select("event_id", "value"), work_dir(spark, "state"), dst)
    return spark.read.schema("event_id long, value double").parquet(dst)


def _stream_source(spark: SparkSession, d: str, parts: int | None = None) -> str:
    """Events as files of a table, in order of time: as many as Spark makes of them, or a given number."""
    path = work_dir(spark, "events-table")
    ranged = events(spark, d).repartitionByRange(parts, "ts") if parts else events(spark, d).repartitionByRange("ts")
    ranged.sortWithinPartitions("ts").write.parquet(path)
    return path


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07'")
def read_between(spark, d):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    return files.read_between(events(spark, d).select("event_id", "ts"), "ts", t("2024-01-05 00:00:00"), t("2024-01-07 00:00:00"))


@query("SELECT event_type AS event_name, true AS has_files FROM events GROUP BY event_type")
def event_name_from_path(spark, d):
    path = work_dir(spark, "by-type")
    sinks.write_partitioned(events(spark, d), path, ["event_type"])
    listed = files.list_files(spark, path).where(F.col("path").endswith(".parquet"))
    folder = F.regexp_extract("path", r"event_type=([^/]+)/", 1)
    return listed.select(files.event_name(folder).alias("event_name"), "length").groupBy("event_name").agg((F.sum("length") > 0).alias("has_files"))


@query("SELECT a.n_nationkey AS a, b.r_regionkey AS b, a.n_nationkey || '-' || b.r_regionkey AS id FROM nation a CROSS JOIN region b")
def cross_join_ids(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.crossJoin(F.broadcast(r)).select(F.col("n_nationkey").alias("a"), F.col("r_regionkey").alias("b"), F.concat_ws("-", "n_nationkey", "r_regionkey").alias("id"))


# Sinks


@query("SELECT event_id, count(*) AS n FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events) GROUP BY event_id")
def append_twice(spark, d):
    path = work_dir(spark, "append")
    for _ in range(2):
        sinks.append(events(spark, d).select("event_id"), path)
    return spark.read.parquet(path).groupBy("event_id").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def partitioned_counts(spark, d):
    path = work_dir(spark, "partitioned")
    sinks.write_partitioned(events(spark, d), path, ["event_type"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, CAST(sum(CASE WHEN event_type = 'click' THEN value + 1 ELSE value END) AS DECIMAL(18, 2)) AS total FROM (SELECT event_type, CAST(value AS DECIMAL(18, 2)) AS value FROM events) GROUP BY event_type")
def replace_partitions(spark, d):
    path = work_dir(spark, "replaced")
    e = events(spark, d).select("event_id", "event_type", F.col("value").cast("decimal(18,2)").alias("value"))
    sinks.write_partitioned(e, path, ["event_type"])
    more = e.where("event_type = 'click'").withColumn("value", (F.col("value") + 1).cast("decimal(18,2)"))
    sinks.replace_partitions(more, path, ["event_type"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.sum("value").cast("decimal(18,2)").alias("total"))


@query("SELECT event_id, user_id FROM events")
def stream_append(spark, d):
    dst = work_dir(spark, "append")
    stream = S.stream_files(spark, _stream_source(spark, d), EVENT_SCHEMA, "parquet")
    S.run_available(stream.select("event_id", "user_id"), work_dir(spark, "state"), dst)
    return spark.read.schema("event_id long, user_id long").parquet(dst)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def fan_out_counts(spark, d):
    dst = work_dir(spark, "fan-out")
    S.fan_out(S.stream_files(spark, _stream_source(spark, d), EVENT_SCHEMA, "parquet", max_files=2), "event_type", dst, work_dir(spark, "state"))
    return spark.read.parquet(dst).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'click' UNION ALL SELECT user_id FROM events WHERE event_type = 'view') GROUP BY user_id")
def materialize_temp(spark, d):
    temp = sinks.TempTables(spark)
    temp.materialize(events(spark, d).where("event_type = 'error'"), "errors")
    temp.materialize(events(spark, d).where("event_type = 'click'"), "clicks")
    both = temp.append(events(spark, d).where("event_type = 'view'"), "clicks")
    temp.drop("errors")
    return both.groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT event_type, 'SUCCESS' AS status, count(*) AS n FROM events GROUP BY event_type")
def export_manifest(spark, d):
    src, dst = work_dir(spark, "export"), work_dir(spark, "named")
    sinks.export_named(events(spark, d), "event_type", src)
    listed = files.list_files(spark, src).where(F.col("path").endswith(".parquet"))
    kind = F.regexp_extract("path", r"event_type=([^/]+)/", 1)
    target = dst if "://" in dst else f"file://{dst}"
    manifest = listed.select(F.regexp_replace("path", "^file:/+", "file:///").alias("source"), F.concat(F.lit(f"{target}/"), kind, F.lit("/"), F.element_at(F.split("path", "/"), -1)).alias("target"))
    report_path = work_dir(spark, "report")
    sinks.copy_files(manifest).write.parquet(report_path)  # copies once, and keeps a row a file
    report = spark.read.parquet(report_path)
    counts = spark.read.option("recursiveFileLookup", "true").parquet(target).withColumn("event_type", F.regexp_extract("_metadata.file_path", r"/([a-z]+)/[^/]+$", 1)).groupBy("event_type").agg(F.count("*").alias("n"))
    done = report.select(F.regexp_extract("source", r"event_type=([^/]+)/", 1).alias("event_type"), "status").distinct()
    return done.join(counts, "event_type")


# Projections, filters, predicates


@query("SELECT event_id, CAST(value AS DECIMAL(10, 2)) AS value, CAST(user_id AS VARCHAR) AS user_id FROM events")
def cast_projection(spark, d):
    return C.cast_projection(events(spark, d), {"event_id": "bigint", "value": "decimal(10,2)", "user_id": "string"})


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def json_extract(spark, d):
    return C.json_extract(events(spark, d).select("event_id", "props"), "props", {"k": ("$.k", "int"), "missing": ("$.none", "string")}).drop("props")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS outer_inner_k FROM events")
def flatten_json(spark, d):
    schema = T.StructType([T.StructField("outer", T.StructType([T.StructField("inner", T.StructType([T.StructField("k", T.LongType())]))]))])
    nested = F.concat(F.lit('{"outer": {"inner": '), "props", F.lit("}}"))
    return C.flatten_json(events(spark, d).select("event_id", nested.alias("value")), "value", schema)


@query("SELECT event_id, ts, user_id, event_type FROM events")
def select_except(spark, d):
    return C.select_except(events(spark, d), ["props", "value"])


RULES = {"has_user": "user_id IS NOT NULL", "value_below_90": "value < 90"}


@query(f"WITH {DIRTY} SELECT event_id, user_id, value FROM dirty WHERE user_id IS NOT NULL")
def expectations_kept(spark, d):
    return J.apply_expectations(dirty_events(spark, d), RULES, ["has_user"])[0].select("event_id", "user_id", "value")


@query(f"""WITH {DIRTY} SELECT 'has_user' AS rule, count(*) AS n_rows, count(*) FILTER (user_id IS NULL) AS n_failed FROM dirty
    UNION ALL SELECT 'value_below_90', count(*), count(*) FILTER (NOT coalesce(value < 90, false)) FROM dirty""")
def expectations_report(spark, d):
    return J.apply_expectations(dirty_events(spark, d), RULES, ["has_user"])[1]


@query("SELECT event_id, ts, value FROM events WHERE user_id = 7 AND event_type = 'click'")
def point_lookup(spark, d):
    return events(spark, d).where("user_id = 7 AND event_type = 'click'").select("event_id", "ts", "value")


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31'")
def range_filter(spark, d):
    return table(spark, d, "lineitem").where("l_shipdate BETWEEN TIMESTAMP_NTZ '1997-01-01' AND TIMESTAMP_NTZ '1997-03-31'").select("l_orderkey", "l_linenumber", "l_shipdate")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND user_id NOT IN (1, 2, 3)")
def include_exclude(spark, d):
    return events(spark, d).where(F.col("event_type").isin("click", "view") & ~F.col("user_id").isin(1, 2, 3)).select("event_id", "event_type")


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def recent_window(spark, d):
    return A.recent_window(events(spark, d), "ts", "'2' DAY").select("event_id", "ts")


@query("""SELECT date_trunc('hour', ts) AS hour, round(avg(value) + 1e-7, 4) AS avg_value, count(*) AS n FROM events
    WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' AND event_type = 'click' GROUP BY 1""")
def pushdown_view(spark, d):
    chosen = "ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-01-12' AND event_type = 'click'"
    return rounded(R.bucketed_view(events(spark, d), chosen, "ts", "hour", {"avg_value": F.avg("value"), "n": F.count("*")}, "hour"), "avg_value")


@query("SELECT coalesce(max(ts) FILTER (event_type = 'none'), TIMESTAMP '1900-01-01') AS empty_mark, coalesce(max(ts), TIMESTAMP '1900-01-01') AS mark FROM events")
def default_watermark(spark, d):
    e = events(spark, d)
    none = U.high_watermark(e.where("event_type = 'none'"), "ts")
    return e.agg(F.max(none).alias("empty_mark"), F.coalesce(F.max("ts"), none).alias("mark"))


@query(f"""WITH {STAR} SELECT CAST(strptime(CAST(date_key AS VARCHAR), '%Y%m%d') AS DATE) AS order_date, round(avg(l_extendedprice) + 1e-7, 4) AS avg_price,
    round(max(l_extendedprice * l_quantity), 2) AS max_value FROM star WHERE date_key BETWEEN 19970101 AND 19970630 GROUP BY 1""")
def date_key_agg(spark, d):
    aggs = {"avg_price": F.avg("l_extendedprice"), "max_value": F.round(F.max(F.col("l_extendedprice") * F.col("l_quantity")), 2)}
    return rounded(R.date_key_report(star(spark, d), "date_key", 19970101, 19970630, aggs, "o_orderdate", "order_date"), "avg_price")


# Joins


@query(f"WITH {STAR} SELECT l_orderkey, l_linenumber, c_name, round(l_extendedprice * l_quantity, 2) AS market_value FROM star WHERE c_custkey = 42 AND c_mktsegment IS NOT NULL")
def star_join_lookup(spark, d):
    return star(spark, d).where("c_custkey = 42").select("l_orderkey", "l_linenumber", "c_name", F.round(F.col("l_extendedprice") * F.col("l_quantity"), 2).alias("market_value"))


@query(f"WITH {STAR} SELECT l_orderkey, l_linenumber, c_name, n_name, date_key FROM star JOIN nation ON c_nationkey = n_nationkey")
def star_join_wide(spark, d):
    n = table(spark, d, "nation")  # 25 rows at any size
    return star(spark, d).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("l_orderkey", "l_linenumber", "c_name", "n_name", "date_key")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_enrich(spark, d):
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"))


@query("SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def anti_join_new_keys(spark, d):
    known = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().join(known, "c_custkey", "left_anti")


@query("WITH a AS (SELECT user_id, event_type FROM events), b AS (SELECT user_id, event_type FROM events WHERE event_id % 3 = 0) SELECT user_id, event_type FROM a JOIN b USING (user_id, event_type)")
def matched_rows(spark, d):
    e = events(spark, d)
    return J.rows_matched(e.select("user_id", "event_type"), e.where("event_id % 3 = 0").select("user_id", "event_type"), multiply=True)


@query("""WITH a AS (SELECT date_trunc('day', ts) AS bucket, count(*) AS n_a FROM events GROUP BY 1),
    b AS (SELECT date_trunc('day', ts) AS bucket, count(*) AS n_b FROM events WHERE ts < TIMESTAMP '2024-01-20' AND event_id % 2 = 0 GROUP BY 1)
    SELECT bucket, n_a, n_b FROM a FULL JOIN b USING (bucket)""")
def rowcount_compare_day(spark, d):
    e = events(spark, d)
    return J.compare_row_counts(e, e.where("ts < TIMESTAMP_NTZ '2024-01-20' AND event_id % 2 = 0"), "ts", "day")


@query("SELECT 'all' AS bucket, (SELECT count(*) FROM events) AS n_a, (SELECT count(*) FROM events WHERE event_id % 2 = 0) AS n_b")
def rowcount_compare_all(spark, d):
    e = events(spark, d)
    return J.compare_row_counts(e, e.where("event_id % 2 = 0"), "ts", None)


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE value > 99)")
def changed_only(spark, d):
    e = events(spark, d)
    return U.changed_only(e.select("event_id", "user_id"), e.where("value > 99"), ["user_id"])


# Upserts and changes

_TARGET = "target AS (SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_id % 10 < 7)"
_BATCH = "batch AS (SELECT event_id, ts, user_id, event_type, value + 1 AS value FROM events WHERE event_id % 10 >= 5)"


def _target_and_batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, d).drop("props")
    return e.where("event_id % 10 < 7"), e.where("event_id % 10 >= 5").withColumn("value", F.col("value") + 1)


@query(f"""WITH {DIRTY}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts DESC, value DESC) AS k FROM dirty)
    SELECT event_id, ts, user_id, event_type, value FROM r WHERE k = 1""")
def dedup_latest(spark, d):
    return U.dedup_latest(dirty_events(spark, d), ["event_id"], [F.col("ts").desc(), F.col("value").desc()]).drop("props")


@query(f"""WITH {_TARGET}, {_BATCH} SELECT t.event_id, t.ts, t.user_id, t.event_type, coalesce(b.value, t.value) AS value FROM target t LEFT JOIN batch b USING (event_id)
    UNION ALL SELECT b.event_id, b.ts, b.user_id, b.event_type, b.value FROM batch b WHERE b.event_id NOT IN (SELECT event_id FROM target)""")
def upsert_partial_cols(spark, d):
    t, b = _target_and_batch(spark, d)
    return U.upsert(t, b, ["event_id"], ["value"])


@query(f"WITH {_TARGET}, {_BATCH} SELECT * FROM batch UNION ALL SELECT * FROM target WHERE event_id NOT IN (SELECT event_id FROM batch)")
def upsert_scd1(spark, d):
    t, b = _target_and_batch(spark, d)
    return U.upsert(t, b, ["event_id"])


_STALE = "batch AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 1 HOUR ELSE ts - INTERVAL 1 HOUR END AS ts, user_id, event_type, value + 1 AS value FROM events WHERE event_id % 10 >= 5)"


def _stale_batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t, b = _target_and_batch(spark, d)
    moved = F.expr("CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL '1' HOUR ELSE ts - INTERVAL '1' HOUR END")
    return t, b.withColumn("ts", moved)


@query(f"""WITH {_TARGET}, {_STALE} SELECT t.event_id, CASE WHEN b.ts > t.ts THEN b.ts ELSE t.ts END AS ts, t.user_id, t.event_type, CASE WHEN b.ts > t.ts THEN b.value ELSE t.value END AS value
    FROM target t LEFT JOIN batch b USING (event_id) UNION ALL SELECT * FROM batch WHERE event_id NOT IN (SELECT event_id FROM target)""")
def upsert_if_newer(spark, d):
    t, b = _stale_batch(spark, d)
    return U.upsert(t, b, ["event_id"], condition="s.ts > t.ts")


@query(f"""WITH {_TARGET}, {_STALE} SELECT t.event_id, coalesce(b.ts, t.ts) AS ts, t.user_id, t.event_type, coalesce(b.value, t.value) AS value
    FROM target t LEFT JOIN batch b ON b.event_id = t.event_id AND b.ts > t.ts
    UNION ALL SELECT * FROM batch b WHERE NOT EXISTS (SELECT 1 FROM target t WHERE b.event_id = t.event_id AND b.ts > t.ts)""")
def upsert_on_condition_faithful(spark, d):
    t, b = _stale_batch(spark, d)
    return U.upsert(t, b, ["event_id"], condition="s.ts > t.ts", faithful_on=True)


@query(f"""WITH {_TARGET}, {_BATCH}, open AS (SELECT * FROM target WHERE ts >= TIMESTAMP '2024-01-15')
    SELECT t.event_id, t.ts, t.user_id, t.event_type, coalesce(b.value, t.value) AS value FROM target t LEFT JOIN batch b ON b.event_id = t.event_id AND t.ts >= TIMESTAMP '2024-01-15'
    UNION ALL SELECT * FROM batch WHERE event_id NOT IN (SELECT event_id FROM open)""")
def upsert_time_bounded(spark, d):
    t, b = _target_and_batch(spark, d)
    return U.upsert(t, b, ["event_id"], target_pred=F.col("t.ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))


_LAST = "last AS (SELECT user_id, event_type, arg_max(band, (ts, event_id)) AS band, max(ts) AS ts FROM keyed GROUP BY user_id, event_type)"


@query(f"WITH {KEYED}, {_LAST} SELECT user_id, event_type, band, ts FROM last")
def apply_changes_scd1(spark, d):
    k = keyed(spark, d)
    return U.apply_changes(k.where("event_id % 2 = 0").transform(lambda x: U.dedup_latest(x, ["user_id", "event_type"], [F.desc("ts")])), k, ["user_id", "event_type"], "ts", except_cols=["event_id"])


@query(f"WITH {KEYED}, {_LAST} SELECT user_id, event_type, band, ts FROM last WHERE band <> 0")
def apply_changes_delete(spark, d):
    k = keyed(spark, d)
    start = k.where("event_id % 2 = 0").transform(lambda x: U.dedup_latest(x, ["user_id", "event_type"], [F.desc("ts")]))
    return U.apply_changes(start, k, ["user_id", "event_type"], "ts", delete_when=F.col("band") == 0, except_cols=["event_id"])


_HISTORY = f"""{KEYED}, moved AS (SELECT *, row_number() OVER w = 1 OR band IS DISTINCT FROM lag(band) OVER w AS is_new FROM keyed WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
  history AS (SELECT user_id, event_type, band, ts AS _start, lead(ts) OVER w AS _end, lead(ts) OVER w IS NULL AS _is_current FROM moved WHERE is_new WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"""
_VERSION = "user_id, event_type, band, _start, _end, _is_current"


def _history(spark: SparkSession, d: str, upto: str | None = None) -> DataFrame:
    k = keyed(spark, d)
    k = k.where(upto) if upto else k
    return U.scd2_from_history(k, ["user_id", "event_type"], ["ts", "event_id"], ["band"], "ts").drop("ts", "event_id")


@query(f"WITH {_HISTORY} SELECT {_VERSION} FROM history")
def scd2_from_history(spark, d):
    return _history(spark, d)


_CHANGED = f"""{_HISTORY.replace("FROM events)", "FROM events WHERE ts < TIMESTAMP '2024-01-15')", 1)},
  late AS (SELECT user_id, event_type, CAST(floor(value / 50) AS BIGINT) AS band, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15'),
  changes AS (SELECT user_id, event_type, band, _start, false AS gone FROM history WHERE _is_current UNION ALL SELECT user_id, event_type, band, ts, band = 0 FROM late),
  steps AS (SELECT *, coalesce(lag(gone) OVER w, true) <> gone OR (NOT gone AND band IS DISTINCT FROM lag(band) OVER w) AS is_new FROM changes WINDOW w AS (PARTITION BY user_id, event_type ORDER BY _start)),
  ends AS (SELECT *, lead(_start) OVER (PARTITION BY user_id, event_type ORDER BY _start) AS _end FROM steps WHERE is_new),
  changed AS (SELECT {_VERSION} FROM history WHERE NOT _is_current UNION ALL SELECT user_id, event_type, band, _start, _end, _end IS NULL FROM ends WHERE NOT gone)"""


@query(f"WITH {_CHANGED} SELECT {_VERSION} FROM changed")
def apply_changes_scd2(spark, d):
    feed = keyed(spark, d).where("ts >= TIMESTAMP_NTZ '2024-01-15'")
    old = _history(spark, d, "ts < TIMESTAMP_NTZ '2024-01-15'")
    return U.apply_changes_versions(old, feed, ["user_id", "event_type"], "ts", delete_when=F.col("band") == 0)


_MERGED = f"""{_HISTORY.replace("FROM events)", "FROM events WHERE ts < TIMESTAMP '2024-01-15')", 1)},
  late AS (SELECT user_id, event_type, CAST(floor(value / 50) AS BIGINT) AS band, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15'),
  upd AS (SELECT user_id, event_type, arg_max(band, ts) AS band, max(ts) AS ts FROM late GROUP BY user_id, event_type),
  joined AS (SELECT h.*, u.ts AS u_ts, u.band AS u_band, h._is_current AND u.ts IS NOT NULL AND u.band IS DISTINCT FROM h.band AS changed FROM history h LEFT JOIN upd u USING (user_id, event_type)),
  merged AS (
    SELECT user_id, event_type, band, _start, CASE WHEN changed THEN u_ts ELSE _end END AS _end, CASE WHEN changed THEN false ELSE _is_current END AS _is_current FROM joined
    UNION ALL SELECT u.user_id, u.event_type, u.band, u.ts, NULL, true FROM upd u LEFT JOIN (SELECT * FROM history WHERE _is_current) h USING (user_id, event_type) WHERE h.user_id IS NULL OR u.band IS DISTINCT FROM h.band)"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    old = U.scd2_from_history(keyed(spark, d).where("ts < TIMESTAMP_NTZ '2024-01-15'"), ["user_id", "event_type"], ["ts", "event_id"], ["band"], "ts").drop("event_id")
    new = keyed(spark, d).where("ts >= TIMESTAMP_NTZ '2024-01-15'").drop("event_id")
    return U.scd2_merge(old, new, ["user_id", "event_type"], ["band"], "ts").drop("ts")


@query(f"WITH {_MERGED} SELECT {_VERSION} FROM merged")
def scd2_merge(spark, d):
    return _merged(spark, d)


@query(f"WITH {_MERGED} SELECT {_VERSION} FROM merged WHERE _is_current")
def scd2_current(spark, d):
    return U.scd2_current(_merged(spark, d))


@query(f"WITH {_MERGED}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY _start DESC) AS k FROM merged WHERE _start <= TIMESTAMP '2024-01-12') SELECT {_VERSION} FROM r WHERE k = 1")
def scd2_as_of(spark, d):
    return U.scd2_as_of(_merged(spark, d), ["user_id", "event_type"], F.lit("2024-01-12").cast("timestamp_ntz"))


@query(f"WITH {_MERGED} SELECT _is_current, count(*) AS n FROM merged GROUP BY _is_current")
def scd2_profile(spark, d):
    return _merged(spark, d).groupBy("_is_current").agg(F.count("*").alias("n"))


@query(f"""WITH {KEYED}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS k FROM keyed),
    u AS (SELECT user_id, event_type, band FROM r WHERE k = 1), c AS (SELECT user_id, event_type, band FROM r WHERE k = 2)
    SELECT user_id, event_type, band, user_id AS merge_key FROM u UNION ALL SELECT u.user_id, u.event_type, u.band, NULL FROM u JOIN c USING (user_id, event_type) WHERE u.band IS DISTINCT FROM c.band""")
def scd2_staged_rows(spark, d):
    from pyspark.sql import Window

    r = keyed(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"))))
    pick = lambda n: r.where(F.col("k") == n).select("user_id", "event_type", "band")
    return U.scd2_stage(pick(1), pick(2), ["user_id", "event_type"], ["band"])


@query("""WITH t AS (SELECT user_id, event_type, arg_max(value, ts) AS value, max(ts) AS processed FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1, 2),
    fresh AS (SELECT user_id, event_type, arg_max(value, ts) AS value, max(ts) AS processed FROM events WHERE ts > (SELECT max(processed) FROM t) GROUP BY 1, 2)
    SELECT * FROM fresh UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.user_id = t.user_id AND f.event_type = t.event_type)""")
def incremental_upsert(spark, d):
    staging = events(spark, d).select("user_id", "event_type", "value", F.col("ts").alias("processed"))
    target = U.dedup_latest(staging.where("processed < TIMESTAMP_NTZ '2024-01-10'"), ["user_id", "event_type"], [F.desc("processed")])
    return U.incremental_upsert(target, staging, ["user_id", "event_type"], "processed")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE value END AS value FROM events WHERE NOT coalesce(user_id = 5, false)")
def update_where(spark, d):
    e = U.update_where(events(spark, d), F.col("event_type") == "error", {"value": F.lit(0.0)})
    return U.delete_where(e, F.col("user_id") == 5).select("event_id", "value")


@query("SELECT DISTINCT CAST(ts AS DATE) AS processed_date FROM events")
def process_ledger(spark, d):
    return events(spark, d).select(F.to_date("ts").alias("processed_date")).distinct().orderBy(F.desc("processed_date"))


_OLD_NEW = """old AS (SELECT doc_id, text, lang FROM documents), new AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END AS text, lang FROM documents WHERE doc_id % 17 <> 0
    UNION ALL SELECT doc_id + 1000000, text, lang FROM documents WHERE doc_id % 19 = 0)"""


def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, d, "documents").select("doc_id", "text", "lang")
    new = old.where("doc_id % 17 <> 0").withColumn("text", F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return old, new.unionByName(old.where("doc_id % 19 = 0").withColumn("doc_id", F.col("doc_id") + 1000000))


@query(f"""WITH {_OLD_NEW} SELECT 'insert' AS _change_type, n.* FROM new n WHERE doc_id NOT IN (SELECT doc_id FROM old)
    UNION ALL SELECT 'delete', o.* FROM old o WHERE doc_id NOT IN (SELECT doc_id FROM new)
    UNION ALL SELECT 'update_preimage', o.* FROM old o JOIN new n USING (doc_id) WHERE o.text IS DISTINCT FROM n.text
    UNION ALL SELECT 'update_postimage', n.* FROM old o JOIN new n USING (doc_id) WHERE o.text IS DISTINCT FROM n.text""")
def change_feed(spark, d):
    return U.change_feed(*_old_new(spark, d), ["doc_id"])


@query("""WITH a AS (SELECT md5(coalesce(event_type, '') || '|' || user_id) AS h, count(*) AS n FROM events GROUP BY 1) SELECT n AS rows_per_hash, count(*) AS n_hashes FROM a GROUP BY 1""")
def row_hash_counts(spark, d):
    hashes = events(spark, d).groupBy(C.row_hash(["event_type", "user_id"]).alias("h")).agg(F.count("*").alias("rows_per_hash"))
    return hashes.groupBy("rows_per_hash").agg(F.count("*").alias("n_hashes"))


def _compare_sql(columns: str) -> str:
    return f"""WITH {_OLD_NEW}, a AS (SELECT {columns}, count(*) AS na FROM old GROUP BY {columns}), b AS (SELECT {columns}, count(*) AS nb FROM new GROUP BY {columns}),
      j AS (SELECT na, nb FROM a FULL JOIN b USING ({columns})),
      s AS (SELECT CAST(sum(CASE WHEN na IS NOT NULL THEN na * coalesce(nb, 1) END) AS BIGINT) AS original_records, CAST(coalesce(sum(na * nb), 0) AS BIGINT) AS comparison_records,
        count(na) AS original_distinct, count(*) FILTER (na IS NOT NULL AND nb IS NOT NULL) AS comparison_distinct, CAST(coalesce(sum(CASE WHEN na IS NULL THEN nb END), 0) AS BIGINT) AS only_in_b FROM j)
      SELECT *, original_records - comparison_records AS difference, round(comparison_records / original_records, 6) AS match_share FROM s"""


@query(_compare_sql("doc_id, text, lang"))
def compare_tables(spark, d):
    return J.compare_tables(*_old_new(spark, d))


@query(_compare_sql("doc_id, text, lang"))
def compare_checksums(spark, d):
    """The numbers of compare_tables, with only the leaves of the checksum tree that differ read into the join."""
    return J.compare_by_checksums(*_old_new(spark, d), ["doc_id"])


@query(f"WITH {_OLD_NEW} SELECT o.* FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.doc_id = o.doc_id AND n.text = o.text AND n.lang = o.lang)")
def unmatched_by_checksums(spark, d):
    return J.unmatched_by_checksums(*_old_new(spark, d), ["doc_id"])


@query(_compare_sql("text, lang"))
def compare_tables_subset(spark, d):
    return J.compare_tables(*_old_new(spark, d), ["text", "lang"])


@query(f"WITH {_OLD_NEW} SELECT o.* FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.doc_id = o.doc_id AND n.text = o.text AND n.lang = o.lang)")
def rows_unmatched(spark, d):
    return J.rows_unmatched(*_old_new(spark, d))


@query(f"""WITH {_OLD_NEW} SELECT 'text' AS column_name, count(*) FILTER (o.text IS DISTINCT FROM n.text) AS n_different FROM old o JOIN new n USING (doc_id)
    UNION ALL SELECT 'lang', count(*) FILTER (o.lang IS DISTINCT FROM n.lang) FROM old o JOIN new n USING (doc_id)""")
def column_diff_profile(spark, d):
    return J.column_diff_profile(*_old_new(spark, d), ["doc_id"], ["text", "lang"])


def _change_log(spark: SparkSession, d: str) -> DataFrame:
    """One version a day: each event sets its key's value, and every ninth deletes it."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    return events(spark, d).select("user_id", "event_type", F.col("value"), day.alias("_version"), "event_id", (F.col("event_id") % 9 == 0).alias("_deleted")).transform(
        lambda x: U.dedup_latest(x, ["user_id", "event_type", "_version"], [F.desc("event_id")]).drop("event_id")
    )


_LOG = "day AS (SELECT user_id, event_type, arg_max(value, event_id) AS value, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS v, arg_max(event_id % 9 = 0, event_id) AS gone FROM events GROUP BY 1, 2, 4)"
_AT = "SELECT user_id, event_type, value FROM (SELECT user_id, event_type, arg_max(value, v) AS value, arg_max(gone, v) AS gone FROM day {where} GROUP BY 1, 2) WHERE NOT gone"


@query(f"WITH {_LOG} {_AT.format(where='WHERE v <= 12')}")
def as_of_version(spark, d):
    return U.as_of_version(_change_log(spark, d), ["user_id", "event_type"], 12)


@query(f"WITH {_LOG} {_AT.format(where='WHERE v <= 12')}")
def as_of_snapshot(spark, d):
    """Version 12 of a log from the snapshot of version 10 and the changes after it."""
    log = _change_log(spark, d)
    kept = VersionLog(spark, work_dir(spark, "log"), log.drop("_version", "_deleted").schema, ["user_id", "event_type"])
    for first, last in ((0, 10), (11, 30)):  # versions come in two loads, with a snapshot between them
        kept.append_all(log.where(F.col("_version").between(first, last)))
        if last == 10:
            kept.snapshot(last)
    return kept.as_of(12)


@query(f"""WITH {_LOG}, old AS ({_AT.format(where='')}), new AS ({_AT.format(where='WHERE v <= 12')})
    SELECT 'insert' AS _change_type, n.* FROM new n LEFT JOIN old o USING (user_id, event_type) WHERE o.user_id IS NULL
    UNION ALL SELECT 'delete', o.* FROM old o LEFT JOIN new n USING (user_id, event_type) WHERE n.user_id IS NULL
    UNION ALL SELECT 'update_postimage', n.* FROM new n JOIN old o USING (user_id, event_type) WHERE n.value IS DISTINCT FROM o.value""")
def revert_to_version(spark, d):
    return U.revert_to_version(_change_log(spark, d), ["user_id", "event_type"], 12)


# Aggregates and windows


@query("SELECT user_id, date_trunc('hour', ts) AS hour, round(avg(value) + 1e-7, 4) AS avg_value FROM events GROUP BY 1, 2")
def hourly_summary(spark, d):
    return rounded(A.hourly_summary(events(spark, d), ["user_id"], "ts", ["value"]), "avg_value")


_HASHED = "q AS (SELECT event_type || '-' || (user_id % 20) AS query_hash, ts, value FROM events)"


def _query_log(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.concat_ws("-", "event_type", (F.col("user_id") % 20).cast("string")).alias("query_hash"), "ts", "value")


@query(f"""WITH {_HASHED} SELECT query_hash, round(sum(value), 2) AS total, round(avg(value) + 1e-7, 4) AS average, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS n_days,
    round(count(*) / count(DISTINCT CAST(ts AS DATE)) + 1e-7, 4) AS per_day FROM q WHERE ts >= TIMESTAMP '2024-01-08' GROUP BY 1""")
def query_cost_report(spark, d):
    report = R.cost_report(_query_log(spark, d), ["query_hash"], "ts", "value", "2024-01-08 00:00:00")
    return rounded(report, "average", "per_day").withColumn("total", F.round("total", 2))


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(avg(value) + 1e-7, 4) AS avg_value FROM events GROUP BY 1")
def runs_per_hour(spark, d):
    return rounded(R.runs_per_hour(events(spark, d), "ts", "value"), "avg_value")


@query("SELECT min(ts) AS least, max(ts) AS greatest, count(*) AS n_rows FROM events")
def table_extent(spark, d):
    return A.table_extent(events(spark, d), "ts")


@query("SELECT conv_id, string_agg(rtrim(text), ' | ' ORDER BY turn) AS texts FROM conversations GROUP BY conv_id")
def ordered_string_agg(spark, d):
    return R.ordered_string_agg(table(spark, d, "conversations"), ["conv_id"], ["turn"], "text", " | ")


@query("SELECT DISTINCT user_id, event_type AS name FROM events")
def collect_explode(spark, d):
    listed = events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("names"))
    return listed.select("user_id", F.explode("names").alias("name"))


@query("SELECT event_type AS process, date_trunc('hour', ts) AS hour, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) + 1e-7, 4) AS avg_k FROM events GROUP BY 1, 2")
def json_metric_by_hour(spark, d):
    return rounded(R.json_metric_by_hour(events(spark, d).withColumnRenamed("event_type", "process"), ["process"], "ts", "props", "k"), "avg_k")


@query("SELECT date_trunc('month', l_shipdate) AS bucket, count(l_shipdate) AS n_rows FROM lineitem GROUP BY 1")
def row_count_by_grain(spark, d):
    return A.row_count_by_grain(table(spark, d, "lineitem"), "l_shipdate", "month")


_HOURLY = "h AS (SELECT user_id, date_trunc('hour', ts) AS hour, round(avg(value) + 1e-7, 4) AS avg_value FROM events GROUP BY 1, 2)"


@query(f"WITH {_HOURLY} SELECT user_id, hour, avg_value, round(avg(avg_value) OVER (PARTITION BY user_id ORDER BY hour ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) + 1e-7, 4) AS ma_avg_value FROM h")
def moving_average_by_user(spark, d):
    return rounded(A.moving_average(hourly_summary(spark, d), ["hour"], ["avg_value"], 4, ["user_id"]), "ma_avg_value")


@query("SELECT event_id, round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) + 1e-7, 4) AS ma_value FROM events")
def moving_average_global(spark, d):
    return A.moving_average_global(events(spark, d).select("event_id", "ts", "value"), ["ts", "event_id"], ["value"], 24, chunk=500).select("event_id", "ma_value").transform(rounded, "ma_value")


@query("""WITH r AS (SELECT event_id, ts, value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY)
    SELECT event_id, round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) + 1e-7, 4) AS ma_value FROM r""")
def gold_recent_smoothed(spark, d):
    recent = A.recent_window(events(spark, d).select("event_id", "ts", "value"), "ts", "'5' DAY")
    return rounded(A.moving_average_global(recent, ["ts", "event_id"], ["value"], 15).select("event_id", "ma_value"), "ma_value")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    by = _query_log(spark, d).groupBy(F.to_date("ts").alias("day"), "query_hash")
    return by.agg(F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value") + 1e-7, 4).alias("average"), F.count("*").alias("n"))


def _top_sql(metric: str) -> str:
    return f"""WITH {_HASHED}, g AS (SELECT CAST(ts AS DATE) AS day, query_hash, round(sum(value), 2) AS total, round(avg(value) + 1e-7, 4) AS average, count(*) AS n FROM q GROUP BY 1, 2),
      r AS (SELECT *, dense_rank() OVER (PARTITION BY day ORDER BY {metric} DESC) AS rnk FROM g) SELECT * FROM r WHERE rnk <= 10"""


@query(_top_sql("total"))
def topn_total_per_day(spark, d):
    return A.top_n_per(_daily(spark, d), ["day"], F.col("total"), 10)


@query(_top_sql("average"))
def topn_avg_per_day(spark, d):
    return A.top_n_per(_daily(spark, d), ["day"], F.col("average"), 10)


@query(_top_sql("n"))
def topn_runs_per_day(spark, d):
    return A.top_n_per(_daily(spark, d), ["day"], F.col("n"), 10)


@query(f"""WITH {STAR}, g AS (SELECT c_custkey, c_name, round(sum(l_extendedprice * l_quantity), 2) AS holdings FROM star WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2)
    SELECT *, row_number() OVER (ORDER BY holdings DESC, c_custkey) AS rnk FROM g ORDER BY holdings DESC, c_custkey LIMIT 10""")
def top10_customers(spark, d):
    year = star(spark, d).where("o_orderdate >= TIMESTAMP_NTZ '1997-01-01' AND o_orderdate < TIMESTAMP_NTZ '1998-01-01'")
    held = year.groupBy("c_custkey", "c_name").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")), 2).alias("holdings"))
    return A.top_n_global(held, [F.desc("holdings"), F.asc("c_custkey")], 10)


@query("""WITH g AS (SELECT user_id, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events WHERE event_type IN ('click', 'purchase'))
    SELECT user_id, date_trunc('day', ts) AS day, round(avg(gap), 3) AS avg_gap FROM g GROUP BY 1, 2""")
def update_gap_by_hour(spark, d):
    gaps = R.table_update_gaps(events(spark, d), ["user_id"], ["ts", "event_id"], "ts", "event_type", ["click", "purchase"], "day")
    return gaps.withColumn("avg_gap", F.round("avg_gap", 3))


@query("SELECT event_id, user_id, CAST(sum(event_id % 4) OVER (PARTITION BY user_id ORDER BY event_type) AS BIGINT) AS slots FROM events")
def running_slots(spark, d):
    e = events(spark, d).select("event_id", "user_id", "event_type", (F.col("event_id") % 4).alias("room"))
    return A.running_sum(e, ["user_id"], ["event_type"], "room", "slots").select("event_id", "user_id", "slots")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events")
def global_sequence(spark, d):
    return A.assign_sequence(events(spark, d).select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "seq")


@query("SELECT CAST(ceil(rn / 50) AS BIGINT) AS bin, list(c_name ORDER BY c_name) AS names FROM (SELECT c_name, row_number() OVER (ORDER BY c_name) AS rn FROM customer) GROUP BY 1")
def bin_rows(spark, d):
    return A.bin_rows(table(spark, d, "customer").select("c_name"), ["c_name"], "c_name", 50)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def sorted_limit(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100)


@query("SELECT event_type, arg_max(event_id, ts) AS event_id, max(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY event_type")
def latest_per_process(spark, d):
    return A.latest_per(events(spark, d).select("event_type", "event_id", "ts", "value"), ["event_type"], ["ts", "event_id"])


@query("""WITH s AS (SELECT o_custkey AS parent, o_orderkey AS slot, 2 AS room, sum(2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM orders WHERE o_orderstatus = 'F'),
    n AS (SELECT o_custkey AS parent, list(CAST(o_orderkey AS VARCHAR) ORDER BY CAST(o_orderkey AS VARCHAR) DESC) AS names FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT parent, slot, array_to_string(coalesce(list_slice(names, run - room + 1, run), []), ',') AS held FROM s LEFT JOIN n USING (parent)""")
def array_allocate(spark, d):
    o = table(spark, d, "orders")
    slots = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("slot"), F.array().cast("array<string>").alias("held"), F.lit(2).alias("room"))
    names = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").cast("string").alias("name"))
    return A.array_allocate(slots.withColumn("room", F.col("room").cast("int")), names, "parent", "held", "room", "slot", "name").select("parent", "slot", F.array_join("held", ",").alias("held"))


# Keys, run logs, layout


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq FROM orders")
def assign_sequence(spark, d):
    return A.assign_sequence(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "seq")


@query("SELECT s_name, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_name) AS id FROM supplier")
def identity_resume(spark, d):
    return A.resume_identity(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), table(spark, d, "supplier").select("s_name"), "id", ["s_name"])


@query("SELECT event_id, md5(length(CAST(user_id AS VARCHAR)) || ':' || user_id || length(event_type) || ':' || event_type) AS hash_key FROM events")
def hash_key(spark, d):
    return events(spark, d).select("event_id", C.hash_key(["user_id", "event_type"]).alias("hash_key"))


@query(f"WITH {RUNS} SELECT process, run_id, status, started, ended, round(epoch(ended) - epoch(started), 3) AS seconds FROM runs")
def run_state(spark, d):
    return A.run_state(runs_log(spark, d))


@query(f"""WITH {RUNS}, m AS (SELECT *, max(CASE WHEN status = 'RUNNING' THEN started END) OVER (PARTITION BY process) AS newest FROM runs)
    SELECT process, run_id, CASE WHEN started < newest AND (status NOT IN ('SUCCESS', 'FAIL', 'STALE') OR ended IS NULL) THEN 'STALE' ELSE status END AS status, started,
      CASE WHEN started < newest AND (status NOT IN ('SUCCESS', 'FAIL', 'STALE') OR ended IS NULL) THEN newest ELSE ended END AS ended FROM m""")
def mark_stale(spark, d):
    return A.mark_stale(A.run_state(runs_log(spark, d))).drop("seconds")


@query(f"""WITH {RUNS}, said AS (SELECT process, run_id, max(logged) AS last FROM log GROUP BY 1, 2), w AS (SELECT max(logged) - INTERVAL 1 HOUR AS mark FROM log),
    g AS (SELECT process, run_id, started, last + INTERVAL 6 HOUR AS given_up, status = 'RUNNING' AND given_up < mark AS gone, CASE WHEN gone THEN 'STALE' ELSE status END AS status,
      CASE WHEN gone THEN given_up ELSE ended END AS ended FROM runs JOIN said USING (process, run_id), w),
    m AS (SELECT *, max(CASE WHEN status = 'RUNNING' THEN started END) OVER (PARTITION BY process) AS newest FROM g)
    SELECT process, run_id, CASE WHEN started < newest AND status = 'RUNNING' THEN 'STALE' ELSE status END AS status, started, CASE WHEN started < newest AND status = 'RUNNING' THEN newest ELSE ended END AS ended FROM m""")
def stream_run_log(spark, d):
    """The run log followed as a stream that stops and starts again every ten days; runs silent for six hours are given up."""
    log, src, checkpoint, wait = runs_log(spark, d), work_dir(spark, "run-log"), work_dir(spark, "state"), timedelta(hours=6)
    out = StoredTable(spark, work_dir(spark, "runs"), L.run_table_schema(log.schema), L.KEYS, buckets=16)
    for part in ("at < TIMESTAMP_NTZ '2024-01-11'", "at >= TIMESTAMP_NTZ '2024-01-11' AND at < TIMESTAMP_NTZ '2024-01-21'", "at >= TIMESTAMP_NTZ '2024-01-21'"):
        log.where(part).write.mode("append").parquet(src)
        L.follow_runs(S.stream_files(spark, src, log.schema, "parquet"), out, wait, "1 hour", checkpoint)
    return L.followed_runs(out, wait)


@query(f"""WITH {RUNS}, p AS (SELECT DISTINCT process FROM runs UNION ALL SELECT 'never') SELECT process, coalesce(max(started) FILTER (status = 'SUCCESS'), TIMESTAMP '1900-01-01') AS watermark
    FROM p LEFT JOIN runs USING (process) GROUP BY process""")
def last_success_watermark(spark, d):
    runs = A.run_state(runs_log(spark, d))
    never = table(spark, d, "region").select(F.lit("never").alias("process")).distinct()
    return A.last_success_watermark(runs, runs.select("process").distinct().unionByName(never))


@query("SELECT event_type AS process, 'k' AS metric, arg_max(CAST(json_extract_string(props, '$.k') AS DOUBLE), (ts, event_id)) AS value FROM events GROUP BY 1")
def run_metrics_latest(spark, d):
    return A.latest_metrics(events(spark, d).select(F.col("event_type").alias("process"), F.col("event_id").alias("run_id"), F.col("ts").alias("at"), F.col("props").alias("metrics")))


@query("SELECT count(*) AS n_rows, 1 AS n_files FROM events")
def compact_rowcount(spark, d):
    path = work_dir(spark, "compacted")
    A.compact(events(spark, d), path, A.stored_bytes(spark, f"{d}/events.parquet"))
    back = spark.read.parquet(path)
    return back.agg(F.count("*").alias("n_rows"), F.countDistinct("_metadata.file_path").cast("int").alias("n_files"))


@query("SELECT doc_id, text FROM documents")
def compact_small_files(spark, d):
    """A table of large files and many small ones, after the small ones were packed together: the same rows."""
    path = work_dir(spark, "mixed")
    docs = table(spark, d, "documents").select("doc_id", "text")
    docs.where("doc_id % 3 > 0").write.parquet(path)
    target = files.list_files(spark, path).where("path LIKE '%.parquet'").agg(F.max("length")).first()[0]
    docs.where("doc_id % 3 = 0").repartition(48, "doc_id").write.mode("append").parquet(path)
    A.compact_small(spark, path, target)
    return spark.read.parquet(path)


@query()
def zorder_pruning(spark, d):
    """Files of a clustered table, with the range of both columns in each: narrow ranges are what pruning needs."""
    path = work_dir(spark, "clustered")
    A.zorder_write(table(spark, d, "lineitem"), path, ["l_partkey", "l_suppkey"], files=16)
    by_file = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file"))
    return by_file.agg(F.count("*").alias("n"), *(f(c).alias(f"{name}_{c}") for c in ("l_partkey", "l_suppkey") for name, f in (("least", F.min), ("greatest", F.max))))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey BETWEEN 20 AND 60 AND l_suppkey <= 50")
def skipping_read(spark, d):
    """A clustered table read through its index of file ranges: the first half is indexed, the second comes later and is indexed alone."""
    path, li = work_dir(spark, "clustered"), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    index = RangeIndex(spark, path, li.schema, work_dir(spark, "ranges"), ["l_partkey", "l_suppkey"])
    for half in (0, 1):
        A.zorder_write(li.where(F.col("l_orderkey") % 2 == half), f"{path}/half={half}", ["l_partkey", "l_suppkey"], files=16)
        index.update()
    return index.read({"l_partkey": (20, 60), "l_suppkey": (None, 50)})


_PROFILE = "SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest FROM dirty"


@query(f"WITH {DIRTY} " + " UNION ALL ".join(_PROFILE.format(c=c) for c in ("event_id", "user_id", "event_type")))
def column_profile(spark, d):
    return A.column_profile(dirty_events(spark, d).select("event_id", "user_id", "event_type"), exact=True)


@query("""SELECT c AS column_name, count(*) AS n_rows, count(*) - count(v) AS n_nulls, min(v) AS least, max(v) AS greatest, true AS distinct_near, true AS median_near
    FROM (SELECT unnest(['event_id', 'user_id', 'value']) AS c, unnest([CAST(event_id AS DOUBLE), user_id, value]) AS v FROM events) GROUP BY 1""")
def profile_by_parts(spark, d):
    """A profile kept beside a growing table: a stream makes a state of each part's new files, and the states are merged."""
    src, states, checkpoint = work_dir(spark, "growing"), work_dir(spark, "states"), work_dir(spark, "state")
    e = events(spark, d).select("event_id", "user_id", "value")
    for part in range(3):
        e.where(F.col("event_id") % 3 == part).write.mode("append").parquet(src)
        S.run_available(S.stream_table(spark, src, e.schema), checkpoint, batch=lambda df, n: A.profile_state(df).write.mode("overwrite").parquet(f"{states}/batch={n}"))
    found = A.read_profile(A.merge_profiles(spark.read.schema(A.PROFILE).parquet(states)), [0.5])
    exact = A.column_profile(e, exact=True).select("column_name", F.col("n_distinct").alias("exact"))
    below = e.select(F.explode(F.create_map(*(x for c in e.columns for x in (F.lit(c), F.col(c).cast("double"))))).alias("column_name", "v"))
    ranks = below.join(F.broadcast(found), "column_name").groupBy("column_name").agg(F.avg((F.col("v") <= F.col("quantiles")[0]).cast("double")).alias("rank"))
    near = [(F.abs(F.col("n_distinct") / F.col("exact") - 1) < 0.05).alias("distinct_near"), (F.abs(F.col("rank") - 0.5) < 0.05).alias("median_near")]
    return found.join(exact, "column_name").join(ranks, "column_name").select("column_name", "n_rows", "n_nulls", F.col("least_number").alias("least"), F.col("greatest_number").alias("greatest"), *near)


@query("""WITH u AS (SELECT c_mktsegment AS tbl, c_nationkey AS col, count(*) AS usage, round(avg(c_acctbal) + 1e-7, 2) AS runtime FROM customer GROUP BY 1, 2),
    b AS (SELECT *, min(usage) OVER w AS u0, max(usage) OVER w AS u1, min(runtime) OVER w AS r0, max(runtime) OVER w AS r1 FROM u WINDOW w AS (PARTITION BY tbl)),
    s AS (SELECT tbl, col, usage, runtime, round((CASE WHEN u1 > u0 THEN (usage - u0) / (u1 - u0) ELSE 0.0 END) + (CASE WHEN r1 > r0 THEN (runtime - r0) / (r1 - r0) ELSE 0.0 END), 6) AS score FROM b)
    SELECT *, dense_rank() OVER (PARTITION BY tbl ORDER BY score DESC, col) AS rnk FROM s""")
def rank_layout_columns(spark, d):
    usage = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("tbl"), F.col("c_nationkey").alias("col")).agg(F.count("*").alias("usage"), F.round(F.avg("c_acctbal") + 1e-7, 2).alias("runtime"))
    return A.rank_layout_columns(usage, "tbl", "col", ["usage", "runtime"])


@query("SELECT ts, user_id, event_id, event_type, value FROM events")
def reorder_columns(spark, d):
    return C.reorder_columns(events(spark, d).drop("props"), ["ts", "user_id"])


@query()
def compare_schemas(spark, d):
    return J.compare_schemas(events(spark, d), table(spark, d, "documents").withColumn("value", F.lit("x")))


# Scalars


@query("""SELECT event_id, date_trunc('day', ts) AS day, CAST(ts AS DATE) AS on_date, ts - INTERVAL 7 DAY AS week_before, CAST(floor(epoch(ts)) AS BIGINT) AS unix_seconds FROM events""")
def scalar_dates(spark, d):
    return events(spark, d).select("event_id", C.ntz(F.date_trunc("day", "ts")).alias("day"), F.to_date("ts").alias("on_date"), F.expr("ts - INTERVAL '7' DAY").alias("week_before"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("unix_seconds"))


@query("""SELECT event_id, event_type || ':' || user_id AS joined, substr(event_type, 1, 3) AS head, length(props) AS n, split_part(event_type, 'i', 1) AS before_i, starts_with(event_type, 'cl') AS is_cl,
    regexp_replace(props, '[^0-9]+', '_', 'g') AS digits FROM events""")
def scalar_strings(spark, d):
    return events(spark, d).select("event_id", F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("joined"), F.substring("event_type", 1, 3).alias("head"), F.length("props").cast("long").alias("n"), F.split_part("event_type", F.lit("i"), F.lit(1)).alias("before_i"), F.col("event_type").startswith("cl").alias("is_cl"), F.regexp_replace("props", "[^0-9]+", "_").alias("digits"))


@query("""WITH g AS (SELECT user_id, list(DISTINCT event_type) AS l FROM events GROUP BY 1), s AS (SELECT user_id, list_sort(l) AS l FROM g)
    SELECT user_id, len(l) AS n, array_to_string(list_slice(l, 1, 2), ',') AS first_two, array_to_string(list_sort(list_distinct(list_concat(l, ['extra']))), ',') AS with_extra FROM s""")
def scalar_arrays(spark, d):
    g = events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("l"))
    return g.select("user_id", F.array_size("l").cast("long").alias("n"), F.array_join(F.slice("l", 1, 2), ",").alias("first_two"), F.array_join(F.array_sort(F.array_union("l", F.array(F.lit("extra")))), ",").alias("with_extra"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k_text, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def scalar_json(spark, d):
    return events(spark, d).select("event_id", F.get_json_object("props", "$.k").alias("k_text"), F.try_variant_get(F.parse_json("props"), "$.k", "long").alias("k"))


@query("SELECT event_id, CAST(ceil(value / 7) AS BIGINT) AS up, round(value / (user_id + 1) + 1e-7, 4) AS ratio, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS band, coalesce(nullif(user_id, 3), -1) AS user_or FROM events")
def scalar_math(spark, d):
    return events(spark, d).select("event_id", F.ceil(F.col("value") / 7).cast("long").alias("up"), F.round(F.col("value") / (F.col("user_id") + 1) + 1e-7, 4).alias("ratio"), F.when(F.col("value") > 50, "high").otherwise("low").alias("band"), F.coalesce(F.nullif(F.col("user_id"), F.lit(3)), F.lit(-1)).cast("long").alias("user_or"))


# Streams


@query("""WITH m AS (SELECT max(ts) AS top FROM events) SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, round(avg(value) + 1e-7, 4) AS avg_value, count(*) AS n
    FROM events, m GROUP BY 1, 2, top HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= top - INTERVAL 30 SECOND""")
def stream_tumbling_avg(spark, d):
    dst = work_dir(spark, "tumbling")
    stream = S.stream_files(spark, _stream_source(spark, d), EVENT_SCHEMA, "parquet")
    found = S.tumbling_average(stream, "ts", ["value"], "1 hour", "30 seconds")
    S.run_available(found, work_dir(spark, "state"), dst)
    return rounded(spark.read.schema(found.schema).parquet(dst), "avg_value")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_dedup(spark, d):
    src, dst = work_dir(spark, "twice"), work_dir(spark, "once")
    e = events(spark, d)
    e.unionByName(e.where("event_id % 3 = 0")).write.parquet(src)
    once = S.stream_dedup(S.stream_files(spark, src, EVENT_SCHEMA, "parquet"), ["event_id"], "ts", "1 hour").select("event_id", "event_type")
    S.run_available(once, work_dir(spark, "state"), dst)
    return spark.read.schema(once.schema).parquet(dst).groupBy("event_type").agg(F.count("*").alias("n"))


_DAILY_TOP = "date_trunc('day', ts)"


@query(f"""WITH b AS (SELECT *, ts < (SELECT min(ts) FROM events) + INTERVAL 15 DAY AS early FROM events), w AS (SELECT max(ts) FILTER (early) AS top FROM b),
    on_time AS (SELECT * FROM b, w WHERE NOT (NOT early AND event_id % 10 = 0))
    SELECT {_DAILY_TOP} AS window_start, {_DAILY_TOP} + INTERVAL 1 DAY AS window_end, count(*) AS n FROM on_time, (SELECT max(ts) AS last FROM b WHERE early OR event_id % 10 <> 0) GROUP BY 1, 2, last
    HAVING {_DAILY_TOP} + INTERVAL 1 DAY <= last - INTERVAL 1 MINUTE""")
def stream_late_drop(spark, d):
    """Two ordered parts; rows of the second that were moved back to the first day are late, and dropped."""
    e = events(spark, d)
    first = e.agg(F.min("ts")).first()[0]
    cut = F.lit(first).cast("timestamp_ntz") + F.expr("INTERVAL '15' DAY")
    src, dst = work_dir(spark, "late"), work_dir(spark, "windows")
    late = F.when(F.col("event_id") % 10 == 0, F.lit(first).cast("timestamp_ntz")).otherwise(F.col("ts"))
    state = work_dir(spark, "state")
    for part in (e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut).withColumn("ts", late)):
        part.write.mode("append").parquet(src)
        stream = S.tumbling_average(S.stream_files(spark, src, EVENT_SCHEMA, "parquet"), "ts", ["value"], "1 day", "1 minute")
        S.run_available(stream, state, dst)
    return spark.read.schema(stream.schema).parquet(dst).drop("avg_value")


KEY = ["user_id", "event_type"]


def _by_ranges(spark: SparkSession, d: str, parts: list[str], run: Callable[[DataFrame], None]) -> None:
    """Writes the keyed history part by part, each as the files that Spark makes of it, and runs a stream over the folder after each: a batch a part."""
    path = work_dir(spark, "keyed")
    for part in parts:
        keyed(spark, d).where(part).write.mode("append").parquet(path)
        run(S.stream_files(spark, path, keyed(spark, d).schema, "parquet"))


IN_ORDER = [f"day(ts) > {10 * k} AND day(ts) <= {10 * k + 10 + k // 2}" for k in range(3)]
OUT_OF_ORDER = ["event_id % 3 = 1", "event_id % 3 = 2", "event_id % 3 = 0"]
_VERSION_FIELDS = [T.StructField("_start", T.TimestampNTZType()), T.StructField("_end", T.TimestampNTZType()), T.StructField("_is_current", T.BooleanType()), T.StructField("_kind", T.StringType())]


def _stored(spark: SparkSession, schema: T.StructType, keys: list[str] = KEY, more: list[str] | None = None) -> StoredTable:
    return StoredTable(spark, work_dir(spark, "stored"), schema, keys, buckets=16, row_keys=[*keys, *(more or [])])


@query(f"WITH {KEYED} SELECT user_id, event_type, arg_max(band, ts) AS band, max(ts) AS ts, arg_max(event_id, ts) AS event_id FROM keyed GROUP BY 1, 2")
def stream_upsert_final(spark, d):
    out, state = _stored(spark, keyed(spark, d).schema), work_dir(spark, "state")
    _by_ranges(spark, d, IN_ORDER, lambda stream: S.stream_upsert(stream, out, KEY, [F.desc("ts")], state))
    return out.latest()


@query(f"WITH {KEYED} SELECT user_id, event_type, arg_max(band, ts) AS band, max(ts) AS ts, arg_max(event_id, ts) AS event_id FROM keyed GROUP BY 1, 2")
def stream_upsert_if_newer(spark, d):
    """Parts of the history come out of order; the condition keeps older rows from overwriting newer ones."""
    out, state = _stored(spark, keyed(spark, d).schema), work_dir(spark, "state")
    _by_ranges(spark, d, OUT_OF_ORDER, lambda stream: S.stream_upsert(stream, out, KEY, [F.desc("ts")], state, condition="s.ts > t.ts"))
    return out.latest()


@query(f"WITH {KEYED}, {_LAST} SELECT user_id, event_type, band, ts FROM last WHERE band <> 0")
def scd1_out_of_order(spark, d):
    """A feed with deletes whose parts come out of order: rows keep their sequence value, deleted ones as tombstones."""
    schema = T.StructType([*keyed(spark, d).drop("event_id").schema.fields, T.StructField("_deleted", T.BooleanType())])
    out, state = _stored(spark, schema), work_dir(spark, "state")
    _by_ranges(spark, d, OUT_OF_ORDER, lambda stream: S.stream_changes(stream, out, KEY, "ts", state, F.col("band") == 0))
    return out.latest().where("NOT _deleted").drop("_deleted")


_BATCHES = """keyed AS (SELECT user_id, event_type, CAST(floor(value / 50) AS BIGINT) AS band, ts, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END ORDER BY ts DESC) = 1)"""


def _versioned(spark: SparkSession, d: str, parts: list[str], **options) -> DataFrame:
    out, state = _stored(spark, T.StructType([*keyed(spark, d).schema.fields, *_VERSION_FIELDS]), more=["_start"]), work_dir(spark, "state")
    _by_ranges(spark, d, parts, lambda stream: S.stream_scd2(stream, out, KEY, ["band"], "ts", state, **options))
    return U.scd2_versions(out.latest()).drop("ts", "event_id")


@query(f"WITH {_HISTORY.replace(KEYED, _BATCHES)} SELECT {_VERSION} FROM history")
def stream_scd2_final(spark, d):
    return _versioned(spark, d, IN_ORDER)


@query(f"""WITH {KEYED}, steps AS (SELECT *, coalesce(lag(band = 0) OVER w, true) <> (band = 0) OR (band <> 0 AND band IS DISTINCT FROM lag(band) OVER w) AS is_new FROM keyed WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
    ends AS (SELECT *, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS _end FROM steps WHERE is_new)
    SELECT user_id, event_type, band, ts AS _start, _end, _end IS NULL AS _is_current FROM ends WHERE band <> 0""")
def scd2_out_of_order(spark, d):
    """The whole history with deletes, its parts out of order, gives what one pass over it gives."""
    return _versioned(spark, d, OUT_OF_ORDER, latest_only=False, delete_when=F.col("band") == 0)


_DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]
_FIRST_DOCS = f"first AS (SELECT {', '.join(_DOCUMENT)} FROM documents WHERE doc_id % 10 <> 4)"
_CHANGED_DOCS = "changed AS (SELECT doc_id, text, lang, source, n_chars + CASE WHEN doc_id % 7 = 0 THEN 10 ELSE 0 END AS n_chars FROM documents WHERE doc_id % 10 <> 3)"


def _stored_documents(spark: SparkSession, d: str) -> StoredTable:
    """Version 0: nine tenths of documents. Version 1: a tenth deleted, a tenth inserted, and every seventh one's n_chars changed."""
    docs = table(spark, d, "documents").select(*_DOCUMENT)
    out = _stored(spark, docs.schema, ["doc_id"])
    out.merge(docs.where("doc_id % 10 <> 4"), 0, lambda old, batch: U.upsert(old, U.unique_keys(batch, ["doc_id"], stable=True), ["doc_id"], checked=True), only_keys=True, stable=True)
    size = F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 10).otherwise(F.col("n_chars"))
    feed = docs.where("doc_id % 10 IN (3, 4) OR doc_id % 7 = 0").withColumns({"n_chars": size, "at": F.lit(1)})
    out.merge(feed, 1, lambda old, batch: U.apply_changes(old, batch, ["doc_id"], "at", delete_when=F.col("doc_id") % 10 == 3, source_rows=few_rows(batch), stable=True), only_keys=True, stable=True)
    return out


@query(f"""WITH {_FIRST_DOCS}, {_CHANGED_DOCS}
    SELECT 'insert' AS _change_type, n.*, CAST(1 AS BIGINT) AS _commit_version FROM changed n WHERE doc_id NOT IN (SELECT doc_id FROM first)
    UNION ALL SELECT 'delete', o.*, 1 FROM first o WHERE doc_id NOT IN (SELECT doc_id FROM changed)
    UNION ALL SELECT 'update_preimage', o.*, 1 FROM first o JOIN changed n USING (doc_id) WHERE o.n_chars <> n.n_chars
    UNION ALL SELECT 'update_postimage', n.*, 1 FROM first o JOIN changed n USING (doc_id) WHERE o.n_chars <> n.n_chars""")
def stored_change_feed(spark, d):
    """What version 1 changed, from the files that its merge wrote."""
    return _stored_documents(spark, d).changes([1])


@query(f"WITH {_CHANGED_DOCS} SELECT * FROM changed")
def change_feed_follower(spark, d):
    """A copy of a stored table, kept by a stream over its change feed."""
    source, state = _stored_documents(spark, d), work_dir(spark, "state")
    copy = _stored(spark, source.schema, ["doc_id"])
    S.follow_changes(source, state, lambda changes, n: copy.merge(changes, n, lambda old, feed: apply_feed(old, feed, ["doc_id"], few_rows(feed), stable=True), only_keys=True, stable=True))
    return copy.latest()


@query(f"""WITH {_CHANGED_DOCS} SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(n_chars) + 1e-7, 4) AS avg_chars, min(n_chars) AS least, max(n_chars) AS greatest
    FROM changed GROUP BY 1, 2""")
def view_refresh_incremental(spark, d):
    """A view of version 0 moved to version 1 by the change feed: only groups that lost an extreme are read again."""
    source = _stored_documents(spark, d)
    view = GroupedView(["lang", "source"], sums=["n_chars"], extremes=["n_chars"])
    before, kept = view.compute(source.read(0)), work_dir(spark, "view")
    before.write.parquet(kept)
    after = view.averages(view.refresh(spark.read.schema(before.schema).parquet(kept), source.changes([1]), source.read(1)))
    total = F.col("sum_n_chars").cast("long").alias("total")
    return after.select("lang", "source", "n", total, F.round(F.col("avg_n_chars") + 1e-7, 4).alias("avg_chars"), F.col("least_n_chars").alias("least"), F.col("greatest_n_chars").alias("greatest"))


@query("SELECT 4 AS n_batches, count(*) AS n_rows FROM events")
def stream_rate_limited(spark, d):
    seen: list[int] = []
    stream = S.stream_files(spark, _stream_source(spark, d, 4), EVENT_SCHEMA, "parquet", max_files=1)
    dst = work_dir(spark, "limited")

    def batch(df: DataFrame, n: int) -> None:
        df.select("event_id").write.mode("overwrite").parquet(f"{dst}/batch={n}")
        seen.append(n)

    S.run_available(stream, work_dir(spark, "state"), batch=batch)
    return spark.read.parquet(dst).agg(F.countDistinct("batch").cast("int").alias("n_batches"), F.count("*").alias("n_rows"))


@query("SELECT event_id, TIMESTAMP '2024-02-01 10:00:00' AS processed_watermark, DATE '2024-02-01' AS processed_date FROM events")
def stream_staging(spark, d):
    dst = work_dir(spark, "staging")
    stream = S.stream_files(spark, _stream_source(spark, d), EVENT_SCHEMA, "parquet").select("event_id")
    S.stream_staging(stream, dst, work_dir(spark, "state"), F.lit("2024-02-01 10:00:00").cast("timestamp_ntz"))
    return spark.read.parquet(dst).select("event_id", "processed_watermark", "processed_date")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def mv_refresh(spark, d):
    """The view is made again once its source, a stream's table, has been brought up to date."""
    dst, view = work_dir(spark, "source"), work_dir(spark, "view")
    S.run_available(S.stream_files(spark, _stream_source(spark, d), EVENT_SCHEMA, "parquet"), work_dir(spark, "state"), dst)
    source = spark.read.schema(EVENT_SCHEMA).parquet(dst)
    source.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).write.mode("overwrite").parquet(view)
    return spark.read.parquet(view)
