"""Reports as functions over tables of the test's own."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tableops.operators import reports as R


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_previous_values_of_a_hot_part(spark):
    part = F.when(F.col("id") % 5 > 0, 1).when(F.col("id") % 2 == 0, F.col("id") % 300)
    df = spark.range(3000).select("id", part.alias("p"), F.when(F.col("id") % 11 > 0, F.col("id") * 31 % 50).alias("o"), F.when(F.col("id") % 4 > 0, F.col("id") % 9).alias("v")).repartition(4)
    plain = df.withColumn("before", F.lag("v").over(Window.partitionBy("p").orderBy("o", "id")))
    assert rows(R.previous_value(df, ["p"], ["o", "id"], "v", "before", 7)) == rows(plain)
    whole = df.withColumn("before", F.lag("v").over(Window.orderBy("o", "id")))
    assert rows(R.previous_value(df, [], ["o", "id"], "v", "before", 7)) == rows(whole)
    assert R.previous_value(df.limit(0), ["p"], ["o"], "v", "before").count() == 0


def test_gaps_between_versions(spark):
    history = spark.sql("""SELECT * FROM VALUES ('t', 1, TIMESTAMP_NTZ '2024-01-01 10:00:00', 'WRITE'), ('t', 2, TIMESTAMP_NTZ '2024-01-01 10:00:10', 'OPTIMIZE'),
        ('t', 3, TIMESTAMP_NTZ '2024-01-01 10:00:30', 'MERGE'), ('t', 4, TIMESTAMP_NTZ '2024-01-01 11:00:00', 'MERGE'), ('t', 5, NULL, 'MERGE'), (NULL, 1, TIMESTAMP_NTZ '2024-01-01 10:00:00', 'WRITE') AS h(name, version, at, op)""")
    got = R.table_update_gaps(history, ["name"], ["version"], "at", "op", ["WRITE", "MERGE"]).select("name", F.hour("hour").alias("h"), "avg_gap")
    assert rows(got) == sorted([("t", 10, 30.0), ("t", 11, 3570.0), ("t", None, None), (None, 10, None)], key=repr)
    assert R.table_update_gaps(history.where("false"), ["name"], ["version"], "at", "op", ["WRITE"]).count() == 0


def test_costs_count_days_once(spark):
    runs = spark.sql("""SELECT * FROM VALUES ('a', TIMESTAMP_NTZ '2024-01-02 01:00:00', 1.0D), ('a', TIMESTAMP_NTZ '2024-01-02 02:00:00', NULL), ('a', TIMESTAMP_NTZ '2024-01-03 00:00:00', 4.0D),
        ('a', TIMESTAMP_NTZ '2024-01-01 23:59:59', 99.0D), (NULL, TIMESTAMP_NTZ '2024-01-02 00:00:00', NULL), ('b', NULL, 5.0D) AS r(q, at, cost)""")
    assert rows(R.cost_report(runs, ["q"], "at", "cost", "2024-01-02 00:00:00")) == sorted([("a", 5.0, 2.5, 3, 2, 1.5), (None, None, None, 1, 1, 1.0)], key=repr)
    assert R.runs_per_hour(runs.where("false"), "at", "cost").count() == 0
    assert rows(R.runs_per_hour(runs.where("q = 'a'"), "at", "cost", ["q"]).select("q", "n", "avg_cost")) == [("a", 1, 1.0), ("a", 1, 4.0), ("a", 1, 99.0), ("a", 1, None)]


def test_strings_in_order(spark):
    turns = spark.createDataFrame([(1, 2, "b  "), (1, 1, "a"), (1, 3, None), (1, 2, "a"), (2, 1, None), (None, 1, ""), (None, None, "x")], "k int, turn int, text string")
    assert rows(R.ordered_string_agg(turns, ["k"], ["turn"], "text", "|")) == sorted([(1, "a|a|b"), (2, None), (None, "x|")], key=repr)


def test_json_metrics_that_are_none(spark):
    log = spark.sql("""SELECT 'p' AS p, TIMESTAMP_NTZ '2024-01-01 05:06:07' AS at, m FROM VALUES ('{"k": 2}'), ('{"k": "4"}'), ('{"k": "x"}'), ('no json'), (NULL), ('{"j": 1}') AS t(m)""")
    assert rows(R.json_metric_by_hour(log, ["p"], "at", "m", "k").select("p", "avg_k")) == [("p", 3.0)]


def test_days_of_a_key_range(spark):
    fact = spark.sql("""SELECT date_key, try_cast(at AS TIMESTAMP_NTZ) AS at, v FROM VALUES (20240228, '2024-02-28 23:59:59', 1), (20240229, '2024-02-29 00:00:00', 2), (20240229, '2024-02-29 23:59:59.999', 3),
        (20240301, '2024-03-01', 4), (NULL, '2024-02-29', 5) AS f(date_key, at, v)""")
    aggs = {"total": F.sum("v")}
    for source in (None, "at"):
        got = R.date_key_report(fact, "date_key", 20240229, 20240301, aggs, source)
        assert rows(got.select(F.col("day").cast("string"), "total")) == [("2024-02-29", 5), ("2024-03-01", 4)]
    view = R.bucketed_view(fact, "v > 1", "at", "day", aggs)
    assert rows(view.select(F.to_date("bucket").cast("string"), "total")) == [("2024-02-29", 10), ("2024-03-01", 4)]
