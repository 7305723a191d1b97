"""Files skipped by the index of their ranges, against brute force over the files."""

from pyspark.sql import functions as F

from tableops.operators import analytics as A
from tableops.sources.skipping import RangeIndex
from tableops.workdir import glob_paths, work_dir


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def touched(spark, path, schema, where):
    """Brute force: the files that have rows of the condition."""
    return {r["f"].rsplit("/", 1)[1] for r in spark.read.schema(schema).parquet(path).where(where).select(F.col("_metadata.file_path").alias("f")).distinct().collect()}


def test_clustered_files_are_skipped_on_either_column(spark, data):
    path = work_dir(spark, "clustered")
    items = spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    A.zorder_write(items, path, ["l_partkey", "l_suppkey"], files=16)
    index = RangeIndex(spark, path, items.schema, work_dir(spark, "index"), ["l_partkey", "l_suppkey"])
    assert index.update() == len(glob_paths(spark, f"{path}/*.parquet")) > 8 and index.update() == 0
    for c in ("l_partkey", "l_suppkey"):
        low = items.agg(F.percentile_approx(c, 0.4)).first()[0]
        want = items.where(F.col(c) == low)
        chosen = {r["path"].rsplit("/", 1)[1] for r in index.files_for({c: (low, low)}).collect()}
        assert touched(spark, path, items.schema, F.col(c) == low) <= chosen
        assert len(chosen) <= 8  # of 16, for each column alone
        assert rows(index.read({c: (low, low)})) == rows(want) and want.count() > 0
    assert index.files_for({"l_partkey": (-5, -1)}).count() == 0 and index.read({"l_partkey": (None, -1)}).count() == 0


def test_new_gone_and_odd_files(spark):
    path, schema = work_dir(spark, "odd"), "k double, s string, p string"
    fields = spark.createDataFrame([], schema).schema
    index = RangeIndex(spark, path, fields, work_dir(spark, "index"), ["k", "s"])
    assert index.update() == 0 and index.read({"k": (0.0, None)}).count() == 0  # no folder yet
    put = lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").partitionBy("p").parquet(path)
    put([(1.0, "a", "x y+z%"), (float("nan"), None, "x y+z%"), (None, "b", "plain")])
    assert index.update() == 2
    put([(5.0, "c", "plain"), (7.0, None, "late")])
    everything = [(1.0, "a", "x y+z%"), (None, "b", "plain"), (5.0, "c", "plain"), (7.0, None, "late")]
    for _ in range(2):  # two files unindexed, then indexed
        assert rows(index.read({"k": (1.0, 5.0)})) == sorted([everything[0], everything[2]], key=repr)
        assert rows(index.read({"k": (6.0, None)})) == [everything[3]]
        assert rows(index.read({"s": ("b", None), "k": (None, None)})) == sorted(everything[1:3], key=repr)
        assert index.read({}).count() == 5
        index.update()
    assert index.known().count() == 4
    assert {r["path"].split("p=")[1].split("/")[0] for r in index.files_for({"k": (6.0, 9.0)}).collect()} == {"late"}
    spark.createDataFrame([(8.0, "z", "late")], schema).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("p").parquet(path)
    assert rows(index.read({"k": (6.0, None)})) == [(8.0, "z", "late")]  # the indexed file is gone
