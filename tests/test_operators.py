"""Semantics that the SQL comparison doesn't pin down: ties, nulls, replays, plans."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableops.functions import columns as C
from tableops.operators import analytics as A
from tableops.operators import compare as J
from tableops.operators import upsert as U
from tableops.sources import sinks
from tableops.streaming import streams as S
from tableops.workdir import glob_paths, work_dir


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_dedup_latest_breaks_ties_by_the_remaining_columns(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, 1, None)], "k int, t int, v string")
    assert rows(U.dedup_latest(df, ["k"], [F.desc("t")])) == [(1, 5, "b"), (2, 1, None)]


def test_bare_decimal_drops_the_fraction(spark):
    df = spark.createDataFrame([("1.567",)], "x string")
    assert C.cast_projection(df, {"x": "decimal"}).first()["x"] == 2


def test_condition_in_the_match_inserts_what_it_refuses(spark):
    t = spark.createDataFrame([(1, 10, "old")], "k int, ts int, v string")
    s = spark.createDataFrame([(1, 5, "stale")], "k int, ts int, v string")
    assert rows(U.upsert(t, s, ["k"], condition="s.ts > t.ts")) == [(1, 10, "old")]
    assert rows(U.upsert(t, s, ["k"], condition="s.ts > t.ts", faithful_on=True)) == [(1, 10, "old"), (1, 5, "stale")]


def test_null_keys_insert(spark):
    t = spark.createDataFrame([(None, 1)], "k int, v int")
    assert len(rows(U.upsert(t, t, ["k"]))) == 2


KEYED_ROWS = st.dictionaries(st.integers(0, 8), st.integers(0, 3), max_size=8)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(KEYED_ROWS, KEYED_ROWS)
def test_upsert_is_a_dict_update(spark, old, new):
    make = lambda d: spark.createDataFrame(list(d.items()), "k int, v int")
    assert dict(U.upsert(make(old), make(new), ["k"]).collect()) == old | new


def test_scd2_by_batches_equals_one_pass(spark):
    history = [(k, t, (t * (k + 1) // 3) % 2 if t != 4 else None) for k in range(3) for t in range(1, 7)]
    df = spark.createDataFrame(history, "k int, t int, v int")
    whole = U.scd2_from_history(df, ["k"], ["t"], ["v"], "t")
    table = whole.limit(0)
    for t in range(1, 7):
        table = spark.createDataFrame(U.scd2_merge(table, df.where(F.col("t") == t), ["k"], ["v"], "t").collect(), whole.schema)
    assert rows(table) == rows(whole)


def test_key_with_only_closed_versions_counts_as_new(spark):
    old = spark.createDataFrame([(1, 1, 0, 1, 2, False)], "k int, t int, v int, _start int, _end int, _is_current boolean")
    new = spark.createDataFrame([(1, 5, 0)], "k int, t int, v int")
    assert (1, 5, 0, 5, None, True) in rows(U.scd2_merge(old, new, ["k"], ["v"], "t"))


def test_change_feed_applied_gives_the_new_table(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k int, v string")
    feed = U.change_feed(old, new, ["k"])
    gone = feed.where("_change_type in ('delete', 'update_preimage')").drop("_change_type")
    come = feed.where("_change_type in ('insert', 'update_postimage')").drop("_change_type")
    assert rows(old.exceptAll(gone).unionByName(come)) == rows(new)


def test_row_hash_parts_columns_and_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, ""), ("", None)], "x string, y string")
    assert df.select(C.row_hash(["x", "y"])).distinct().count() == 4
    assert df.select(C.row_hash(["x", "y"], legacy=True)).distinct().count() == 2


def test_keys_and_hashes_tell_nulls_and_separators_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", ""), ("a\x1fb", "c"), ("a", "b\x1fc"), ("\x00", "n"), (None, "n"), ("1:a", ""), ("n", None)], "x string, y string")
    assert df.select(C.row_hash(["x", "y"])).distinct().count() == df.select(C.hash_key(["x", "y"])).distinct().count() == 9


def test_latest_row_of_equal_order_is_certain(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, 1, None)], "k int, t int, v string")
    assert rows(A.latest_per(df.repartition(3), ["k"], ["t"])) == [(1, 5, "b"), (2, 1, None)]


def test_both_date_bounds_reach_the_scan(spark, data):
    from tableops.plans.queries import QUERIES

    plan = QUERIES["date_key_agg"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_entry_without_the_corpus_libraries(tmp_path):
    """A missing library of the corpus operators takes only their queries away."""
    import subprocess
    import sys

    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; print(len(e.queries()) > 100, any(n.startswith('op1_') for n in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=str(__import__("pathlib").Path(__file__).resolve().parents[1]))
    assert said.stdout.split() == ["True", "False"], said.stderr[-500:]


def test_compare_counts_duplicates_as_a_join_would(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (1,), (3,)], "x int")
    got = J.compare_tables(a, b).first()
    assert (got.original_records, got.comparison_records, got.original_distinct, got.comparison_distinct, got.only_in_b) == (5, 4, 2, 1, 1)


def test_schema_difference_is_by_name_not_substring(spark):
    got = {r.column_name: r.found_in for r in J.compare_schemas(spark.range(1).toDF("id"), spark.range(1).toDF("identity")).collect()}
    assert got == {"id": "only_a", "identity": "only_b"}


def test_numbering_is_dense_and_global_average_is_exact(spark):
    df = spark.range(997).select(F.col("id"), (F.col("id") * 7919 % 101).cast("double").alias("v")).repartition(5)
    got = A.moving_average_global(df, ["id"], ["v"], 24, chunk=50)
    from pyspark.sql import Window

    plain = df.withColumn("ma_v", F.avg("v").over(Window.orderBy("id").rowsBetween(-24, 0)))
    assert rows(got.select("id", F.round("ma_v", 9))) == rows(plain.select("id", F.round("ma_v", 9)))
    assert [r.seq for r in A.assign_sequence(df, ["id"], 5).orderBy("seq").collect()] == list(range(5, 1002))


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "k int, v int")
    assert A.assign_sequence(none, ["k"]).count() == 0
    assert U.upsert(none, none, ["k"]).count() == 0
    assert sinks.empty_like(none).schema == none.schema
    assert J.compare_tables(none, none).first().original_records == 0


def test_stale_runs(spark):
    log = spark.createDataFrame([("p", 1, "RUNNING", 1), ("p", 2, "RUNNING", 2), ("p", 2, "SUCCESS", 3), ("p", 3, "RUNNING", 5)], "process string, run_id int, status string, at int")
    log = log.withColumn("at", F.timestamp_seconds("at").cast("timestamp_ntz"))
    assert {r.run_id: r.status for r in A.mark_stale(A.run_state(log)).collect()} == {1: "STALE", 2: "SUCCESS", 3: "RUNNING"}


def test_bloom_filters_and_replaced_partitions(spark):
    path = work_dir(spark, "bloom")
    A.write_with_bloom(spark.range(1000), path, ["id"])
    assert spark.read.parquet(path).where("id = 7").count() == 1
    path = work_dir(spark, "parts")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string")
    sinks.write_partitioned(df, path, ["p"])
    sinks.replace_partitions(spark.createDataFrame([(9, "b")], "v int, p string"), path, ["p"])
    assert rows(spark.read.parquet(path).select("v", "p")) == [(1, "a"), (9, "b")]


def test_filters_reach_the_scan(spark, data):
    from tableops.plans.queries import QUERIES

    plan = QUERIES["point_lookup"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(user_id)" in plan and "props" not in plan


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_upsert_is_the_same_by_broadcast_and_by_shuffle(spark):
    t = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (None, 0, "n"), (3, 30, None)], "k int, ts int, v string")
    s = spark.createDataFrame([(1, 11, "x"), (2, 5, "late"), (None, 1, "m"), (4, 40, "new")], "k int, ts int, v string")
    for options in ({}, {"update_cols": ["v"]}, {"condition": "s.ts > t.ts"}, {"condition": "s.ts > t.ts", "faithful_on": True}, {"target_pred": F.col("t.ts") > 10}):
        assert rows(U.upsert(t, s, ["k"], **options)) == rows(U.upsert(t, s, ["k"], source_rows=4, **options))


def test_upsert_reads_and_shuffles_each_side_once(spark, data):
    e = spark.read.parquet(f"{data}/events.parquet")
    plan = U.upsert(e, e.where("event_id % 2 = 0"), ["event_id"])._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 2 and "FullOuter" in plan


def test_stream_goes_on_from_written_versions_after_a_restart(spark):
    schema = "k int, ts int, v string"
    src, state, out = (work_dir(spark, n) for n in ("source", "state", "versions"))
    empty = spark.createDataFrame([], schema)
    for n in range(4):
        spark.createDataFrame([(n, n, f"v{n}"), (0, n, f"zero{n}")], schema).coalesce(1).write.mode("append").parquet(src)
        # A new object each time knows only what the folders hold, as after a lost driver.
        S.stream_upsert(S.stream_table(spark, src, schema), S.VersionedTable(spark, out, empty.schema), ["k"], [F.desc("ts"), F.desc("v")], state)
    table = S.VersionedTable(spark, out, empty.schema)
    want = [(0, 3, "zero3"), (1, 1, "v1"), (2, 2, "v2"), (3, 3, "v3")]
    assert rows(table.latest()) == want and len(table.versions()) == table.keep
    last = table.versions()[-1]
    table.write(U.upsert(table.before(last), spark.createDataFrame([(3, 3, "v3"), (0, 3, "zero3")], schema), ["k"]), last)  # a replay
    assert rows(table.latest()) == want
    S.full_refresh(spark, state, out)
    S.full_refresh(spark, state, out)
    assert table.versions() == [] and table.latest().count() == 0


def test_dropped_tables_are_gone_and_dropping_repeats(spark):
    temp = sinks.TempTables(spark)
    temp.materialize(spark.range(3), "a")
    assert temp.append(spark.range(2), "a").count() == 5 and temp.materialize(spark.range(1), "a").count() == 1
    path = temp.paths["a"]
    temp.drop("a")
    temp.drop("a")
    temp.drop_all()
    assert glob_paths(spark, path) == []


def test_changes_of_versions(spark):
    """Opens, closes, deletes and opens again; a late change is spliced in, one that alters nothing left out."""
    version = "k string, v int, _start int, _end int, _is_current boolean"
    old = spark.createDataFrame([("a", 0, 1, 5, False), ("a", 1, 5, None, True), ("b", 2, 5, None, True), ("d", 9, 1, 3, False)], version)
    feed = spark.createDataFrame([("a", 1, 6, "u"), ("a", 3, 7, "u"), ("a", 4, 2, "u"), ("b", None, 8, "d"), ("b", 2, 9, "u"), ("c", 1, 1, "d"), ("d", None, 4, "u")], "k string, v int, at int, op string")
    got = U.apply_changes_versions(old, feed, ["k"], "at", delete_when=F.col("op") == "d")
    want = [("a", 0, 1, 2, False), ("a", 4, 2, 5, False), ("a", 1, 5, 7, False), ("a", 3, 7, None, True), ("b", 2, 5, 8, False), ("b", 2, 9, None, True), ("d", 9, 1, 3, False), ("d", None, 4, None, True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert U.apply_changes_versions(old.limit(0), feed.limit(0), ["k"], "at").count() == 0


def test_compact_sizes_files_by_what_is_stored(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(20_000).repartition(12).write.parquet(path)
    total = A.stored_bytes(spark, path)
    assert total == sum(p.stat().st_size for p in (tmp_path / "many").glob("*.parquet"))
    files = A.compact(spark.read.parquet(path), str(tmp_path / "few"), total, target_bytes=total // 3 + 1)
    assert files == 3 == len(list((tmp_path / "few").glob("*.parquet"))) and spark.read.parquet(str(tmp_path / "few")).distinct().count() == 20_000


def test_numbering_spreads_equal_values_and_shuffles_once(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(7)).alias("v")).repartition(3)
    dealt = A._ranged(df, ["v"], 8, "test")
    most = max(r["count"] for r in dealt.groupBy("__range").count().collect())
    assert most < 2 * 20_000 / 8  # 18,000 have the value 7
    got = A.assign_sequence(df, ["v"], 1, partitions=8)
    assert "Exchange rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString() and "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    ordered = [(r.seq, r.v) for r in got.orderBy("seq").collect()]
    assert [s for s, _ in ordered] == list(range(1, 20_001)) and [v for _, v in ordered] == sorted(v for _, v in ordered)
    assert got.select("id").distinct().count() == 20_000


def test_running_sums_of_a_hot_part(spark):
    from pyspark.sql import Window

    df = spark.range(3000).select("id", F.when(F.col("id") % 5 > 0, 1).when(F.col("id") % 2 == 0, F.col("id") % 7).alias("p"), (F.col("id") * 31 % 50).alias("o"), (F.col("id") % 9).alias("v")).repartition(4)
    for ties, down in ((True, False), (True, True), (False, False)):
        order = [F.desc("o") if down else F.col("o")] + ([] if ties else [F.col("id")])
        plain = df.withColumn("running", F.sum("v").over(Window.partitionBy("p").orderBy(*order)))
        got = A.running_sum(df, ["p"], ["o"] if ties else ["o", "id"], "v", ties=ties, descending=down, partitions=7)
        assert rows(got) == rows(plain)
    assert A.running_sum(df.limit(0), ["p"], ["o"], "v").count() == 0


def test_slots_take_names_in_turn(spark):
    slots = spark.createDataFrame([("a", 1, ["old"], 2), ("a", 2, [], 0), ("a", 3, [], 3), ("a", 4, [], 9), ("b", 1, ["x"], 1), ("c", 1, [], 2), (None, 1, [], 2)], "parent string, slot int, held array<string>, room int")
    names = spark.createDataFrame([("a", n) for n in "mnopqr"] + [("b", "x"), ("b", "w"), ("d", "z"), (None, "y"), ("c", None)], "parent string, name string")
    got = A.array_allocate(slots, names, "parent", "held", "room", "slot", "name")
    want = [("a", 1, ["old", "r", "q"], 2), ("a", 2, [], 0), ("a", 3, ["p", "o", "n"], 3), ("a", 4, ["m"], 9), ("b", 1, ["x"], 1), ("c", 1, [], 2), (None, 1, [], 2)]
    assert rows(got) == sorted(want, key=repr)
