"""Changes in any order, stored tables and their feeds, incremental views, checksum trees and packing of files."""

import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableops.operators import analytics as A
from tableops.operators import compare as J
from tableops.operators import upsert as U
from tableops.operators.stored import StoredTable, VersionLog, apply_feed
from tableops.operators.views import GroupedView
from tableops.sources.files import list_files
from tableops.streaming import streams as S
from tableops.workdir import delete_folder, glob_paths, work_dir

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Order of changes


CHANGE = "k int, v int, at int, gone boolean"
STATE = "k int, v int, _start int, _end int, _is_current boolean, _kind string"
FEED = st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(0, 2)), st.integers(1, 12), st.booleans()), max_size=14)


def versions_of(feed):
    """Brute force: versions of each key from its changes by time; of equal times a delete, else the greatest value, stands."""
    out = []
    for k in {k for k, *_ in feed}:
        last = {}
        for _, v, at, gone in sorted((x for x in feed if x[0] == k), key=lambda x: (x[3], x[1] is not None, x[1] or 0)):
            last[at] = (v, gone)
        shown = None
        for at, (v, gone) in sorted(last.items()):
            if gone or shown is None or shown[1] != v:
                if shown is not None:
                    out.append((k, shown[1], shown[0], at, False))
                shown = None if gone else (at, v)
        if shown is not None:
            out.append((k, shown[1], shown[0], None, True))
    return sorted(out, key=repr)


@FEW
@given(FEED, st.randoms(use_true_random=False))
def test_versions_don_t_depend_on_order_or_parts(spark, feed, rng):
    parts, left = [], [*feed, *feed[:2]]  # some come again
    rng.shuffle(left)
    while left:
        n = rng.randint(1, len(left))
        parts.append(left[:n])
        left = left[n:]
    state = spark.createDataFrame([], STATE)
    for part in parts:
        state = spark.createDataFrame(U.splice_changes(state, spark.createDataFrame(part, CHANGE), ["k"], "at", delete_when=F.col("gone")).collect(), STATE)
    assert rows(U.scd2_versions(state)) == versions_of(feed)


def test_splicing_equals_one_pass_over_the_history(spark):
    rng = random.Random(4)
    feed = [(rng.randint(0, 5), rng.randint(0, 2), at) for at in rng.sample(range(1000), 120)]
    df = spark.createDataFrame(feed, "k int, v int, at int")
    want = U.scd2_from_history(df, ["k"], ["at"], ["v"], "at").drop("at")
    state = spark.createDataFrame([], STATE)
    for part in range(3):
        state = spark.createDataFrame(U.splice_changes(state, df.where(F.col("at") % 3 == part), ["k"], "at").collect(), STATE)
    assert rows(U.scd2_versions(state)) == rows(want)
    # Points that changed nothing may be forgotten once nothing older can come.
    cut = U.forget_points(state, F.lit(500))
    assert cut.count() < state.count()
    later = spark.createDataFrame([(1, 7, 501), (2, 0, 777)], "k int, v int, at int")
    assert rows(U.scd2_versions(U.splice_changes(cut, later, ["k"], "at"))) == rows(U.scd2_versions(U.splice_changes(state, later, ["k"], "at")))


def test_late_changes_of_plain_versions(spark):
    version = "k int, v int, _start int, _end int, _is_current boolean"
    old = spark.createDataFrame([(1, 0, 10, 20, False), (1, 1, 30, None, True), (2, 5, 1, None, True)], version)  # deleted from 20 to 30
    feed = spark.createDataFrame([(1, 7, 15, False), (1, 8, 5, False), (1, None, 12, True), (1, 9, 25, False)], CHANGE)
    got = U.apply_changes_versions(old, feed, ["k"], "at", delete_when=F.col("gone"))
    assert rows(got) == sorted([(1, 8, 5, 10, False), (1, 0, 10, 12, False), (1, 7, 15, 20, False), (1, 9, 25, 30, False), (1, 1, 30, None, True), (2, 5, 1, None, True)], key=repr)


def test_a_late_update_doesn_t_turn_history_back(spark):
    old = spark.createDataFrame([(1, 10, "a", 10, None, True)], "k int, t int, v string, _start int, _end int, _is_current boolean")
    late = spark.createDataFrame([(1, 5, "b")], "k int, t int, v string")
    assert rows(U.scd2_merge(old, late, ["k"], ["v"], "t")) == rows(old)


@FEW
@given(FEED, st.randoms(use_true_random=False))
def test_changes_with_tombstones_don_t_depend_on_order(spark, feed, rng):
    last = {}
    for k, v, at, gone in sorted(feed, key=lambda x: (x[2], x[3], x[1] is not None, x[1] or 0)):
        last[k] = (k, v, at, gone)
    left = [*feed, *feed[:2]]
    rng.shuffle(left)
    table = spark.createDataFrame([], "k int, v int, at int, _deleted boolean")
    for part in (left[: len(left) // 2], left[len(left) // 2 :]):
        made = U.apply_changes(table, spark.createDataFrame(part, CHANGE), ["k"], "at", F.col("gone"), tombstones=True)
        table = spark.createDataFrame(made.collect(), table.schema)
    assert rows(table) == sorted(last.values(), key=repr)


def test_an_older_change_never_wins(spark):
    t = spark.createDataFrame([(1, "new", 10), (2, "x", 10), (None, "n", 10)], "k int, v string, at int")
    feed = spark.createDataFrame([(1, "old", 5, False), (2, None, 9, True), (None, "m", 11, False), (3, None, 1, True)], "k int, v string, at int, gone boolean")
    for known in (None, 4):
        assert rows(U.apply_changes(t, feed, ["k"], "at", F.col("gone"), source_rows=known)) == rows(spark.createDataFrame([(1, "new", 10), (2, "x", 10), (None, "m", 11)], t.schema))
    for k in (None, 5):
        later = spark.createDataFrame([(k, "later", 20, False), (7, "seven", 1, False), (1, None, 20, True)], feed.schema)
        assert rows(U.apply_changes(t, later, ["k"], "at", F.col("gone"), tombstones=True)) == rows(U.apply_changes(t, later, ["k"], "at", F.col("gone"), tombstones=True, source_rows=3))


def test_repeated_source_keys_are_refused(spark):
    t = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    for more in ({}, {"source_rows": 4}):
        with pytest.raises(Exception, match="repeated source key"):
            U.upsert(t, spark.createDataFrame([(1, 11), (1, 12), (3, 30)], "k int, v int"), ["k"], **more).collect()
    assert len(rows(U.upsert(t, spark.createDataFrame([(None, 1), (None, 2), (1, 5)], "k int, v int"), ["k"]))) == 4  # null keys match nothing


def test_of_a_stable_feed_only_repeated_keys_are_shuffled(spark):
    feed = spark.createDataFrame([(k, k % 3, at, at == 4 and k % 2 == 0) for k in range(100) for at in ((1,) if k > 5 else (1, 4, 2))] + [(None, 1, 1, False), (None, 2, 2, False)], CHANGE)
    path = work_dir(spark, "feed")
    feed.write.parquet(path)
    table = spark.createDataFrame([(1, 9, 9), (3, 9, 0), (50, 9, 9), (200, 0, 0)], "k int, v int, at int")
    stable, plain = (U.apply_changes(table, spark.read.parquet(path), ["k"], "at", F.col("gone"), stable=x) for x in (True, False))
    assert rows(stable) == rows(plain)
    windowed = U.dedup_repeated(spark.read.parquet(path), ["k"], [F.desc("at")])
    assert windowed.count() == 101 and "LeftAnti" in windowed._jdf.queryExecution().optimizedPlan().toString()


# Stored tables


def new_table(spark, schema="k int, v string", keys=("k",), **options):
    return StoredTable(spark, work_dir(spark, "stored"), spark.createDataFrame([], schema).schema, list(keys), **options)


def put(table, batch, n):
    table.merge(batch, n, lambda old, new: U.upsert(old, new, ["k"]))


def files_of(table):
    return {p.rsplit("/", 2)[-2] + "/" + p.rsplit("/", 1)[-1] for p in table.latest().inputFiles()}


def test_a_merge_rewrites_only_the_buckets_it_touches(spark):
    table = new_table(spark, buckets=64)
    everything = spark.range(2000).select(F.col("id").cast("int").alias("k"), F.lit("old").alias("v"))
    put(table, everything, 0)
    before, places = files_of(table), table.places(0)
    assert len(places) == 64 and set(places.values()) == {0}
    one = everything.where("k = 77").withColumn("v", F.lit("new"))
    bucket = one.select(table.bucket_of()).first()[0]
    put(table, one, 1)
    after = files_of(table)
    assert {b for b, at in table.places(1).items() if at == 1} == {bucket}
    assert {f for f in before if not f.startswith(f"bucket__={bucket}/")} == {f for f in after if not f.startswith(f"bucket__={bucket}/")}
    assert Counter(r.v for r in table.latest().collect()) == {"old": 1999, "new": 1} and table.read(0).where("v = 'new'").count() == 0
    assert rows(table.changes([1])) == [("update_postimage", 77, "new", 1), ("update_preimage", 77, "old", 1)]


def test_replays_failures_and_old_versions(spark):
    table = new_table(spark, buckets=4, keep=2)
    batch = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    put(table, batch((1, "a"), (2, "b"), (None, "n")), 0)
    put(table, batch((2, "c"), (3, "d")), 1)
    want, there = rows(table.latest()), files_of(table)
    put(table, batch((2, "other")), 1)  # a replay finds its version made
    assert rows(table.latest()) == want and files_of(table) == there
    # One that failed before its commit leaves files that no reader sees, and is made again.
    delete_folder(spark, f"{table.path}/commits/version__=1")
    assert rows(table.latest()) == [(1, "a"), (2, "b"), (None, "n")]
    put(table, batch((2, "c"), (3, "d")), 1)
    assert rows(table.latest()) == want
    with pytest.raises(ValueError):
        table.read(7)
    for n in range(2, 6):
        put(table, batch((n, str(n))), n)
    assert table.versions() == [4, 5]
    named = {(at, b) for v in (4, 5) for b, at in table.places(v).items()}
    assert {tuple(int(x.rsplit("=", 1)[1]) for x in p.rsplit("/", 2)[1:]) for p in glob_paths(spark, f"{table.path}/data/version__=*/bucket__=*")} == named
    with pytest.raises(ValueError):
        put(table, batch((9, "late")), 3)  # the versions after it are there already, its own no more
    gone = batch((1, None), (2, None)).select(table.bucket_of().alias("b"))
    kept = [r for r in table.latest().withColumn("b", table.bucket_of()).collect() if r.b not in {x.b for x in gone.collect()}]
    table.merge(batch((1, None), (2, None)), 6, lambda old, new: old.where("false"))  # buckets that lose all their rows
    assert rows(table.latest()) == sorted([(r.k, r.v) for r in kept], key=repr)


def test_feed_from_files_is_the_difference_of_the_versions(spark):
    table = new_table(spark, buckets=8, keep=10)
    rng = random.Random(2)
    for n in range(4):
        feed = spark.createDataFrame([(k, rng.choice("abc"), n, rng.random() < 0.3) for k in rng.sample(range(40), 15)], "k int, v string, at int, gone boolean")
        table.merge(feed, n, lambda old, new: U.apply_changes(old, new, ["k"], "at", F.col("gone")), only_keys=n > 1)
        if n:
            want = U.change_feed(table.read(n - 1), table.read(n), ["k"]).withColumn("_commit_version", F.lit(n).cast("long"))
            assert rows(table.changes([n])) == rows(want)
    assert rows(apply_feed(table.read(0), table.changes([1, 2, 3]), ["k"])) == rows(table.read(3))


def test_a_merge_hands_on_only_rows_that_its_batch_names(spark):
    """The others are written as they are, without a shuffle, and stay; so do null keys, and files that are many and small are packed."""
    table = new_table(spark, buckets=4, keep=2)
    table.merge(spark.range(1000).selectExpr("int(id) AS k", "'old' AS v").unionByName(spark.createDataFrame([(None, "null")], "k int, v string")), 0, lambda old, new: U.upsert(old, new, ["k"]), only_keys=True)
    want, met = {r.k: r.v for r in table.latest().collect()}, []
    for n in range(1, 7):
        feed = spark.createDataFrame([(k, f"v{n}", n, k == 5 * n) for k in range(5 * n, 5 * n + 5)] + [(None, f"null{n}", n, False), (-n, "new", n, False)], "k int, v string, at int, gone boolean")

        def change(old, new):
            met.append(old.count())
            return U.apply_changes(old, new, ["k"], "at", F.col("gone"))

        table.merge(feed, n, change, only_keys=True)
        want = want | {r.k: r.v for r in feed.collect()}
        want.pop(5 * n)
        assert {r.k: r.v for r in table.latest().collect()} == want and table.latest().count() == len(want)
        assert rows(table.changes([n])) == rows(U.change_feed(table.read(n - 1), table.read(n), ["k"]).withColumn("_commit_version", F.lit(n).cast("long")))
    assert met == [6] * 6
    assert len(files_of(table)) <= 4 * 5


def test_inserts_are_not_written_twice_and_outlive_their_data(spark):
    table = new_table(spark, buckets=4, keep=2)
    inserts = [("insert", k, "a", 0) for k in range(9)]
    table.merge(spark.range(9).selectExpr("int(id) AS k", "'a' AS v"), 0, lambda old, new: U.upsert(old, new, ["k"]), only_keys=True)
    assert glob_paths(spark, f"{table.path}/changes/*") == [] and rows(table.changes([0])) == inserts
    for n in range(1, 5):  # the last of these leave no bucket of version 0
        table.merge(spark.range(n, n + 5).selectExpr("int(id) AS k", f"'{n}' AS v"), n, lambda old, new: U.upsert(old, new, ["k"]), only_keys=True)
        assert rows(table.changes([0])) == inserts and table.changes(range(n + 1)).where("_change_type = 'insert'").count() == 9
    assert glob_paths(spark, f"{table.path}/data/version__=0/bucket__=*") == []
    table.forget_changes(3)
    assert table.committed() == [3, 4] and glob_paths(spark, f"{table.path}/changes/version__=0*") == []


def test_stable_batches_are_read_where_they_are(spark):
    path = work_dir(spark, "stable")
    spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (None, "n")], "k int, v string").coalesce(1).write.parquet(path)
    table, seen = new_table(spark, buckets=4), []
    for n in range(2):
        table.merge(spark.read.parquet(path), n, lambda old, new: seen.extend(new.inputFiles()) or U.upsert(old, U.unique_keys(new, ["k"], stable=True), ["k"], checked=True), only_keys=True, stable=True)
    assert {p.rsplit("/", 2)[1] for p in seen} == {path.rsplit("/", 1)[1]}
    assert rows(table.latest()) == sorted([(1, "a"), (2, "b"), *[(None, "n")] * 4], key=repr)
    with pytest.raises(Exception, match="repeated source key"):
        U.unique_keys(spark.read.parquet(path, path), ["k"], stable=True).collect()


def test_a_follower_goes_on_where_it_stopped(spark):
    table, copy = new_table(spark, buckets=4, keep=2), new_table(spark, buckets=2)
    state, seen = work_dir(spark, "state"), []

    def apply(changes, n):
        seen.append(sorted(r[0] for r in changes.select("_commit_version").distinct().collect()))
        copy.merge(changes, n, lambda old, feed: apply_feed(old, feed, ["k"]))

    for n in range(5):
        table.merge(spark.createDataFrame([(n, f"v{n}"), (0, f"zero{n}"), (n - 1, None)], "k int, v string"), n, lambda old, new: U.upsert(old.where("k <> 2"), U.dedup_latest(new, ["k"], []), ["k"]))
        if n in (0, 3, 4):
            S.follow_changes(table, state, apply)
            assert rows(copy.latest()) == rows(table.latest())
    assert seen == [[0], [1, 2, 3], [4]]
    late = []
    S.follow_changes(table, work_dir(spark, "other"), lambda changes, n: late.append({r[0] for r in changes.select("_commit_version").distinct().collect()}), start=3)
    assert late == [{3, 4}]


def test_stream_upsert_with_a_condition(spark):
    table, src, state = new_table(spark, "k int, at int, v string"), work_dir(spark, "source"), work_dir(spark, "state")
    for part in ([(1, 10, "new"), (2, 10, "x")], [(1, 5, "late"), (2, 11, "y"), (3, 1, "z")]):
        spark.createDataFrame(part, "k int, at int, v string").write.mode("append").parquet(src)
        S.stream_upsert(S.stream_table(spark, src, "k int, at int, v string"), table, ["k"], [F.desc("at")], state, condition="s.at > t.at")
    assert rows(table.latest()) == [(1, 10, "new"), (2, 11, "y"), (3, 1, "z")]


# Views


ITEMS = st.dictionaries(st.integers(0, 12), st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.one_of(st.none(), st.sampled_from([0.1, 0.2, 1.5, -3.0]))), max_size=10)


@FEW
@given(ITEMS, ITEMS)
def test_refreshed_view_equals_a_full_recompute(spark, old, new):
    make = lambda d: spark.createDataFrame([(k, g, x) for k, (g, x) in d.items()], "k int, g int, x double")
    changes = U.change_feed(make(old), make(new), ["k"])
    for view in (GroupedView(["g"], sums=["x"]), GroupedView(["g"], sums=["x"], extremes=["x"], distinct=["x"])):
        assert rows(view.refresh(view.compute(make(old)), changes, make(new))) == rows(view.compute(make(new)))


def test_only_groups_that_lost_an_extreme_are_read(spark):
    old = spark.createDataFrame([(k, k % 5, float(k)) for k in range(50)], "k int, g int, x double")
    changed = F.when(F.col("k") == 49, -1.0).when(F.col("k") == 22, 22.5).otherwise(F.col("x"))
    new = old.withColumn("x", changed).where("k <> 13").unionByName(spark.createDataFrame([(90, 1, 99.0)], old.schema))
    view, changes = GroupedView(["g"], sums=["x"], extremes=["x"]), U.change_feed(old, new, ["k"])
    assert [r.g for r in view.stale_groups(view.compute(old), changes).collect()] == [4]  # 49 was the greatest of its group
    assert rows(view.refresh(view.compute(old), changes, new)) == rows(view.compute(new))
    # Without the groups that moved by deltas, base still serves.
    assert rows(view.refresh(view.compute(old), changes, new.where("g = 4"))) == rows(view.compute(new))


# Checksum trees


def test_checksum_tree_joins_only_what_differs(spark):
    a = spark.range(20_000).select(F.col("id").alias("k"), F.concat(F.lit("text "), F.col("id") % 97).alias("v"))
    b = a.withColumn("v", F.when(F.col("k") == 4711, "other").otherwise(F.col("v"))).where("k <> 12").unionByName(spark.createDataFrame([(50_000, None)], a.schema))
    assert J.compare_by_checksums(a, b, ["k"]).first() == J.compare_tables(a, b).first()
    assert J.compare_by_checksums(a, a.repartition(7), ["k"]).first() == J.compare_tables(a, a).first()
    leaves = J.differing_leaves(J.checksum_leaves(a, ["k"]), J.checksum_leaves(b, ["k"]))
    read = J.rows_in_leaves(a, ["k"], leaves).count()
    assert leaves.count() == 3 and read < 40  # of 20,000
    assert rows(J.unmatched_by_checksums(a, b, ["k"])) == rows(J.rows_unmatched(a, b)) == [(12, "text 12"), (4711, f"text {4711 % 97}")]
    for x, y in ((a.limit(0), a.limit(0)), (a.limit(0), b), (b, a.limit(0))):
        assert J.compare_by_checksums(x, y, ["k"]).first() == J.compare_tables(x, y).first()


def test_checksums_tell_nulls_repeats_and_columns_apart(spark):
    schema = "k int, x string, y string"
    make = lambda *r: spark.createDataFrame(list(r), schema)
    sums = lambda *r: rows(J.checksum_leaves(make(*r), ["k"]))
    different = [sums((1, "a", None)), sums((1, None, "a")), sums((1, "a", "")), sums((1, "", "a")), sums((1, "a", "a"), (1, "a", "a")), sums((1, "b", "b"), (1, "b", "b")), sums((1, "a", "a"))]
    assert len({repr(x) for x in different}) == len(different)
    a = make((1, "a", "b"), (1, "a", "b"), (2, None, None), (None, "n", "n"))
    assert rows(J.unmatched_by_checksums(a, make((1, "a", "b"), (2, None, None), (None, "n", "m")), ["k"])) == [(None, "n", "n")]


# Packing of files


def test_large_files_stay_and_small_ones_are_packed(spark):
    path = work_dir(spark, "files")
    one = lambda lo, hi: spark.range(lo, hi, numPartitions=1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v")).write.mode("append").parquet(path)
    for k in range(5):
        one(k * 20_000, (k + 1) * 20_000)
    large = {r.path: r.length for r in list_files(spark, path).where("path LIKE '%.parquet'").collect()}
    for k in range(50):
        one(100_000 + k * 300, 100_000 + (k + 1) * 300)
    target = min(large.values())
    made = A.compact_small(spark, path, target)
    now = {r.path: r.length for r in list_files(spark, path).where("path LIKE '%.parquet'").collect()}
    assert len(large) == 5 and set(large) <= set(now) and len(now) == 5 + made and 1 <= made <= 3
    assert all(length <= 1.1 * target for p, length in now.items() if p not in large)
    assert spark.read.parquet(path).agg(F.countDistinct("id"), F.count("*")).first() == (115_000, 115_000)
    # What is packed already, a single small file at most left over, is left alone.
    again = A.compact_small(spark, path, target)
    assert again <= 1 and spark.read.parquet(path).count() == 115_000


def test_bins_hold_at_most_the_target(spark):
    rng = random.Random(3)
    files = [(f"file:/t/{rng.choice('ab')}/part {n}.parquet", rng.randint(1, 90)) for n in range(300)]
    got = A.plan_compaction(spark.createDataFrame(files, "path string, length long"), 100, 0.75).collect()
    sizes, small = Counter(), [f for f in files if f[1] < 75]
    for r in got:
        sizes[r.folder, r.part, r.bin] += r.length
    assert len(got) >= len(small) - 2 * 2 and max(sizes.values()) <= 100 and {r.path for r in got} <= {p for p, _ in small}
    assert len(sizes) <= 1.15 * sum(n for _, n in small) / 100 + 2


# Logs with snapshots, profiles in parts


def test_a_version_is_read_from_the_nearest_snapshot(spark):
    rng = random.Random(5)
    log = VersionLog(spark, work_dir(spark, "log"), spark.createDataFrame([], "k int, v int").schema, ["k"])
    tables, now = {}, {}
    for n in range(9):
        changes = {rng.randint(0, 9): (rng.randint(0, 99), rng.random() < 0.3) for _ in range(4)}
        log.append(spark.createDataFrame([(k, v, gone) for k, (v, gone) in changes.items()], "k int, v int, _deleted boolean"), n)
        now = {k: v for k, v in now.items() if k not in changes} | {k: v for k, (v, gone) in changes.items() if not gone}
        tables[n] = sorted(now.items())
        if n in (3, 6):
            log.snapshot(n)
    assert [rows(log.as_of(n)) for n in range(9)] == [tables[n] for n in range(9)]
    read = {p.split("version__=")[1].split("/")[0] for p in log.as_of(8).inputFiles()}
    assert read == {"6", "7", "8"}  # the snapshot, and the log after it
    back = log.revert(2)
    gone = {r.k for r in back.where("_change_type = 'delete'").collect()}
    put_back = {r.k: r.v for r in back.where("_change_type <> 'delete'").collect()}
    assert sorted(({k: v for k, v in tables[8] if k not in gone} | put_back).items()) == tables[2]


def test_profile_of_parts_is_the_profile_of_the_whole(spark):
    df = spark.range(30_000).select("id", (F.col("id") % 700).cast("string").alias("s"), F.when(F.col("id") % 3 > 0, F.col("id") * 0.5).alias("x"), F.lit(None).cast("double").alias("none"))
    states = None
    for part in range(3):
        state = A.profile_state(df.where(F.col("id") % 3 == part))
        states = state if states is None else states.unionByName(state)
    got = {r.column_name: r for r in A.read_profile(A.merge_profiles(states)).collect()}
    assert {c: (r.n_rows, r.n_nulls) for c, r in got.items()} == {"id": (30_000, 0), "s": (30_000, 0), "x": (30_000, 10_000), "none": (30_000, 30_000)}
    assert (got["id"].least_number, got["id"].greatest_number, got["s"].least_text, got["s"].greatest_text) == (0, 29_999, "0", "99")
    for c, n in (("id", 30_000), ("s", 700), ("x", 20_000)):
        assert abs(got[c].n_distinct / n - 1) < 0.05
    assert all(abs(q / 29_999 - share) < 0.02 for q, share in zip(got["id"].quantiles, (0.25, 0.5, 0.75), strict=True))
    assert got["s"].quantiles is None and got["none"].quantiles is None and got["none"].n_distinct == 0
    assert A.read_profile(A.merge_profiles(A.profile_state(df.limit(0)))).count() == 4


def test_star_join_follows_keys_of_earlier_dimensions(spark):
    fact = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "f int, a int")
    first, second = spark.createDataFrame([(10, 7), (20, 8)], "a_id int, b int"), spark.createDataFrame([(7, "x")], "b_id int, name string")
    assert rows(A.star_join(fact, [(first, "a", "a_id"), (second, "b", "b_id")])) == [(1, 10, 10, 7, 7, "x")]
    assert len(rows(A.star_join(fact, [(first, "a", "a_id"), (second, "b", "b_id")], how="left"))) == 3
    assert rows(A.star_join(fact, [(first, "a", "a_id")], where="b = 8")) == [(2, 20, 20, 8)]
