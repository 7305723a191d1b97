"""Upserts as pure functions (target, source) -> new target, change application, and slowly changing dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys, as hashes of 8 bytes, that are broadcast to tell rows that have them from others.
NAMED_ROWS = 1 << 22
#: A source is broadcast only when its rows, counted, are at most these.
BROADCAST_ROWS = 100_000


def dedup_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], tie: bool = True) -> DataFrame:
    """The first row of each key in the order given; remaining columns break ties, so that the winner is certain."""
    rest = [F.col(c).desc_nulls_last() for c in df.columns if c not in keys] if tie else []
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *rest))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def dedup_repeated(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """As dedup_latest without ties, of rows read from files, the same each time: keys are read first, and only rows of repeated ones are shuffled.

    Keys are told apart by hashes, so a row may be shuffled for nothing, but none is missed. Above NAMED_ROWS of them all rows are.
    """
    hashed = F.xxhash64(*keys)
    many = df.groupBy(hashed.alias("__hash")).count().where("count > 1").select("__hash")
    if many.count() > NAMED_ROWS:
        return dedup_latest(df, keys, order, tie=False)
    among = lambda how: df.withColumn("__hash", hashed).join(F.broadcast(many), "__hash", how).select(*df.columns)
    return dedup_latest(among("left_semi"), keys, order, tie=False).unionByName(among("left_anti"))


def unique_keys(source: DataFrame, keys: Sequence[str], stable: bool = False) -> DataFrame:
    """source, failing when it is read if a key without nulls occurs more than once.

    A stable source is read from files, the same each time: then its keys are read first, and they alone are shuffled.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    said = F.concat(F.lit("repeated source key: "), F.to_json(F.struct(*keys)))
    if stable:
        times = source.where(whole).groupBy(*keys).count().where("count > 1").agg(F.min(said).alias("__said"))
        met = F.when(F.col("__said").isNotNull(), F.raise_error(F.col("__said"))).otherwise(F.col(keys[0]))
        return source.crossJoin(F.broadcast(times)).withColumn(keys[0], met).drop("__said")
    first = F.when(F.col("__times") > 1, F.raise_error(said)).otherwise(F.col(keys[0]))
    times = F.count(F.when(whole, 1)).over(Window.partitionBy(*keys))
    return source.withColumn("__times", times).withColumn(keys[0], first).drop("__times")


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str] | None = None,
    condition: str | None = None,
    faithful_on: bool = False,
    target_pred: Column | None = None,
    source_rows: int | None = None,
    checked: bool = False,
) -> DataFrame:
    """Rows of source with a key in target update update_cols (all others by default); the rest are inserted.

    condition is SQL over t (target row) and s (source row) that a match must meet to update; with faithful_on
    it is part of the match itself, so that a row that fails it is inserted beside the old one. target_pred limits
    the target rows that can match. Null keys match nothing. A repeated source key is an error, found in the source's own
    shuffle, unless the caller has `checked` that there is none. With source_rows known and small the source is broadcast, and
    the target is not shuffled.
    """
    source = source if checked else unique_keys(source, keys)
    columns = target.columns
    update = [c for c in columns if c not in keys] if update_cols is None else list(update_cols)
    src = source.select(*(F.col(c).cast(target.schema[c].dataType).alias(c) for c in columns))
    s = src.select(F.struct(*columns).alias("s"), *(F.col(k).alias(f"__{k}") for k in keys))
    t = target.select(F.struct(*columns).alias("t"), *keys)
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    if target_pred is not None:
        t = t.withColumn("__open", target_pred)
        on.append(F.col("__open"))
    if condition and faithful_on:
        on.append(F.expr(condition))
    changes = F.col("s").isNotNull() & (F.expr(condition) if condition and not faithful_on else F.lit(True))
    merged = {c: F.when(changes, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")) if c in update else F.col(f"t.{c}") for c in columns}
    if source_rows is None or source_rows > BROADCAST_ROWS:
        # Updates and inserts from one join: target and source are each read and shuffled once.
        both = t.join(s, on, "full")
        return both.select(*(F.when(F.col("t").isNull(), F.col(f"s.{c}")).otherwise(x).alias(c) for c, x in merged.items()))
    joined = t.join(F.broadcast(s), on, "left")
    hit = joined.where(F.col("s").isNotNull()).select("s.*").select(*keys).distinct()
    inserts = src.join(F.broadcast(hit), list(keys), "left_anti").select(*columns)
    return joined.select(*(x.alias(c) for c, x in merged.items())).unionByName(inserts)


def apply_changes(target: DataFrame, feed: DataFrame, keys: Sequence[str], sequence: str, delete_when: Column | None = None, except_cols: Sequence[str] = (), tombstones: bool = False, source_rows: int | None = None, stable: bool = False) -> DataFrame:
    """Target after a change feed: of the target's row and the changes of a key the last by sequence stands; a delete removes it.

    An older change never wins over a newer row, if the target has the sequence column (else the feed always wins). Of equal
    sequence values a delete wins, then the greater remaining columns, so that the parts of a feed may come in any order, and
    repeatedly. With tombstones the result has `_deleted` and keeps deleted rows, and so must the target of the next call: only then
    do changes older than a delete stay away. Null keys count as one key. Target and feed are each read and shuffled once; with
    source_rows, those of the feed, known and small, its changes are broadcast and the target is not shuffled. Of a stable feed,
    read from files and the same each time, only changes of keys that it repeats are shuffled to find the last.
    """
    columns = [c for c in target.columns if c not in except_cols and c != "_deleted"]
    kinds = dict(target.dtypes)
    gone = F.lit(False) if delete_when is None else F.coalesce(delete_when, F.lit(False))
    old_gone = F.coalesce("_deleted", F.lit(False)) if "_deleted" in target.columns else F.lit(False)
    moved = sequence in columns
    order = [*([] if moved else ["__sequence"]), *columns, "_deleted"]
    read = [F.col(c).cast(kinds[c]).alias(c) for c in columns]
    changes = feed.select(*read, gone.alias("_deleted"), *([] if moved else [F.col(sequence).alias("__sequence")]))
    by = sequence if moved else "__sequence"
    rest = [c for c in order if c not in keys and c not in (by, "_deleted")]
    last = [F.col(by).desc_nulls_last(), F.col("_deleted").desc(), *(F.col(c).desc_nulls_last() for c in rest)]
    latest = dedup_repeated(changes, keys, last) if stable else dedup_latest(changes, keys, last, tie=False)
    row = F.struct(*columns, "_deleted")
    t = target.select(*columns, old_gone.alias("_deleted")).select(row.alias("t"), *keys)
    s = latest.select(row.alias("s"), *(F.col(k).alias(f"__{k}") for k in keys))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    if source_rows is None or source_rows > BROADCAST_ROWS:
        both = t.join(s, on, "full")
    else:
        met = t.join(F.broadcast(s), on, "left")
        hit = met.where(F.col("s").isNotNull()).select(*keys).distinct()
        both = met.select("t", "s").unionByName(s.join(F.broadcast(hit), on, "left_anti").select(F.lit(None).cast(t.schema["t"].dataType).alias("t"), "s"))
    place = lambda side: F.struct(*(F.col(f"{side}.{c}") for c in (sequence, "_deleted", *rest)))
    newer = place("s") > place("t") if moved else F.lit(True)
    stands = F.when(F.col("s").isNull(), F.col("t")).when(F.col("t").isNull() | newer, F.col("s")).otherwise(F.col("t"))
    out = both.select(stands.alias("r")).select("r.*")
    return out if tombstones else out.where("NOT _deleted").drop("_deleted")


#: Columns that a versioned table has beside its data; one that keeps its change points also has _kind.
VERSION = ("_start", "_end", "_is_current")


def _spliced(points: DataFrame, data: Sequence[str], keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Versions of keys from their change points (data, _start, __gone), with _kind: version, same (changes nothing) or delete.

    Of points of one key and time one stands: a delete, else the greatest by its data. So the result depends on the set of
    points alone, whatever the order or the number of calls that brought them together.
    """
    rest = [c for c in data if c not in keys]
    one = F.row_number().over(Window.partitionBy(*keys, "_start").orderBy(F.desc("__gone"), *(F.col(c).desc_nulls_last() for c in rest)))
    points = points.withColumn("__one", one).where("__one = 1").drop("__one")
    order = Window.partitionBy(*keys).orderBy("_start")
    after_gap = F.coalesce(F.lag("__gone").over(order), F.lit(True))
    moved = F.lit(False)
    for c in compare:
        moved = moved | ~F.col(c).eqNullSafe(F.lag(c).over(order))
    kind = F.when(F.col("__gone"), "delete").when(after_gap | moved, "version").otherwise("same")
    shown = points.withColumn("_kind", kind).withColumn("__same", F.col("_kind") == "same")
    end = F.when(F.col("_kind") == "version", F.lead("_start").over(Window.partitionBy(*keys, "__same").orderBy("_start")))
    shown = shown.withColumn("_end", end)
    return shown.select(*data, "_start", "_end", ((F.col("_kind") == "version") & F.col("_end").isNull()).alias("_is_current"), "_kind")


def splice_changes(state: DataFrame, feed: DataFrame, keys: Sequence[str], sequence: str, compare: Sequence[str] | None = None, delete_when: Column | None = None) -> DataFrame:
    """A versioned table that keeps its change points, after more of a feed, in whatever order its parts come.

    state has the kept columns of the feed, _start, _end, _is_current and _kind; rows of kind `same` and `delete` are change points
    that no reader sees (see scd2_versions). They are what makes a late change exact: it opens a version between two others,
    cuts the earlier one short and ends where the next change begins, also where that one had changed nothing before. Late
    deletes close. Changes that come again alter nothing. Null keys count as one key.
    """
    data = [c for c in state.columns if c not in (*VERSION, "_kind")]
    kinds = dict(state.dtypes)
    gone = F.lit(False) if delete_when is None else F.coalesce(delete_when, F.lit(False))
    known = state.select(*data, "_start", (F.col("_kind") == "delete").alias("__gone"))
    come = feed.select(*(F.col(c).cast(kinds[c]).alias(c) for c in data), F.col(sequence).cast(kinds["_start"]).alias("_start"), gone.alias("__gone"))
    return _spliced(known.unionByName(come), data, keys, compare or [c for c in data if c not in keys])


def scd2_versions(state: DataFrame) -> DataFrame:
    """What readers see of a versioned table that keeps its change points."""
    return state.where("_kind = 'version'").drop("_kind")


def forget_points(state: DataFrame, before: Column) -> DataFrame:
    """state without the change points that no change after `before` can make matter: those that changed nothing until then."""
    return state.where(~((F.col("_kind") == "same") & (F.col("_start") <= before)))


def apply_changes_versions(target: DataFrame, feed: DataFrame, keys: Sequence[str], sequence: str, delete_when: Column | None = None) -> DataFrame:
    """A versioned target after a change feed: each change opens a version from its sequence value on, a delete only closes one.

    target has those columns of the feed that are kept, and _start, _end, _is_current. A late change is spliced in between
    the versions there are; changes that altered nothing are not kept in such a table, so for a feed in parts of any order
    use splice_changes. Keys that the feed doesn't name pass through. Null keys count as one key.
    """
    columns = target.columns
    data = [c for c in columns if c not in VERSION]
    named = feed.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    # A version that ends before the next one starts was closed by a delete.
    lead = F.lead("_start").over(Window.partitionBy(*keys).orderBy("_start"))
    old = target.join(named, on, "left_semi").withColumn("__next", lead)
    ends = F.when(F.col("_end").isNotNull() & (F.col("__next").isNull() | (F.col("__next") > F.col("_end"))), F.col("_end"))
    marks = F.array(F.struct(F.col("_start").alias("at"), F.lit(False).alias("gone")), F.struct(ends.alias("at"), F.lit(True).alias("gone")))
    points = old.withColumn("__point", F.explode(marks)).where("__point.at IS NOT NULL").select(*data, F.col("__point.at").alias("_start"), F.col("__point.gone").alias("_gone"))
    state = points.select("*", F.lit(None).cast(dict(target.dtypes)["_end"]).alias("_end"), F.lit(False).alias("_is_current"), F.when(F.col("_gone"), "delete").otherwise("version").alias("_kind")).drop("_gone")
    spliced = scd2_versions(splice_changes(state, feed, keys, sequence, delete_when=delete_when))
    return target.join(named, on, "left_anti").unionByName(spliced.select(*columns))


def _differs(compare: Sequence[str], a: str, b: str) -> Column:
    out = F.lit(False)
    for c in compare:
        out = out | ~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def scd2_stage(updates: DataFrame, current: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Updates keyed by merge_key, and once more with a null merge_key those that start a new version of a known key."""
    first = keys[0]
    u, c = updates.alias("u"), current.alias("c")
    again = u.join(c, [F.col(f"u.{k}") == F.col(f"c.{k}") for k in keys]).where(_differs(compare, "u", "c")).select("u.*")
    kind = dict(updates.dtypes)[first]
    return updates.withColumn("merge_key", F.col(first)).unionByName(again.withColumn("merge_key", F.lit(None).cast(kind)))


def scd2_merge(target: DataFrame, updates: DataFrame, keys: Sequence[str], compare: Sequence[str], effective: str) -> DataFrame:
    """Closes current versions whose compared columns change, and opens new ones; unchanged updates are ignored.

    target has the columns of updates and _start, _end, _is_current. History passes through untouched. Updates not after the
    start of their key's current version come too late for this merge and are left out; splice_changes takes any order.
    """
    columns = target.columns
    data = [c for c in columns if c not in ("_start", "_end", "_is_current")]
    latest = dedup_latest(updates, keys, [F.col(effective).desc()])
    history, current = target.where(~F.col("_is_current")), target.where("_is_current")
    c = current.select(F.struct(*columns).alias("c"), *keys)
    u = latest.select(F.struct(*data).alias("u"), *(F.col(k).alias(f"__{k}") for k in keys))
    both = c.join(u, [F.col(k) == F.col(f"__{k}") for k in keys], "full")
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in target.schema])

    def version(values: dict[str, Column]) -> Column:
        return F.struct(*(values[x].alias(x) for x in columns)).cast(kind)

    stays = version({x: F.col(f"c.{x}") for x in columns})
    closed = version({x: F.col(f"c.{x}") for x in columns} | {"_end": F.col(f"u.{effective}"), "_is_current": F.lit(False)})
    opened = version({x: F.col(f"u.{x}") for x in data} | {"_start": F.col(f"u.{effective}"), "_end": F.lit(None), "_is_current": F.lit(True)})
    late = F.coalesce(F.col(f"u.{effective}") <= F.col("c._start"), F.lit(False))
    # A key without a current version is new; one whose compared columns differ closes a version and opens one.
    rows = F.when(F.col("c").isNull(), F.array(opened)).when(F.col("u").isNull() | ~_differs(compare, "u", "c") | late, F.array(stays)).otherwise(F.array(closed, opened))
    return history.select(*columns).unionByName(both.select(F.explode(rows).alias("r")).select("r.*"))


def scd2_from_history(events: DataFrame, keys: Sequence[str], sequence: Sequence[str], compare: Sequence[str], effective: str) -> DataFrame:
    """All versions of each key from its whole history in one pass: rows that change nothing are left out."""
    order = Window.partitionBy(*keys).orderBy(*sequence)
    first = F.row_number().over(order) == 1
    moved = F.lit(False)
    for c in compare:
        moved = moved | ~F.col(c).eqNullSafe(F.lag(c).over(order))
    starts = events.withColumn("__new", first | moved).where("__new").drop("__new")
    end = F.lead(effective).over(order)
    return starts.withColumns({"_start": F.col(effective), "_end": end, "_is_current": end.isNull()})


def scd2_current(df: DataFrame) -> DataFrame:
    return df.where("_is_current")


def scd2_as_of(df: DataFrame, keys: Sequence[str], at: Column) -> DataFrame:
    """The newest version of each key that had started by then."""
    return dedup_latest(df.where(F.col("_start") <= at), keys, [F.col("_start").desc()])


def high_watermark(df: DataFrame, column: str, default: str = "1900-01-01 00:00:00") -> Column:
    """The greatest value so far as a literal (one row is read), or the default; a literal reaches the scan as a filter."""
    value = df.agg(F.max(column)).first()[0]
    kind = dict(df.dtypes)[column]
    return F.lit(value).cast(kind) if value is not None else F.lit(default).cast(kind)


def incremental_upsert(target: DataFrame, staging: DataFrame, keys: Sequence[str], processed: str) -> DataFrame:
    """Upserts the staging rows above the target's watermark, each key's newest; the watermark moves with updates too."""
    fresh = staging.where(F.col(processed) > high_watermark(target, processed))
    return upsert(target, dedup_latest(fresh, keys, [F.col(processed).desc()]), keys, checked=True)


def changed_only(df: DataFrame, changed_keys: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is among the changed: what a costly merge need look at."""
    return df.join(changed_keys.select(*keys).distinct(), list(keys), "left_semi")


def update_where(df: DataFrame, pred: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(pred, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(df: DataFrame, pred: Column) -> DataFrame:
    return df.where(~F.coalesce(pred, F.lit(False)))


def change_feed(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that turn one snapshot into the other: insert, update_preimage, update_postimage, delete."""
    columns = old.columns
    o = old.select(F.struct(*columns).alias("o"), *keys)
    n = new.select(F.struct(*columns).alias("n"), *(F.col(k).alias(f"__{k}") for k in keys))
    both = o.join(n, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "full")
    row = lambda kind, side: F.struct(F.lit(kind).alias("_change_type"), F.col(side).alias("row"))
    changes = (
        F.when(F.col("o").isNull(), F.array(row("insert", "n")))
        .when(F.col("n").isNull(), F.array(row("delete", "o")))
        .when(~F.col("o").eqNullSafe(F.col("n")), F.array(row("update_preimage", "o"), row("update_postimage", "n")))
    )
    return both.select(F.explode(changes).alias("c")).select("c._change_type", "c.row.*")


def as_of_version(log: DataFrame, keys: Sequence[str], version: int, deleted: str = "_deleted") -> DataFrame:
    """A table as it stood at a version, from an append-only log with _version."""
    latest = dedup_latest(log.where(F.col("_version") <= version), keys, [F.col("_version").desc()])
    return latest.where(~F.coalesce(F.col(deleted), F.lit(False))).drop("_version", deleted)


def revert_to_version(log: DataFrame, keys: Sequence[str], version: int) -> DataFrame:
    """Change rows that bring the newest version back to an earlier one."""
    newest = log.agg(F.max("_version")).first()[0]
    feed = change_feed(as_of_version(log, keys, newest if newest is not None else version), as_of_version(log, keys, version), keys)
    return feed.where(F.col("_change_type") != "update_preimage")
