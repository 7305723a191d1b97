"""Comparing tables: row hashes, counts, schemas and columns; and row expectations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableops.functions.columns import measured_text, row_hash
from tableops.operators.analytics import row_count_by_grain
from tableops.workdir import work_dir


def hash_counts(df: DataFrame, columns: Sequence[str] | None = None, bits: int = 256) -> DataFrame:
    """Row hashes and how many rows have each; partial counts are added up before the shuffle."""
    return df.groupBy(row_hash(columns or df.columns, bits).alias("row_hash")).agg(F.count("*").alias("n"))


def compare_tables(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Record and distinct counts of a and of its matches in b, as a left join of all rows would count them.

    Both sides are counted by hash first, so that duplicates multiply in the numbers, not in rows. Rows of b alone are told too.
    """
    columns = columns or a.columns
    both = hash_counts(a, columns).withColumnRenamed("n", "na").join(hash_counts(b, columns).withColumnRenamed("n", "nb"), "row_hash", "full")
    in_a, in_b = F.col("na").isNotNull(), F.col("nb").isNotNull()
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    out = both.agg(
        total(F.when(in_a, F.col("na") * F.coalesce("nb", F.lit(1)))).alias("original_records"),
        total(F.when(in_a & in_b, F.col("na") * F.col("nb"))).alias("comparison_records"),
        total(in_a.cast("long")).alias("original_distinct"),
        total((in_a & in_b).cast("long")).alias("comparison_distinct"),
        total(F.when(~in_a, F.col("nb"))).alias("only_in_b"),
    )
    gap = F.col("original_records") - F.col("comparison_records")
    return out.withColumns({"difference": gap, "match_share": F.round(F.col("comparison_records") / F.when(F.col("original_records") > 0, F.col("original_records")), 6)})


#: Branches of a node of a checksum tree; a tree of two levels has LEAVES leaves.
FANOUT = 64
LEAVES = FANOUT * FANOUT


def _leaf(keys: Sequence[str], leaves: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(leaves)).cast("int")


def checksum_leaves(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, leaves: int = LEAVES) -> DataFrame:
    """leaf, n and four sums of halves of two row hashes, of the rows whose keys fall into each leaf: one scan, and a row a leaf and task to shuffle.

    Sums don't depend on the order of rows, and those of parts of a table add up to those of the whole. They can be stored with a table.
    """
    text = measured_text(columns or df.columns)
    rows = df.select(_leaf(keys, leaves).alias("leaf"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit("second"), text).alias("g"))
    half = lambda c, low: F.sum(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)) if low else F.shiftrightunsigned(F.col(c), 32))
    return rows.groupBy("leaf").agg(F.count("*").alias("n"), *(half(c, low).alias(f"{c}{int(low)}") for c in "hg" for low in (True, False)))


def _kept(sums: DataFrame) -> DataFrame:
    """Sums written and read back, as they are used more than once: at most a row a leaf. Runs when it is called."""
    path = work_dir(sums.sparkSession, "checksums")
    sums.coalesce(1).write.parquet(path)
    return sums.sparkSession.read.schema(sums.schema).parquet(path)


_SUMS = ("n", "h1", "h0", "g1", "g0")


def differing_leaves(a: DataFrame, b: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """Leaves whose checksums differ: the nodes above are compared first, and only leaves below differing ones looked at."""
    top = F.floor(F.col("leaf") / F.lit(max(1, leaves // FANOUT))).cast("int")
    up = lambda x: x.groupBy(top.alias("node")).agg(*(F.sum(c).alias(c) for c in _SUMS))

    def unequal(x: DataFrame, y: DataFrame, on: str) -> DataFrame:
        both = x.select(on, F.struct(*_SUMS).alias("x")).join(y.select(on, F.struct(*_SUMS).alias("y")), on, "full")
        return both.where(~F.col("x").eqNullSafe(F.col("y"))).select(on)

    nodes = unequal(up(a), up(b), "node")
    below = lambda x: x.withColumn("node", top).join(F.broadcast(nodes), "node", "left_semi").drop("node")  # noqa: E731 at most FANOUT rows
    return unequal(below(a), below(b), "leaf")


def rows_in_leaves(df: DataFrame, keys: Sequence[str], chosen: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """Rows of df whose keys fall into the chosen leaves, of which there are at most `leaves`."""
    return df.withColumn("__leaf", _leaf(keys, leaves)).join(F.broadcast(chosen.select(F.col("leaf").alias("__leaf"))), "__leaf", "left_semi").drop("__leaf")


def compare_by_checksums(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, leaves: int = LEAVES, sums_a: DataFrame | None = None, sums_b: DataFrame | None = None) -> DataFrame:
    """What compare_tables tells, where no row of either table occurs twice: only rows of leaves that differ are shuffled and joined.

    Equal leaves count by their sums. keys choose the leaf alone; a row that changed in them is one row gone and one more.
    Sums that are stored with a table save its scan.
    """
    columns = list(columns or a.columns)
    of_a = _kept(checksum_leaves(a, keys, columns, leaves)) if sums_a is None else sums_a
    of_b = _kept(checksum_leaves(b, keys, columns, leaves)) if sums_b is None else sums_b
    chosen = differing_leaves(of_a, of_b, leaves)
    found = compare_tables(rows_in_leaves(a, keys, chosen, leaves), rows_in_leaves(b, keys, chosen, leaves), columns)
    same = of_a.join(F.broadcast(chosen), "leaf", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("__same"))
    counts = ["original_records", "comparison_records", "original_distinct", "comparison_distinct"]
    out = found.crossJoin(same).withColumns({c: (F.col(c) + F.col("__same")).cast("long") for c in counts})  # one row each
    share = F.round(F.col("comparison_records") / F.when(F.col("original_records") > 0, F.col("original_records")), 6)
    return out.withColumn("match_share", share).select(*found.columns)


def unmatched_by_checksums(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, leaves: int = LEAVES) -> DataFrame:
    """rows_unmatched, of which only rows of leaves that differ are looked for; repeated rows too."""
    columns = list(columns or a.columns)
    chosen = differing_leaves(_kept(checksum_leaves(a, keys, columns, leaves)), _kept(checksum_leaves(b, keys, columns, leaves)), leaves)
    return rows_unmatched(rows_in_leaves(a, keys, chosen, leaves), rows_in_leaves(b, keys, chosen, leaves), columns)


def rows_unmatched(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of a whose hash is not in b."""
    columns = columns or a.columns
    return a.withColumn("row_hash", row_hash(columns, 256)).join(hash_counts(b, columns).select("row_hash"), "row_hash", "left_anti").select(*a.columns)


def rows_matched(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None, multiply: bool = False) -> DataFrame:
    """Rows of a whose hash is in b: once each, or as often as b has them."""
    columns = columns or a.columns
    left = a.withColumn("row_hash", row_hash(columns, 256))
    if not multiply:
        return left.join(hash_counts(b, columns).select("row_hash"), "row_hash", "left_semi").select(*a.columns)
    return left.join(b.select(row_hash(columns, 256).alias("row_hash")), "row_hash").select(*a.columns)


def column_diff_profile(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """For each column, the keys in both tables whose values differ."""
    both = a.alias("a").join(b.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    sums = both.agg(*(F.coalesce(F.sum((~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).cast("long")), F.lit(0)).alias(c) for c in columns))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_different")) for c in columns))).alias("r")).select("r.*")


def compare_schemas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of either table, where they are, and their types."""
    ta, tb = dict(a.dtypes), dict(b.dtypes)
    rows = [(c, "both" if c in ta and c in tb else "only_a" if c in ta else "only_b", ta.get(c), tb.get(c)) for c in dict.fromkeys([*ta, *tb])]
    return a.sparkSession.createDataFrame(rows, "column_name string, found_in string, type_a string, type_b string")


def compare_row_counts(a: DataFrame, b: DataFrame, ts: str, grain: str | None) -> DataFrame:
    """Row counts of both tables side by side; buckets of only one have a null for the other."""
    x, y = row_count_by_grain(a, ts, grain), row_count_by_grain(b, ts, grain)
    if grain in (None, "all"):
        x, y = x.withColumn("bucket", F.lit("all")), y.withColumn("bucket", F.lit("all"))
    return x.withColumnRenamed("n_rows", "n_a").join(y.withColumnRenamed("n_rows", "n_b"), "bucket", "full")


def apply_expectations(df: DataFrame, rules: Mapping[str, str], drop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows kept, failures by rule): rules are SQL conditions; those in `drop` remove the rows that fail them."""
    ok = {name: F.coalesce(F.expr(rule), F.lit(False)) for name, rule in rules.items()}
    kept = df
    for name in drop:
        kept = kept.where(ok[name])
    sums = df.agg(F.count("*").alias("__n"), *(F.coalesce(F.sum((~c).cast("long")), F.lit(0)).alias(name) for name, c in ok.items()))
    report = sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col("__n").alias("n_rows"), F.col(n).alias("n_failed")) for n in ok))).alias("r")).select("r.*")
    return kept, report
