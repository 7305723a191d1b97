"""Mixing sources to target weights by the cube method of balanced sampling.

Each source's target over its size is the expected number of copies of each of its documents. Whole copies are
certain; the fractional parts move through the null space of the balancing constraints (token total and document
total of the source) until they are 0 or 1. Blocks of documents move first, in parallel; what a block
leaves open, at most two documents, goes on to the next level, until one block a source is left; its last open
documents and a dozen held back are settled by the rounding nearest to the totals (the landing).

Defined results: null text has size 0; a null source is a source of its own, last in order; sources of size 0
have target 0 and none of their words are taken; repeated rows are sampled each for itself; no rows, no result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from random import Random

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableops.llm.common import ROW_HASH, ddl, frugal, matching, materialize, text_bytes, with_row_hash

WEIGHTS, SHARE, MAX_REPEATS = (3.0, 1.0, 2.0), 1.5, 2.0
#: Documents that one task moves at a time.
BLOCK_ROWS = 4096
#: Rows of each source that the landing settles by trying all roundings.
LANDING_ROWS = 12
_NEAR = 1e-9


def word_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, row hash, source and size (words parted by ASCII white space) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(t.split()) for t in text_bytes(batch.column(3))], pa.int64())], names=[key, ROW_HASH, "source", "size"])

    kept = with_row_hash(docs.select(key, F.col(source).cast("string").alias("source"), F.col(text).alias("__text")), "__text").select(key, ROW_HASH, "source", "__text")
    return kept.mapInArrow(frugal(run), ddl(kept.drop("__text"), "size long"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """source, source_size, n_docs and target of each source.

    Sharing by weight, with targets held at max_repeats times a source's size and the excess shared again, ends
    where each target is the lesser of that limit and one level times the weight. Sources in the order of limit
    over weight are held from the first on; the level follows from running sums.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # One row a source from here on.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int")
    ranked = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), at + 1)).withColumn("cap", max_repeats * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everywhere = Window.partitionBy(F.lit(1))
    held = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_w = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = share * F.sum("source_size").over(everywhere).cast("double")
    level = ranked.withColumn("rank", F.row_number().over(order)).withColumn("level", (total - held) / open_w).withColumn("is_open", F.col("cap") > F.col("level") * F.col("w"))
    # The level is that of the first source, in this order, whose limit is above it.
    least = F.min_by(F.when(F.col("is_open"), F.col("level")), F.when(F.col("is_open"), F.col("rank"))).over(everywhere)
    return level.select("source", "source_size", "n_docs", F.least("cap", F.coalesce(least * F.col("w"), F.col("cap"))).alias("target"))


def _flight(prob: list[float], size: list[int], order: list[int], rng: Random) -> list[int]:
    """Moves prob of the rows in order to 0 or 1 with sum(prob) and sum(prob * size) kept; returns the indices still open, two at most."""
    active: list[int] = []
    for k in order:
        if not _NEAR < prob[k] < 1 - _NEAR:
            prob[k] = round(prob[k])
            continue
        active.append(k)
        if len(active) < 3:
            continue
        i, j, k = active
        a, b, c = size[i], size[j], size[k]
        u = (c - b, a - c, b - a) if not a == b == c else (1, -1, 0)
        up = min((1 - prob[x] if s > 0 else prob[x]) / abs(s) for x, s in zip(active, u, strict=True) if s)
        down = min((prob[x] if s > 0 else 1 - prob[x]) / abs(s) for x, s in zip(active, u, strict=True) if s)
        step = up if rng.random() * (up + down) < down else -down
        for x, s in zip(active, u, strict=True):
            prob[x] += step * s
        still = []
        for x in active:
            if _NEAR < prob[x] < 1 - _NEAR:
                still.append(x)
            else:
                prob[x] = round(prob[x])
        active = still
    return active


def _landing(prob: list[float], size: list[int], left: list[int]) -> None:
    """Settles the open rows, LANDING_ROWS and two at most, by the rounding nearest to the totals expected of them: tokens, then documents."""
    if not left:
        return
    p, x = np.array([prob[k] for k in left]), np.array([size[k] for k in left], dtype=np.float64)
    taken = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    words, rows = abs(taken @ x - p @ x), abs(taken.sum(axis=1) - p.sum())
    for k, v in zip(left, taken[np.lexsort((rows, words))[0]], strict=True):
        prob[k] = int(v)


def balanced_sample(rows: DataFrame, key: str, group: str, prob: str, size: str, n_rows: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with prob moved to 0 or 1, balanced on counts and on size within each group. Same rows, same result."""
    schema, done = rows.schema, []

    def move(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            hashed = np.array([xxhash.xxh64_intdigest(str(x)) for x in pdf[key]], dtype=np.uint64)
            pdf = pdf.iloc[np.lexsort((hashed, -pdf[size].to_numpy()))]
            p, s = pdf[prob].tolist(), pdf[size].tolist()
            # Rows of all sizes are held back for the landing, where they make up for what the flight leaves.
            held = set(np.linspace(0, len(p) - 1, min(LANDING_ROWS, len(p))).astype(int).tolist()) if last else set()
            order = [k for k in range(len(p)) if k not in held]
            left = _flight(p, s, order, Random(f"{pdf[group].iloc[0]}:{len(p)}:{sum(s)}"))
            if last:
                _landing(p, s, left + [k for k in sorted(held) if _NEAR < p[k] < 1 - _NEAR])
                p = [round(v) for v in p]
            return pdf.assign(**{prob: p})

        return run

    moving = rows
    while n_rows > block_rows:
        blocks = -(-n_rows // block_rows)
        moved = materialize(moving.groupBy(group, F.pmod(F.xxhash64(key, size), F.lit(blocks))).applyInPandas(move(False), schema), "flight")
        done.append(moved.where((F.col(prob) == 0) | (F.col(prob) == 1)))
        moving = moved.where((F.col(prob) != 0) & (F.col(prob) != 1))
        n_rows = min(moving.count(), n_rows // 2)
    done.append(moving.groupBy(group).applyInPandas(move(True), schema))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """key, row hash, source, size, source_size, target, copies and taken (copies times size) of every row of docs."""
    sizes = materialize(word_sizes(docs, key, text, source), "sizes")
    targets = materialize(source_targets(sizes, weights, share, max_repeats), "targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(max_repeats), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    # One row a source: a lookup that Spark broadcasts while it is small.
    rows = sizes.join(targets.withColumn("ratio", ratio), sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rows = rows.withColumn("whole", F.floor("ratio").cast("long")).withColumn("prob", F.col("ratio") - F.col("whole")).withColumn("grp", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    settled = balanced_sample(rows.select(key, ROW_HASH, "source", "size", "source_size", "target", "whole", "prob", "grp"), key, "grp", "prob", "size", sizes.count())
    copies = (F.col("whole") + F.col("prob")).cast("long")
    return settled.select(key, ROW_HASH, "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **parameters) -> DataFrame:
    """docs as the mix takes them: a document of two copies twice, one of none not at all; all columns kept.

    Of rows repeated whole, one stands for the copies that they got together.
    """
    plan = mix_documents(docs, key, text, source, **parameters).groupBy(key, ROW_HASH).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    plan = materialize(plan, "mix")
    taken = matching(docs, plan.where("copies > 0 and rows = 1"), key, text, "inner", "copies")
    repeated = plan.where("copies > 0 and rows > 1")
    if not repeated.isEmpty():
        once = matching(docs, repeated, key, text, "inner", "copies", ROW_HASH).withColumn("id", F.col("doc")[key]).dropDuplicates(["id", ROW_HASH])
        taken = taken.unionByName(once.drop("id", ROW_HASH))
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
