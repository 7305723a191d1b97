"""Centroid clustering (k-means in whole numbers) with ns-bounds.

Each vector carries, for every centroid, the distance at its last exact evaluation and the round of it. The history of all
centroids is kept, so that in a later round the stored distance is loosened by the norm of the centroid's total displacement
since then, which is never more than the sum of its drifts round by round. Centroids whose loosened bound is above the
distance to the present one can't be nearer; all others are evaluated exactly, and their bounds set anew. Vectors and
bounds travel together from round to round as a written table; each task adds up its clusters, and Spark adds the tasks' sums, so that
one row a cluster reaches the driver, whatever the number of vectors.

Arithmetic is exact: components are whole numbers, floor(scale * x) with x as double. Those beyond 2**27 in size
count as 2**27 of their sign, so that squared distances fit a long. Defined results: vectors of another number of components, null
vectors, and those with a null or non-finite component are left out; repeated rows count each; null keys are kept but
never start a centroid before others; of fewer vectors than centroids each starts one; without vectors there is no row. Ties
go to the smaller number. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tableops.llm.common import discard, frugal, materialize

LARGEST = 1 << 27
#: Under this size of components (64 of them) doubles hold every partial sum of products exactly.
EXACT = 1 << 22
#: Bounds are floats rounded towards safety by these shares.
BELOW, ABOVE = 1 - 1e-6, 1 + 1e-6
ROWS = 4096


@dataclass(frozen=True)
class Clustering:
    """Assigned vectors (key, vector as little-endian int32, cluster, distance), and the final centroids."""

    rows: DataFrame
    centroids: list[list[int]]
    sizes: list[int]


def whole_vectors(df: DataFrame, key: str, vector: str, size: int, scale: int) -> DataFrame:
    """key and vector (array of int) of the rows that have one."""
    x = F.col("vector")
    kept = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).where(F.size(x) == size)
    kept = kept.where(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    most = F.lit(float(LARGEST))
    whole = F.transform(x, lambda v: F.floor(F.greatest(-most, F.least(most, v * scale))).cast("int"))
    return kept.select("key", whole.alias("vector"))


def seeds(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of salt and key, in that order; equal ones by their components."""
    order = F.sha2(F.concat(F.lit(salt), F.col("key").cast("string")), 256)
    picked = vectors.select("vector", order.alias("hash")).orderBy(F.asc_nulls_last("hash"), "vector").limit(k)
    return [row["vector"] for row in picked.collect()]


def _small(*arrays: np.ndarray) -> bool:
    return max(int(np.abs(a).max(initial=0)) for a in arrays) < EXACT


def paired_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row, as int64."""
    if _small(x, c):
        gap = x.astype(np.float64) - c
        return np.einsum("ij,ij->i", gap, gap).astype(np.int64)
    return ((x - c) ** 2).sum(1)


def all_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each of c, as int64."""
    if _small(x, c):
        a, b = x.astype(np.float64), c.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


def assign(x: np.ndarray, history: list[np.ndarray], cluster: np.ndarray, low: np.ndarray, since: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of every row of x under the newest centroids; low and since are set anew in place.

    low[i, j] is a lower bound of the distance of row i to centroid j as it was in round since[i, j]; cluster is the
    assignment of the round before. Also returns how many distances were evaluated.
    """
    now, newest = len(history) - 1, history[-1]
    rows = np.arange(len(x))
    if not now:
        every = all_distances(x, newest)
        low[:] = np.sqrt(every) * BELOW
        since[:] = 0
        best = every.argmin(1)
        return best, every[rows, best], every.size
    # Norms of the total displacement of each centroid since each earlier round.
    moved = np.stack([np.sqrt(((newest - old).astype(np.float64) ** 2).sum(1)) for old in history]) * ABOVE
    best, found = cluster.copy(), paired_distances(x, newest[cluster])
    low[rows, cluster], since[rows, cluster] = np.sqrt(found) * BELOW, now
    bound = low - moved[since, np.arange(len(newest))[None, :]]
    open_ = bound <= (np.sqrt(found) * ABOVE)[:, None]
    open_[rows, cluster] = False
    evaluated = len(x)
    for j in np.flatnonzero(open_.any(0)):
        at = np.flatnonzero(open_[:, j])
        d = paired_distances(x[at], newest[j])
        evaluated += len(at)
        low[at, j], since[at, j] = np.sqrt(d) * BELOW, now
        nearer = (d < found[at]) | ((d == found[at]) & (j < best[at]))
        best[at[nearer]], found[at[nearer]] = j, d[nearer]
    return best, found, evaluated


_FIELDS = "vector binary, cluster int, distance long, low binary, since binary, sums array<long>, size long, evaluated long"


def _round(state: DataFrame, history: list[np.ndarray], key_type: str) -> DataFrame:
    """state assigned to the newest centroids, and a row for each cluster that a task has met: the sums of its vectors, and their number."""
    k, d = history[-1].shape
    first = len(history) == 1
    names = ["key", *(f.split()[0] for f in _FIELDS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes, evaluated = np.zeros((k, d), np.int64), np.zeros(k, np.int64), 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n = batch.num_rows
                if first:
                    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, d).astype(np.int64)
                    cluster, low, since = np.zeros(n, np.int64), np.zeros((n, k), np.float32), np.zeros((n, k), np.uint8)
                else:
                    x = np.frombuffer(b"".join(batch["vector"].to_pylist()), "<i4").reshape(n, d).astype(np.int64)
                    cluster = batch["cluster"].to_numpy(zero_copy_only=False).astype(np.int64)
                    low = np.frombuffer(b"".join(batch["low"].to_pylist()), "<f4").reshape(n, k).copy()
                    since = np.frombuffer(b"".join(batch["since"].to_pylist()), np.uint8).reshape(n, k).copy()
                best, found, looked = assign(x, history, cluster, low, since)
                np.add.at(sums, best, x)
                sizes += np.bincount(best, minlength=k)
                evaluated += looked
                blobs = lambda a: pa.array([row.tobytes() for row in a], pa.binary())
                columns = [batch.column(0), blobs(x.astype("<i4")), pa.array(best.astype(np.int32)), pa.array(found), blobs(low), blobs(since)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
        met = np.flatnonzero(sizes)
        if len(met):
            n = len(met)
            none = [pa.nulls(n, pa.binary()), pa.array(met.astype(np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
            looked = pa.array([evaluated] + [0] * (n - 1), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, key_arrow), *none, pa.array(list(sums[met]), pa.list_(pa.int64())), pa.array(sizes[met]), looked], names=names)

    key_arrow = to_arrow_type(state.schema["key"].dataType)
    return state.mapInArrow(frugal(run), f"key {key_type}, {_FIELDS}")


def _totals(assigned: DataFrame, k: int, d: int) -> tuple[list[list[int] | None], list[int], int]:
    """Sums and sizes of the clusters, from the rows of tasks; one row a cluster comes to the driver."""
    parts = assigned.where("size IS NOT NULL")
    wide = parts.groupBy("cluster").agg(F.sum("size").alias("n"), F.sum("evaluated").alias("looked"), *(F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(d)))
    sums: list[list[int] | None] = [None] * k
    sizes, looked = [0] * k, 0
    for row in wide.collect():
        sums[row["cluster"]] = [int(row[f"s{i}"]) for i in range(d)]
        sizes[row["cluster"]] = row["n"]
        looked += row["looked"]
    return sums, sizes, looked


def cluster_vectors(df: DataFrame, k: int, rounds: int, key: str = "vec_id", vector: str = "embedding", size: int = 64, scale: int = 256, salt: str = "2:") -> Clustering:
    """Clusters of df after `rounds` rounds of assigning and moving centroids, and a last assignment."""
    if not 0 <= rounds <= 255:
        raise ValueError("a bound's round is one byte: rounds must be 0 to 255")
    whole = whole_vectors(df, key, vector, size, scale)
    start = seeds(whole, k, salt)
    key_type = dict(whole.dtypes)["key"]
    if not start:
        none = df.sparkSession.createDataFrame([], f"key {key_type}, vector binary, cluster int, distance long")
        return Clustering(none, [], [])
    history = [np.array(start, np.int64)]
    k = len(start)
    state, before = whole, None
    for n in range(rounds + 1):
        assigned = materialize(_round(state, history, key_type), f"clusters-{n}")
        if before is not None:
            discard(before)
        sums, sizes, _ = _totals(assigned, k, size)
        before, state = assigned, assigned.where("size IS NULL").select("key", "vector", "cluster", "low", "since")
        if n < rounds:
            moved = [list(map(int, old)) if total is None else [s // count for s in total] for old, total, count in zip(history[-1], sums, sizes, strict=True)]
            history.append(np.array(moved, np.int64))
    rows = assigned.where("size IS NULL").select("key", "vector", "cluster", "distance")
    return Clustering(rows, [list(map(int, c)) for c in history[-1]], sizes)


def with_inertia(found: Clustering) -> DataFrame:
    """Rows of a clustering with their cluster's and the whole inertia, and the digest of their centroid.

    An inertia above the largest long is null.
    """
    spread = {row["cluster"]: int(row["d"]) for row in found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda v: v if v < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]

    def of_cluster(values: list, kind: str) -> Column:
        return F.array(*(F.lit(v).cast(kind) for v in values))[F.col("cluster")] if values else F.lit(None).cast(kind)

    inertia = [fits(spread.get(j, 0)) for j in range(len(found.centroids))]
    return found.rows.withColumns({"cluster_inertia": of_cluster(inertia, "long"), "inertia": F.lit(fits(sum(spread.values()))).cast("long"), "centroid_sha256": of_cluster(digests, "string")})

