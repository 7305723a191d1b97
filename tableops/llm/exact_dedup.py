"""Exact dedup by progressive refinement: length, then hash of a prefix, then hash of the whole text.

Each text is read once, where it lies; only narrow keys travel. A row alone in its length, or alone in
its length and prefix hash, is settled there and takes no part in the later, wider groupings.

Defined results: null counts as empty; texts are equal when identical after lower-casing A-Z; of equal
texts the row with the largest doc_id stays (a null doc_id counts as smallest); of rows repeated whole `exact_groups`
marks all as kept if one is, and `drop_exact_duplicates` leaves one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableops.llm.common import ROW_HASH, attach, ddl, matching, materialize, text_bytes, with_row_hash

PREFIX_BYTES = 256


def text_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, row hash, n_bytes, prefix_hash and sha256 (binary) of the normalised text of every row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = text_bytes(pc.ascii_lower(batch.column(2).cast(pa.large_string())))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(x) for x in raw], pa.int64()),
                    pa.array([xxhash.xxh64_intdigest(x[:PREFIX_BYTES]) - (1 << 63) for x in raw], pa.int64()),
                    pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()),
                ],
                names=[key, ROW_HASH, "n_bytes", "prefix_hash", "sha256"],
            )

    kept = with_row_hash(docs.select(key, text), text).select(key, ROW_HASH, text)
    return kept.mapInArrow(digest, ddl(kept.select(key, ROW_HASH), "n_bytes long", "prefix_hash long", "sha256 binary"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, row hash, keep_id, group_size, kept and sha256 of every row of docs."""
    rows = materialize(text_keys(docs, key, text), "exact-keys")
    open_rows = rows
    for level in (["n_bytes"], ["n_bytes", "prefix_hash"]):
        shared = open_rows.groupBy(*level).count().where("count > 1").drop("count")
        open_rows = attach(open_rows, shared, level, [key, "sha256"], how="inner")
    whole = ["n_bytes", "prefix_hash", "sha256"]
    groups = open_rows.groupBy(*whole).agg(F.max(F.struct(key, ROW_HASH)).alias("keep"), F.count("*").alias("group_size")).where("group_size > 1")
    # A row outside every group is its own.
    stays = F.col("keep").isNull() | (F.col(key).eqNullSafe(F.col("keep")[key]) & (F.col(ROW_HASH) == F.col("keep")[ROW_HASH]))
    return attach(rows, groups, whole, [key, ROW_HASH]).select(
        key,
        ROW_HASH,
        F.when(F.col("keep").isNull(), F.col(key)).otherwise(F.col("keep")[key]).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        stays.alias("kept"),
        "sha256",
    )


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept."""
    groups = materialize(exact_groups(docs, key, text), "exact-groups")
    lost = materialize(groups.where(~F.col("kept")).select(key, ROW_HASH).distinct(), "exact-copies")
    out = matching(docs, lost, key, text, "left_anti")
    repeated = materialize(groups.where("kept and group_size > 1").groupBy(key, ROW_HASH).count().where("count > 1").drop("count"), "repeated")
    if not repeated.isEmpty():
        # Rows that are repeated whole, id and all: one of them stays.
        once = matching(out, repeated, key, text, "inner", ROW_HASH).select("doc", F.col("doc")[key].alias("id"), ROW_HASH).dropDuplicates(["id", ROW_HASH]).select("doc.*")
        out = matching(out, repeated, key, text, "left_anti").unionByName(once)
    return out
