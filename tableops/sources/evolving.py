"""Tables of JSON lines whose fields and types may change from file to file.

The stream reads lines as text, so its own schema never changes and no restart is needed. Each batch finds the fields and
types of all its rows, widens the last schema by them, and writes its rows under the schema's version. Hints fix
the types of fields; rows that don't fit are kept, with their whole text in `_rescued`.

    <table>/schema/batch=n          version, field, type after batch n
    <table>/data/version=v/batch=n  rows

A batch that is replayed starts from the schema of the batches before it, so it writes the same again.

Defined results: blank lines are no rows; text that is no JSON object, a value that a hint refuses and a field that can't be
a column (`_rescued`, or a name that differs from an earlier one in case only) put the text in `_rescued`, what else fits stays;
fields that are null so far are no columns yet; nested values are kept as JSON text; integers beside fractions become
double, other mixtures string. A value read under a narrower type is cast to the wider one, not read anew.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableops.streaming.streams import run_available, stream_files
from tableops.workdir import glob_paths

RESCUED = "_rescued"
#: Most fields of a schema: a table whose keys are data has no columns.
MAX_FIELDS = 5000


def field_types(lines: DataFrame) -> DataFrame:
    """(field, type) of the top-level fields of all lines: one row for each pair that occurs."""
    parsed = lines.select(F.try_parse_json("value").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    pairs = parsed.lateralJoin(lines.sparkSession.tvf.variant_explode(F.col("v").outer())).select(F.col("key").alias("field"), F.schema_of_variant("value").alias("kind"))
    kind = F.col("kind")
    simple = F.when(kind == "BIGINT", "bigint").when(kind == "BOOLEAN", "boolean").when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "double").otherwise("string")
    return pairs.where(kind != "VOID").select("field", simple.alias("type")).distinct()


def wider(a: str, b: str) -> str:
    """The type that holds both."""
    return a if a == b else "double" if {a, b} == {"bigint", "double"} else "string"


def widen(schema: Mapping[str, str], found: list[tuple[str, str]], hints: Mapping[str, str]) -> dict[str, str]:
    """The schema with the fields found, hinted ones first, by name (small letters first) after those it has; hinted ones keep their hint."""
    out = dict(schema)
    names = {f.lower() for f in out}
    for field, kind in sorted(found, key=lambda x: (x[0] not in hints, x[0].swapcase(), x[1])):
        if field in out:
            out[field] = hints.get(field) or wider(out[field], kind)
        elif field.lower() not in names and field != RESCUED:
            out[field] = hints.get(field, kind)
            names.add(field.lower())
    if len(out) > MAX_FIELDS:
        raise ValueError(f"{len(out)} fields: keys that are data need a map or variant column")
    return out


def parse_lines(lines: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """The fields of each line, and its text in `_rescued` where something in it doesn't fit."""
    fields = [T.StructField(f, T.DataType.fromDDL(kind)) for f, kind in schema.items()]
    whole = T.StructType([*fields, T.StructField(RESCUED, T.StringType())])
    parsed = F.from_json("value", whole, {"columnNameOfCorruptRecord": RESCUED})
    keys = F.json_object_keys("value")
    unknown = F.size(F.array_except(keys, F.array(*map(F.lit, schema)).cast("array<string>"))) > 0
    # A null under a name that is no column yet loses nothing.
    lost = unknown & F.exists(F.map_entries(F.from_json("value", "map<string,string>")), lambda e: e["value"].isNotNull() & ~e["key"].isin(*schema))
    rescued = F.when(keys.isNull() | F.coalesce(lost, F.lit(False)), F.col("value")).otherwise(F.col(f"r.{RESCUED}"))
    return lines.withColumn("r", parsed).select(*(F.col(f"r.`{f}`") for f in schema), rescued.alias(RESCUED))


def _stored(spark: SparkSession, table: str, before: int | None = None) -> tuple[int, dict[str, str]]:
    """Version and fields after the last batch (before the one given)."""
    batches = sorted(int(p.rpartition("=")[2]) for p in glob_paths(spark, f"{table}/schema/batch=*"))
    batches = [b for b in batches if before is None or b < before]
    if not batches:
        return 0, {}
    rows = spark.read.parquet(f"{table}/schema/batch={batches[-1]}").orderBy("place").collect()
    return rows[0].version, {r.field: r.type for r in rows if r.field is not None}


def ingest_evolving(spark: SparkSession, src: str, table: str, checkpoint: str, hints: Mapping[str, str] | None = None, max_files: int | None = None) -> None:
    """Appends the files of JSON lines in src that earlier calls with this checkpoint have not loaded, widening the schema."""
    hints = dict(hints or {})

    def batch(df: DataFrame, n: int) -> None:
        lines = df.where("trim(value) <> ''")
        version, schema = _stored(df.sparkSession, table, n)
        found = field_types(lines).limit(4 * MAX_FIELDS + 1).collect()
        wide = widen(schema, [tuple(r) for r in found], hints)
        version += wide != schema or not version
        told = [(version, k, f, kind) for k, (f, kind) in enumerate(wide.items())] or [(version, 0, None, None)]
        parse_lines(lines, wide).write.mode("overwrite").parquet(f"{table}/data/version={version}/batch={n}")
        df.sparkSession.createDataFrame(told, "version int, place int, field string, type string").coalesce(1).write.mode("overwrite").parquet(f"{table}/schema/batch={n}")

    run_available(stream_files(spark, src, "value string", "text", max_files=max_files), checkpoint, batch=batch)


def schema_versions(spark: SparkSession, table: str) -> DataFrame:
    """version, place, field and type of every version that the table's schema has had."""
    return spark.read.schema("version int, place int, field string, type string").parquet(f"{table}/schema").drop("batch").where("field is not null").distinct()


def read_evolving(spark: SparkSession, table: str) -> DataFrame:
    """All rows under the last schema; fields that a row's version did not have are null."""
    last, schema = _stored(spark, table)
    if not last:
        raise ValueError(f"no batch in {table}")
    versions: dict[int, dict[str, str]] = {}
    for r in schema_versions(spark, table).orderBy("place").collect():
        versions.setdefault(r.version, {})[r.field] = r.type
    parts = []
    for path in glob_paths(spark, f"{table}/data/version=*"):
        had = versions.get(int(path.rpartition("=")[2]), {})
        kept = ", ".join([*(f"`{f}` {kind}" for f, kind in had.items()), f"{RESCUED} string"])
        rows = spark.read.schema(kept).parquet(f"{path}/batch=*")
        parts.append(rows.select(*((F.col(f"`{f}`") if f in had else F.lit(None)).cast(kind).alias(f) for f, kind in schema.items()), RESCUED))
    return reduce(DataFrame.unionByName, parts)
