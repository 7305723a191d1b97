"""Column expressions and projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ntz(column: Column) -> Column:
    """A time as timestamp_ntz, the type of the stored tables."""
    return column.cast("timestamp_ntz")


def hour_of(column: str) -> Column:
    return ntz(F.date_trunc("hour", F.col(column)))


def date_key_to_date(column: str) -> Column:
    """Integer yyyymmdd as a date."""
    return F.to_date(F.col(column).cast("string"), "yyyyMMdd")


def cast_projection(df: DataFrame, casts: Mapping[str, str]) -> DataFrame:
    """The columns named, cast to the types given; a bare decimal is decimal(10,0), rounded half up."""
    return df.select(*(F.col(c).cast("decimal(10,0)" if t == "decimal" else t).alias(c) for c, t in casts.items()))


def json_extract(df: DataFrame, column: str, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """df with columns from JSON paths: name -> (path, type)."""
    return df.withColumns({name: F.get_json_object(column, path).try_cast(kind) for name, (path, kind) in fields.items()})


def schema_casts(schema: T.StructType, prefix: str = "") -> dict[str, str]:
    """Flat name -> type of every leaf of a schema, nested names joined by an underscore."""
    out: dict[str, str] = {}
    for field in schema.fields:
        if isinstance(field.dataType, T.StructType):
            out |= schema_casts(field.dataType, f"{prefix}{field.name}_")
        else:
            out[prefix + field.name] = field.dataType.simpleString()
    return out


def flatten_json(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """df with the JSON column's leaves as columns of their own in its place."""

    def leaves(of: T.StructType, path: str, prefix: str):
        for field in of.fields:
            here = f"{path}.{field.name}"
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here, f"{prefix}{field.name}_")
            else:
                yield F.col(here).alias(prefix + field.name)

    parsed = df.withColumn("__json", F.from_json(column, schema))
    return parsed.select(*(c for c in df.columns if c != column), *leaves(schema, "__json", ""))


def select_except(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def reorder_columns(df: DataFrame, front: Sequence[str]) -> DataFrame:
    """df with the columns named first."""
    return df.select(*front, *(c for c in df.columns if c not in front))


def with_audit_columns(df: DataFrame, at: Column | None = None) -> DataFrame:
    """df with ingest_timestamp, processed_watermark and processed_date, of now or of a given time."""
    at = F.current_timestamp() if at is None else at
    return df.withColumns({"ingest_timestamp": at, "processed_watermark": at, "processed_date": F.to_date(at)})


def row_hash(columns: Sequence[str], bits: int = 512, legacy: bool = False) -> Column:
    """SHA-2 of a row: of each value with its length before it, so that no separator in a value can move it; null has a mark of its own.

    legacy joins the values bare, null as empty.
    """
    if legacy:
        return F.sha2(F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), bits)
    return F.sha2(measured_text(columns), bits)


def measured_text(columns: Sequence[str]) -> Column:
    """Values as text, each after its length; null is `n`, which no length is."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.concat(*(F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("n")) for t in texts))


def hash_key(columns: Sequence[str]) -> Column:
    """A surrogate key that the same values always get, nulls among them: ('a', null) and (null, 'a') differ."""
    return F.md5(measured_text(columns))


def uuid_key() -> Column:
    return F.expr("uuid()")
