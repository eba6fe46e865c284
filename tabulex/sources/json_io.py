"""JSON contexts in, JSON results out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RFC3339 = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'", "ignoreNullFields": "true"}


def contexts(df: DataFrame, column: str, schema: str | None = None, bad: str = "null") -> DataFrame:
    """One JSON object a row as input columns.

    With a schema (DDL) each key becomes a typed column. Without one each row
    becomes a VARIANT column ``context``, whose members are read as the types
    that expressions ask for. A text that isn't JSON gives nulls, or stops the
    query with ``bad="raise"``.
    """
    if schema is not None:
        mode = {"mode": "FAILFAST" if bad == "raise" else "PERMISSIVE"}
        return df.select(F.from_json(F.col(column), schema, mode).alias("context")).select("context.*")
    parse = F.parse_json if bad == "raise" else F.try_parse_json
    return df.select(parse(F.col(column)).alias("context"))


def results(df: DataFrame, *columns: str, name: str = "json") -> DataFrame:
    """Columns (all of them without names) as one JSON text a row: missing keys left out, dates as RFC 3339."""
    given = F.struct(*[f"`{c}`" for c in columns or df.columns])
    return df.select(F.to_json(given, RFC3339).alias(name))
