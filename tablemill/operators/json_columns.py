"""Columns of JSON text as VARIANT values: typed extraction, elements, schemas, and counts of malformed texts.

A text is parsed once, to Spark's VARIANT; paths are then read from it without parsing it again, and values of other types
than asked for are null instead of an error.

Edge cases: a null text is null and not malformed; a malformed or empty text has null everywhere and counts as malformed; a path that isn't there, or
holds JSON's null, is null; an array without elements has no rows; the schema of no rows is VOID.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.names import check_unique, col, find


def parsed(text: Column) -> Column:
    """The text as VARIANT; null if it is malformed."""
    return F.try_parse_json(text)


def extract(df: DataFrame, column: str, fields: Mapping[str, tuple[str, str]], malformed: str | None = None) -> DataFrame:
    """``df`` with typed fields {name: (path, type)}, and whether the text is malformed if ``malformed`` names a column for it."""
    check_unique([*df.columns, *fields, *([malformed] if malformed else [])])
    name = find(df.columns, column)
    rows = df.withColumn("__json", parsed(col(name)))
    made = [F.try_variant_get("__json", path, kind).alias(n) for n, (path, kind) in fields.items()]
    bad = [(col(name).isNotNull() & F.col("__json").isNull()).alias(malformed)] if malformed else []
    return rows.select(*map(col, df.columns), *made, *bad)


def elements(df: DataFrame, column: str, path: str, kind: str, position: str = "position", as_: str = "element") -> DataFrame:
    """A row of ``df`` for each element of the array at ``path``, with its position from 0 and its value of type ``kind``."""
    check_unique([*df.columns, position, as_])
    array = F.try_variant_get(parsed(col(find(df.columns, column))), path, "array<variant>")
    rows = df.select(*map(col, df.columns), F.posexplode(array).alias(position, "__element"))
    return rows.select(*map(col, df.columns), position, F.try_variant_get("__element", "$", kind).alias(as_))


def schema(df: DataFrame, column: str) -> DataFrame:
    """(schema, rows, malformed): the type that holds all values of the column, and how many texts have none."""
    text = col(find(df.columns, column))
    value = parsed(text)
    return df.agg(F.schema_of_variant_agg(value).alias("schema"), F.count(text).alias("rows"), F.count_if(text.isNotNull() & value.isNull()).alias("malformed"))
