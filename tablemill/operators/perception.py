"""Looking at tables: schemas, value counts, pages of rows. All of it as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.functions.conditions import condition
from tablemill.functions.names import col, find
from tablemill.functions.typed import Builder
from tablemill.sources.catalog import Source, edges
from tablemill.operators.ordering import _ties, text_key, typed_key

FULL_BELOW = 50
TOP = 10
MOST_ROWS = 20
CUT = 80


def schema_map(tables: Mapping[str, DataFrame]) -> dict[str, list[str]]:
    return {name: df.columns for name, df in tables.items()}


def catalog_overview(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count); a count of Parquet reads footers alone."""
    counts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count")) for name, df in tables.items()]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out


def describe_table(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """(table_name, position, column_name, type, nullable)"""
    rows = [(name, i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, type string, nullable boolean")


def describe_source(spark: SparkSession, sources: Mapping[str, Source], name: str) -> DataFrame:
    """As ``describe_table`` with is_key, references (``table.column`` of a foreign key, or null) and row_count of a table with keys."""
    own = sources[name]
    to = {c: f"{parent}.{target}" for t, c, parent, target in edges(sources) if t == name}
    keys = spark.createDataFrame([(f.name, f.name in own.primary_key, to.get(f.name)) for f in own.df.schema.fields], "column_name string, is_key boolean, references string")
    total = own.df.agg(F.count("*").alias("row_count"))
    return describe_table(spark, name, own.df).join(keys, "column_name").crossJoin(total)


def inspect_summary(df: DataFrame, column: str, top_k: int = TOP, full_below: int = FULL_BELOW) -> DataFrame:
    """As ``inspect_column`` with distinct_values and has_null of the column."""
    facts = column_summary(df, column).select("distinct_values", (F.col("null_rows") > 0).alias("has_null"))
    return inspect_column(df, column, top_k, full_below).crossJoin(facts)


def count_nulls(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(col(find(df.columns, column)).isNull()).alias("null_rows"))


def column_summary(df: DataFrame, column: str) -> DataFrame:
    """(distinct_values, null_rows, total_rows) of a column."""
    own = col(find(df.columns, column))
    return df.agg(F.count_distinct(own).alias("distinct_values"), F.count_if(own.isNull()).alias("null_rows"), F.count("*").alias("total_rows"))


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """(value, frequency) of a column without nulls, the most frequent first, then by value."""
    own = col(find(df.columns, column))
    out = df.filter(own.isNotNull()).groupBy(own.alias("value")).agg(F.count("*").alias("frequency")).orderBy(F.desc("frequency"), F.asc("value"))
    return out if limit is None else out.limit(limit)


def inspect_column(df: DataFrame, column: str, top_k: int = TOP, full_below: int = FULL_BELOW) -> DataFrame:
    """The ``top_k`` most frequent values, or all of them if there are at most ``full_below``; (value, frequency, complete)."""
    # One pass: full_below + 1 values tell whether that is all, and hold the first top_k.
    rows = value_counts(df, column, max(full_below, top_k) + 1).withColumn("rank", F.monotonically_increasing_id())
    few = rows.agg((F.count("*") <= full_below).alias("complete"))
    return rows.crossJoin(few).filter(F.col("complete") | (F.col("rank") < top_k)).select("value", "frequency", "complete")


def sample_values(df: DataFrame, column: str, n: int, cut: int = CUT) -> DataFrame:
    """(value): ``n`` distinct values that are not empty, in order, cut to ``cut`` characters."""
    own = col(find(df.columns, column)).cast("string")
    return df.filter(own.isNotNull() & (F.trim(own) != "")).select(F.substring(own, 1, cut).alias("value")).distinct().orderBy("value").limit(n)


def read_subtable(df: DataFrame, columns: list[str] | None = None, limit: int = MOST_ROWS, conditions=None, order_by: list[str] | None = None, offset: int = 0) -> DataFrame:
    """A page of at most 20 rows."""
    if not 0 < limit <= MOST_ROWS:
        raise OpError("invalid_limit", f"a page has 1 to {MOST_ROWS} rows")
    out = df.filter(condition(conditions, df.columns)) if conditions else df
    if order_by:
        out = out.orderBy(*(text_key(df, o) for o in order_by))
    out = out.limit(offset + limit).offset(offset) if offset else out.limit(limit)
    return out.select(*(col(find(df.columns, c)) for c in columns)) if columns else out


def read_rows(df: DataFrame, columns: list[str] | None = None, limit: int = MOST_ROWS, conditions=None, order_by: list[Mapping] | None = None, offset: int = 0) -> tuple[DataFrame, bool]:
    """A page in a typed order that has no ties left, and whether more rows follow."""
    out = df.filter(Builder(df).predicate(conditions)) if conditions else df
    out = out.orderBy(*(typed_key(df, k) for k in order_by or []), *_ties(df)).limit(offset + limit + 1).offset(offset)
    more = out.count() > limit
    out = out.limit(limit)
    return (out.select(*(col(find(df.columns, c)) for c in columns)) if columns else out), more


def preview(df: DataFrame, cell_limit: int = 100) -> DataFrame:
    """The first rows, as many as have ``cell_limit`` cells."""
    return df.limit(max(1, cell_limit // max(1, len(df.columns))))


def page(df: DataFrame, number: int, size: int, order_by: list[str]) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows with total_rows beside each."""
    total = df.agg(F.count("*").alias("total_rows"))
    return df.orderBy(*(text_key(df, o) for o in order_by)).limit((number + 1) * size).offset(number * size).crossJoin(total)
