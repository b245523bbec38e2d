"""Tables with keys: what Parquet can't hold is kept beside it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.functions import types as K

ROOT_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class ForeignKey:
    column: str
    table: str
    target: str | None = None


@dataclass(frozen=True)
class Source:
    """A base table: rows, primary key and foreign keys."""

    name: str
    df: DataFrame
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = field(default=())


def load(spark: SparkSession, root: str, names: tuple[str, ...] = ROOT_TABLES) -> dict[str, Source]:
    return {n: Source(n, spark.read.parquet(f"{root.rstrip('/')}/{n}.parquet")) for n in names}


def edges(sources: dict[str, Source]) -> list[tuple[str, str, str, str]]:
    """(table, column, parent, parent's column); a foreign key without a target means the parent's primary key."""
    out = []
    for s in sources.values():
        for fk in s.foreign_keys:
            if fk.table not in sources:
                raise OpError("unknown_table", f"no table {fk.table!r}")
            own = sources[fk.table].primary_key
            if fk.target is None and len(own) != 1:
                raise OpError("invalid_key", f"{fk.table} has no single primary key")
            out.append((s.name, fk.column, fk.table, fk.target or own[0]))
    return out


def foreign_keys(spark: SparkSession, sources: dict[str, Source]) -> DataFrame:
    """(table_name, column_name, parent, parent_column, row_count) of all foreign keys; row_count is the table's."""
    rows = spark.createDataFrame(edges(sources), "table_name string, column_name string, parent string, parent_column string")
    counts = None
    for name in dict.fromkeys(t for t, *_ in edges(sources)):
        own = sources[name].df.agg(F.lit(name).alias("t"), F.count("*").alias("row_count"))
        counts = own if counts is None else counts.unionByName(own)
    return rows.join(counts, F.col("table_name") == F.col("t")).drop("t") if counts is not None else rows.withColumn("row_count", F.lit(0).cast("long"))


def columns(spark: SparkSession, sources: dict[str, Source]) -> DataFrame:
    """(table_name, position, column_name, canonical_type, is_key) of all columns; nested types have no canonical type."""
    rows = []
    for s in sources.values():
        for i, f in enumerate(s.df.schema.fields):
            try:
                kind = K.of_spark(f.dataType)
            except OpError:
                kind = None
            rows.append((s.name, i, f.name, kind, f.name in s.primary_key))
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, canonical_type string, is_key boolean")
