"""Keys and foreign keys of tables, found in their rows.

One pass a table gives each column's rows, nulls, extremes and an estimate of its distinct values. A column without nulls whose estimate comes near the number
of its rows may be a key, and is one if no value repeats. A column may refer to a key of its kind if its
extremes lie within the key's and its estimate doesn't exceed the key's; a Bloom filter of the key's values, of a fixed size,
rejects most of the others, and an anti join decides on the rest. So a pair of columns that fails a cheap test is never joined.

Edge cases: a table without rows has no keys and refers to nothing; null values of a referring column are left out; a column without any
values refers to nothing; a key doesn't refer to itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.functions.names import col

#: Bits of a Bloom filter and hashes of a value; what an estimate of distinct values may be off by.
BITS, HASHES, OFF = 1 << 23, 3, 0.08
#: Kinds of columns that can be keys, by Spark's names; columns of one class can refer to each other.
CLASSES = {"tinyint": "whole", "smallint": "whole", "int": "whole", "bigint": "whole", "string": "text", "date": "date"}


def column_figures(table: str, df: DataFrame) -> list[dict]:
    """Of each column that can be a key: rows, nulls, distinct (estimated), low, high; in one pass."""
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() in CLASSES]
    if not names:
        return []
    made = [F.count("*").alias("rows")]
    for i, n in enumerate(names):
        made += [F.count(col(n)).alias(f"n{i}"), F.approx_count_distinct(col(n), 0.02).alias(f"d{i}"), F.min(col(n)).alias(f"l{i}"), F.max(col(n)).alias(f"h{i}")]
    row = df.agg(*made).first()
    return [{"table": table, "column": n, "kind": CLASSES[df.schema[n].dataType.simpleString()], "rows": row["rows"], "nulls": row["rows"] - row[f"n{i}"], "distinct": row[f"d{i}"], "low": row[f"l{i}"], "high": row[f"h{i}"]} for i, n in enumerate(names)]


def keys(tables: Mapping[str, DataFrame], figures: list[dict]) -> list[dict]:
    """The columns that are unique and without nulls."""
    found = []
    for f in figures:
        if f["rows"] and not f["nulls"] and f["distinct"] >= (1 - OFF) * f["rows"]:
            twice = tables[f["table"]].groupBy(col(f["column"])).agg(F.count("*").alias("n")).filter("n > 1").limit(1)
            if not twice.count():
                found.append(f)
    return found


def _places(name: str) -> list:
    return [F.pmod(F.xxhash64(col(name).cast("string"), F.lit(i)), F.lit(BITS)).alias(f"p{i}") for i in range(HASHES)]


def bloom_filter(df: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of the column's values: ``BITS`` bits, whatever the table's size."""
    bits = df.filter(col(column).isNotNull()).select(F.explode(F.array(*_places(column))).alias("p"))
    words = bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b"))
    got, out = words.toArrow(), np.zeros(BITS >> 6, np.uint64)  # a row a word at most
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out


def _passes(df: DataFrame, column: str, bloom: np.ndarray) -> bool:
    """Whether all values of the column may be in the filter."""
    shared = df.sparkSession.sparkContext.broadcast(bloom)  # BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = np.ones(batch.num_rows, bool)
            for i in range(HASHES):
                p = batch.column(i).to_numpy().astype(np.uint64)
                there &= (shared.value[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
            if not there.all():
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32())], names=["missing"])

    own = df.filter(col(column).isNotNull()).select(col(column)).distinct().select(*_places(column))
    return not own.mapInArrow(run, "missing int").limit(1).count()


def references(tables: Mapping[str, DataFrame], figures: list[dict], found: list[dict], named: bool = False) -> list[dict]:
    """(table, column, parent, parent_column, coverage, named) of all columns whose values are all among a key's.

    ``coverage`` is the share of the key's values that are referred to, by estimates; ``named`` tells whether both names agree after their first part,
    and if it is asked for no others are tried.
    """
    out, blooms = [], {}
    plain = lambda n: n.partition("_")[2] or n
    for f in figures:
        if f["low"] is None:
            continue
        for key in found:
            if f is key or f["kind"] != key["kind"] or f["low"] < key["low"] or f["high"] > key["high"] or f["distinct"] > (1 + 2 * OFF) * key["distinct"]:
                continue
            if named and plain(f["column"]) != plain(key["column"]):
                continue
            own, parent = tables[f["table"]], tables[key["table"]]
            at = key["table"], key["column"]
            if at not in blooms:
                blooms[at] = bloom_filter(parent, key["column"])
            if not _passes(own, f["column"], blooms[at]):
                continue
            values = own.filter(col(f["column"]).isNotNull()).select(col(f["column"]).alias("x")).distinct()
            missing = values.join(parent.select(col(key["column"]).alias("y")), F.col("x") == F.col("y"), "left_anti").limit(1)
            if not missing.count():
                out.append({"table": f["table"], "column": f["column"], "parent": key["table"], "parent_column": key["column"], "coverage": min(1.0, f["distinct"] / max(1, key["distinct"])), "named": plain(f["column"]) == plain(key["column"])})
    return out


def discovered(tables: Mapping[str, DataFrame], named: bool = False) -> tuple[list[dict], list[dict]]:
    """The keys and the references of the tables; each is read once for its figures."""
    figures = [f for name, df in tables.items() for f in column_figures(name, df)]
    found = keys(tables, figures)
    return found, references(tables, figures, found, named)


def found_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, row_count) of the keys."""
    spark = next(iter(tables.values())).sparkSession
    figures = [f for name, df in tables.items() for f in column_figures(name, df)]
    return spark.createDataFrame([(f["table"], f["column"], f["rows"]) for f in keys(tables, figures)], "table_name string, column_name string, row_count long")


def found_foreign_keys(tables: Mapping[str, DataFrame], named: bool = True) -> DataFrame:
    """(table_name, column_name, parent, parent_column) of the references; with ``named`` only of those whose names agree, else of all that the values allow."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(r["table"], r["column"], r["parent"], r["parent_column"]) for r in discovered(tables, named)[1]]
    return spark.createDataFrame(rows, "table_name string, column_name string, parent string, parent_column string")
