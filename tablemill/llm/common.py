"""What several corpus operators share: the shared folder, written tables and words."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.functions.names import col
from tablemill.shared import discard, shared_dir, shuffles_removed, written

__all__ = ["LOWER", "UPPER", "WORD", "ascii_lower", "discard", "filtered", "open_fs", "positional", "shared_dir", "shuffles_removed", "spread", "whole", "whole_rows", "word_count", "tasks_for", "worker_held", "worker_released", "written"]

#: Bytes that end a word: ASCII white space. bytes.split() without arguments splits on just these.
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def open_fs(uri: str):
    """(file system, path) of a URI, with pyarrow, on a driver or an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def worker_held(kind: str, key: str, make: Callable[[], object]):
    """What ``make`` gives, kept for a Python worker's later tasks with the same ``kind`` and ``key``.

    A worker holds one such object, which must be bounded in size; another kind or key takes its place.
    """
    held = sys.modules.setdefault("_tablemill_worker", types.ModuleType("_tablemill_worker")).__dict__
    if held.get("held_key") != (kind, key):
        held.pop("held", None)  # before the next one is made, so that never two are held
        held.update(held=make(), held_key=(kind, key))
    return held["held"]


def worker_released() -> None:
    """Frees what a Python worker has held for other operators' tasks."""
    worker_held("", "", lambda: None)


def tasks_for(spark: SparkSession, amount: int | float | None, each: int) -> int:
    """How many tasks to share ``amount`` out to with at most about ``each``; no fewer than there are cores."""
    return max(1, -(-int(amount or 0) // each), spark.sparkContext.defaultParallelism)


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(column, UPPER, LOWER)


def word_count(column: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def spread(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit keys to independent hashes for each seed (the finaliser of splitmix64)."""
    x = keys + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def whole(docs: DataFrame) -> Column:
    """A row's columns as one struct, so that no helper column can clash with them; ``select("x.*")`` gives them back."""
    return F.struct(*map(col, docs.columns))


def positional(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names`` of ``df`` as c0, c1, …: mapInArrow can't find columns with dots in their names."""
    return df.select(*(col(c).alias(f"c{i}") for i, c in enumerate(names)))


def filtered(docs: DataFrame, run: Callable[[DataFrame], DataFrame], added: list[str], keep: Column) -> DataFrame:
    """The rows of ``docs`` for which ``keep`` holds in what ``run`` makes of them, with their own columns, also those named like ``added`` ones."""
    if not {c.lower() for c in docs.columns} & set(added):
        return run(docs).filter(keep).select(*map(col, docs.columns))
    return run(docs.select(whole(docs).alias("row"), "text")).filter(keep).select("row.*")


def whole_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """A row of ``docs`` for each row of ``kept`` (doc_id, text_hash, n), where n rows have that id and text.

    Of several the one whose columns come first as JSON.
    """
    own = kept.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "n")
    rows = docs.select(whole(docs).alias("row"), F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_hash"))
    found = rows.join(own, (F.col("text_hash") == F.col("h")) & F.col("doc").eqNullSafe(F.col("d")))
    again = found.filter("n > 1").groupBy("d", "h").agg(F.min_by("row", F.to_json("row", {"ignoreNullFields": "false"})).alias("row"))
    return found.filter("n = 1").select("row.*").unionByName(again.select("row.*"))
