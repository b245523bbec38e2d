"""Semantic match: nearest rows by the cosine of their vectors, over an inverted file of cells.

Cells are the clusters of a sample: ``SAMPLE`` vectors at most, by hash, are clustered by k-means on the driver. Every row is
then assigned to its nearest cell and written by cell. A query reads the cells whose centres are nearest to it and scores their rows
exactly. How many cells that takes is measured on the sample as well: for some of its vectors, the true neighbours
among all of the sample are found by brute force, and as many cells are read as hold ``target`` of them. With all cells read the
result is exact.

Queries and rows meet by cell, large cells in slices and queries in blocks, so that a task holds one
block of queries and reads rows in batches. Each meeting gives k rows a query; they are merged at the end.

Edge cases: null vectors, and such with null or non-finite components, take no part; shorter vectors count as padded
by zeros, and zero vectors are alike to nothing (0); a query's own id is left out; equal scores go by id; an empty table
gives an empty result; with fewer rows than asked for all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.functions.names import col
from tablemill.shared import written

#: Vectors that cells are fitted on at most; of them so many are queries when cells are measured.
SAMPLE, TRIALS = 20_000, 200
#: Cells at most (else the square root of the rows), and rounds of k-means.
CELLS, ROUNDS = 1024, 12
#: Share of the true neighbours that the cells read are to hold.
TARGET = 0.97
#: Rows of a slice and queries of a block, about, and numbers of a batch at most.
SLICE, BLOCK, NUMBERS = 65_536, 512, 1 << 21


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of length one (or zero), padded by zeros."""
    lists = column.cast(pa.list_(pa.float64()))
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims))
    out[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    most = np.abs(out).max(axis=1, initial=0.0, keepdims=True)  # scaled first, so that squares don't overflow
    out = np.divide(out, most, out=np.zeros_like(out), where=most > 0)
    length = np.sqrt((out**2).sum(1, keepdims=True))
    return np.divide(out, length, out=out, where=length > 0)


def _parts(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    step = max(1, min(4096, NUMBERS // max(1, dims)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T).argmax(1)


def clustered(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of length one of ``cells`` clusters at most, by spherical k-means from evenly spaced rows."""
    centres = np.unique(x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(np.int64)], axis=0)
    for _ in range(rounds):
        own = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.sqrt((sums**2).sum(1, keepdims=True))
        moved = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def probes_for(x: np.ndarray, centres: np.ndarray, k: int, target: float, trials: int = TRIALS) -> int:
    """How many nearest cells hold ``target`` of the k true neighbours, over some of the rows as queries."""
    some = np.linspace(0, len(x) - 1, min(trials, len(x))).astype(np.int64)
    score = x[some] @ x.T
    score[np.arange(len(some)), some] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(x[some] @ centres.T), axis=1, kind="stable"), axis=1)
    at = np.sort(np.take_along_axis(place, _nearest(x, centres)[near], axis=1).reshape(-1))
    return int(at[min(len(at) - 1, int(np.ceil(target * len(at))) - 1)]) + 1


class VectorIndex:
    """Rows by cell: (cell, slice, id, v), written once; centres on the driver, ``CELLS`` at most."""

    def __init__(self, rows: DataFrame, centres: np.ndarray, sample: np.ndarray, dims: int, slices: dict[int, int]):
        self.rows, self.centres, self.sample, self.dims, self.slices = rows, centres, sample, dims, slices

    @classmethod
    def build(cls, df: DataFrame, id_: str, vector: str, cells: int | None = None, sample: int = SAMPLE, slice_: int = SLICE) -> VectorIndex:
        spark = df.sparkSession
        sound = F.forall(col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
        own = df.select(col(id_).cast("long").alias("id"), col(vector).alias("vector")).filter(sound & F.col("id").isNotNull())
        size = own.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
        dims, key = size.dims or 0, F.xxhash64("id")
        some = own.filter(F.pmod(key, F.lit(max(1, size.n // (2 * sample)))) == 0).orderBy(key, "id").limit(sample).toArrow().column("vector").combine_chunks()  # ``sample`` vectors at most
        x = _unit(some, dims) if len(some) else np.zeros((1, dims))
        centres = clustered(x, cells or min(CELLS, max(1, int(np.sqrt(size.n)))))
        shared = spark.sparkContext.broadcast(centres)  # CELLS vectors at most

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _parts(batches, dims):
                own = _unit(batch.column(1), dims)
                v = pa.array([row.tobytes() for row in own], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_nearest(own, shared.value), pa.int32()), v], names=["id", "cell", "v"])

        placed = written(own.mapInArrow(assign, "id long, cell int, v binary"), "assigned-vectors")
        sizes = {r.cell: -(-r.n // slice_) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
        few = F.broadcast(spark.createDataFrame(list(sizes.items()), "cell int, slices int"))
        rows = placed.join(few, "cell").withColumn("slice", F.expr("CAST(pmod(xxhash64(id), slices) AS INT)")).drop("slices")
        by_cell = rows.repartitionByRange("cell", "slice").sortWithinPartitions("cell", "slice")
        return cls(written(by_cell.select("cell", "slice", "id", "v"), "vector-cells"), centres, x, dims, sizes)

    def probes(self, k: int, target: float = TARGET) -> int:
        """The number of cells to read for a recall of ``target``, measured on the sample."""
        return probes_for(self.sample, self.centres, k, target)

    def search(self, queries: DataFrame, id_: str, vector: str, k: int = 10, probes: int | None = None, block: int = BLOCK) -> DataFrame:
        """(query_id, rank, id, similarity): for each row of ``queries`` the k most similar other rows among the cells read."""
        if k < 1:
            raise OpError("invalid_argument", "at least one row is asked for")
        spark, dims, n = queries.sparkSession, self.dims, min(probes or self.probes(k), len(self.centres))
        shared = spark.sparkContext.broadcast(self.centres)
        sound = F.forall(col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))) & (F.size(col(vector)) <= dims)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _parts(batches, max(dims, len(shared.value))):
                own = _unit(batch.column(1), dims)
                cells = np.argsort(-(own @ shared.value.T), axis=1, kind="stable")[:, :n]
                v = pa.array([row.tobytes() for row in own], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * n, pa.int32()), pa.array(cells.reshape(-1), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), v, lists], names=["id", "v", "cells"])

        asked = queries.select(col(id_).cast("long").alias("id"), col(vector).alias("vector")).filter(sound & F.col("id").isNotNull())
        asked = written(asked.mapInArrow(near, "id long, v binary, cells array<int>").withColumn("number", F.monotonically_increasing_id()), "semantic-queries")
        few = F.broadcast(spark.createDataFrame(list(self.slices.items()), "cell int, slices int"))
        each = asked.select("number", "id", "v", F.explode("cells").alias("cell")).join(few, "cell")
        blocks = each.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("blocks"))
        each = each.join(F.broadcast(blocks), "cell").withColumn("block", F.expr("CAST(pmod(xxhash64(number), blocks) AS INT)"))  # a row a cell
        every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
        left = each.select("cell", every, "block", F.lit(0).alias("kind"), "number", "id", "v")
        right = self.rows.join(F.broadcast(blocks), "cell").select("cell", "slice", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("number"), "id", "v")
        met = left.unionByName(right).repartition("cell", "slice", "block").sortWithinPartitions("cell", "slice", "block", "kind")
        found = met.select("cell", "slice", "block", "kind", "number", "id", "v").mapInArrow(_meetings(k, dims), "number long, query_id long, id long, similarity double")
        over = Window.partitionBy("number").orderBy(F.desc("similarity"), "id")
        best = found.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k)
        return best.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "similarity")


def _meetings(k: int, dims: int):
    """Reads rows (cell, slice, block, kind, number, id, v), queries (kind 0) before the rows they meet; gives k rows a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best, queries = None, None, []
        for batch in _parts(batches, dims):
            where = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            cuts = np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(where)], strict=True):
                key, kind, part = tuple(where[a, :3].tolist()), int(where[a, 3]), batch.slice(a, b - a)
                if key != held:
                    if best is not None:
                        yield best.batch()
                    held, best, queries = key, None, []
                ids, v = part.column(5).to_numpy(), np.frombuffer(b"".join(part.column(6).to_pylist()), np.float64).reshape(b - a, dims)
                if kind == 0:
                    queries.append((part.column(4).to_numpy(), ids, v))
                elif queries:
                    best = best or _Best(k, *(np.concatenate(x) for x in zip(*queries, strict=True)))
                    best.add(ids, v)
        if best is not None:
            yield best.batch()

    return run


class _Best:
    """The k most similar rows of each query so far."""

    def __init__(self, k: int, number: np.ndarray, ids: np.ndarray, v: np.ndarray):
        self.k, self.number, self.ids, self.v = k, number, ids, v
        self.query, self.row, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.floor = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        score = np.round(self.v @ v.T, 12)  # so that equal vectors are equally alike, however they are batched
        score[self.ids[:, None] == ids] = -np.inf
        if len(ids) > self.k:
            self.floor = np.maximum(self.floor, np.partition(score, -self.k, axis=1)[:, -self.k])
        query, at = np.nonzero((score >= self.floor[:, None]) & (score > -np.inf))
        self.query, self.row, self.score = np.append(self.query, query), np.append(self.row, ids[at]), np.append(self.score, score[query, at])
        order = np.lexsort((self.row, -self.score, self.query))
        own = self.query[order]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        order = order[np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own)))) < self.k]
        self.query, self.row, self.score = self.query[order], self.row[order], self.score[order]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.number[self.query], self.ids[self.query], self.row, self.score)], names=["number", "query_id", "id", "similarity"])


def semantic_match(df: DataFrame, id_: str, vector: str, is_query: Column, k: int = 10, probes: int | None = None, target: float = TARGET) -> DataFrame:
    """(query_id, rank, id, similarity): for the rows of ``df`` where ``is_query`` holds their k most similar other rows."""
    index = VectorIndex.build(df, id_, vector)
    return index.search(df.filter(is_query), id_, vector, k, probes or index.probes(k, target))
