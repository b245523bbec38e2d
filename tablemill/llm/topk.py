"""Exact top-k inner products by a Voronoi join of queries and vectors.

Vectors become whole numbers, floor(256 * x) of each component. Some of them, ``PIVOTS`` at most, are pivots,
and each vector belongs to its nearest pivot's cell, which is summed up as its number of vectors and its radius
(after Lu et al., 2012, for scores instead of distances). Queries of a cell are solved first against their own
and neighbouring cells; the k-th best score t found there is a bound for what they miss elsewhere. For a vector x of pivot p

    <q, x> = <q, p> + <q, x - p> <= <q, p> + |q| |x - p|,

so of another cell a query needs those vectors alone whose distance to their pivot is at least (t - <q, p>) / |q|,
and no cell at all whose radius is less. Only what some query of a block needs is replicated to that block; neighbouring
cells are put together until they have a block of queries, and large ones cut into slices and blocks, so that a task holds one block and reads a slice in
batches, however many vectors are in a cell or equal each other. Each task gives k rows a query, merged at the end.
Bounds decide what is read and never what is found; without structure in the data they exclude little,
and all blocks meet all slices.

Edge cases: a vector that is null or has null or non-finite components (or with no finite 256-fold) takes no part;
shorter vectors count as padded by zeros, an empty one as zeros alone; ties go to the smaller vec_id, a null
vec_id is the largest and never a query; a query's own rows are all rows of its vec_id; repeated queries with
equal vectors give one result, repeated candidates a row each; a score beyond 64 bits is held at the bounds; with fewer than
k candidates all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.common import discard, tasks_for, worker_released, written

SCALE, K = 256, 5
#: Pivots are at most so many distinct vectors, from a sample of about FROM times as many.
PIVOTS, FROM = 256, 20
#: Queries of a block and vectors of a slice, about; numbers of a batch's matrices at most.
BLOCK, SLICE, NUMBERS = 512, 32_768, 1 << 21
#: Whole numbers up to this are exact as doubles; beyond, Python's are used.
EXACT = 1 << 53
LONG = (1 << 63) - 1
#: What rounding of distances can make up, relatively.
SLACK = 1e-9


class Stored:
    """Vectors of ``dims`` whole numbers as bytes."""

    def __init__(self, dims: int, kind: np.dtype):
        self.dims, self.kind = dims, kind

    def column(self, x: np.ndarray) -> pa.Array:
        width, data = self.dims * self.kind.itemsize, pa.py_buffer(np.ascontiguousarray(x, self.kind).tobytes())
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(width)), data])

    def matrix(self, column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), self.kind).reshape(len(column), self.dims).astype(np.float64)


def _quantised(column: pa.Array, dims: int) -> np.ndarray:
    lists = column.cast(pa.list_(pa.float64()))
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dims))
    out[np.arange(dims) < sizes[:, None]] = np.floor(SCALE * flat)
    return out


def _parts(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their matrices are bounded."""
    step = max(1, min(4096, NUMBERS // max(1, dims)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


class Cells:
    """Pivots, and the nearest one of vectors."""

    def __init__(self, pivots: np.ndarray, exact: bool):
        self.pivots, self.exact = pivots, exact
        self.norms = (pivots**2).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot); the first of equally near ones."""
        if not self.exact:  # squares might overflow: one cell without a bound
            return np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        far = (x**2).sum(1)[:, None] - 2 * (x @ self.pivots.T) + self.norms
        cell = far.argmin(1)
        return cell, np.sqrt(far[np.arange(len(x)), cell])

    def needs(self, q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """For each query and cell the least distance to the pivot of vectors that may score ``floor`` or more."""
        if not self.exact:
            return np.full((len(q), len(self.pivots)), -np.inf)
        length = np.sqrt((q**2).sum(1))[:, None]
        gap = floor[:, None] - q @ self.pivots.T
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(length > 0, gap / length, np.where(gap > 0, np.inf, -np.inf))
        return np.where(np.isfinite(need), need - SLACK * (1 + np.abs(need)), need)


def _scores(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return q @ x.T
    as_int = np.frompyfunc(int, 1, 1)
    return np.asarray(as_int(q).astype(object).dot(as_int(x).astype(object).T), object)


class Best:
    """The k best candidates of each query of a block so far."""

    def __init__(self, k: int, exact: bool, number: np.ndarray, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray):
        self.k, self.exact, self.number, self.ids, self.vectors, self.floor = k, exact, number, ids, vectors, floor
        self.query, self.vec, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.score = np.zeros(0, np.float64 if exact else object)

    def add(self, ids: np.ndarray, none: np.ndarray, x: np.ndarray) -> None:
        score = _scores(self.vectors, x, self.exact)
        other = (self.ids[:, None] != ids) | none
        if self.exact and x.shape[0] > self.k:
            kth = np.partition(np.where(other, score, -np.inf), -self.k, axis=1)[:, -self.k]
            self.floor = np.maximum(self.floor, kth)
        query, at = np.nonzero(other & (score >= self.floor[:, None]))
        if not len(query):
            return
        self.query, self.vec, self.none = np.append(self.query, query), np.append(self.vec, ids[at]), np.append(self.none, none[at])
        self.score = np.append(self.score, score[query, at])
        order = np.lexsort((self.vec, self.none, -self.score if self.exact else _places(self.score), self.query))
        own = self.query[order]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        place = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
        order = order[place < self.k]
        self.query, self.vec, self.none, self.score = self.query[order], self.vec[order], self.none[order], self.score[order]

    def batch(self) -> pa.RecordBatch:
        score = self.score.astype(np.int64) if self.exact else np.array([max(-LONG - 1, min(LONG, s)) for s in self.score], np.int64)
        # The order of what is held at the bounds is settled by the exact score's place, which doubles keep apart well enough there.
        order = self.score.astype(np.float64)
        columns = [pa.array(self.number[self.query]), pa.array(self.ids[self.query]), pa.array(self.vec, mask=self.none), pa.array(score), pa.array(order)]
        return pa.RecordBatch.from_arrays(columns, names=["number", "query_id", "vec_id", "score", "rough"])


def _places(score: np.ndarray) -> np.ndarray:
    """Places of Python numbers, the largest first; equal numbers share one."""
    of = {s: i for i, s in enumerate(sorted(set(score.tolist()), reverse=True))}
    return np.fromiter((of[s] for s in score.tolist()), np.int64, len(score))


FOUND = "number long, query_id long, vec_id long, score long, rough double"


def _solved(rows: DataFrame, k: int, stored: Stored, exact: bool) -> DataFrame:
    """The k best of each query among the vectors of each meeting: rows (block, grp, slice, kind, number, id, v, floor), queries (kind 0) before vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_released()
        held, best, queries = None, None, []

        def begun() -> Best:
            number, ids, floor = (np.concatenate([q[i] for q in queries]) for i in (0, 1, 3))
            return Best(k, exact, number, ids, np.concatenate([q[2] for q in queries]), floor)

        for batch in _parts(batches, stored.dims):
            where = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            cuts = np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(where)], strict=True):
                key, kind = tuple(where[a, :3].tolist()), int(where[a, 3])
                if key != held:
                    if best is not None and len(best.query):
                        yield best.batch()
                    held, best, queries = key, None, []
                part = batch.slice(a, b - a)
                ids, vectors = part.column(5), stored.matrix(part.column(6))
                if kind == 0:
                    floor = part.column(7).fill_null(-np.inf).to_numpy()
                    queries.append((part.column(4).to_numpy(), ids.to_numpy(), vectors, floor))
                elif queries:
                    best = best or begun()
                    best.add(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), vectors)
        if best is not None and len(best.query):
            yield best.batch()

    dealt = rows.repartition("block", "grp", "slice").sortWithinPartitions("block", "grp", "slice", "kind")
    return dealt.select("block", "grp", "slice", "kind", "number", "id", "v", "floor").mapInArrow(run, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    over = Window.partitionBy("number").orderBy(F.desc("rough"), F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k)


def _pivots(whole: DataFrame, rows: int, dims: int, pivots: int) -> np.ndarray:
    """Distinct whole-number vectors of a sample by hash; the zero vector where it has none."""
    key = F.xxhash64("embedding")
    some = whole.filter(F.pmod(key, F.lit(max(1, rows // (FROM * pivots)))) == 0).select("embedding").distinct().orderBy(key).limit(pivots)
    found = some.toArrow().column("embedding").combine_chunks()  # PIVOTS vectors at most
    if not len(found):
        return np.zeros((1, dims))
    return np.unique(_quantised(found, dims), axis=0)


def _grouped(pivots: np.ndarray, asking: np.ndarray, block: int) -> np.ndarray:
    """A group of each cell: neighbouring cells, along a chain of nearest pivots, with about ``block`` queries together."""
    left, at, chain = set(range(len(pivots))), 0, []
    while left:
        left.discard(at)
        chain.append(at)
        if left:
            rest = np.array(sorted(left))
            at = int(rest[((pivots[rest] - pivots[at]) ** 2).sum(1).argmin()])
    out, group, held = np.zeros(len(pivots), np.int64), 0, 0
    for cell in chain:
        if held and held + asking[cell] > block:
            group, held = group + 1, 0
        out[cell], held = group, held + asking[cell]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = K, pivots: int = PIVOTS, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) where ``is_query`` holds its k best other rows."""
    spark = vectors.sparkSession
    kept = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= np.finfo(float).max / SCALE))
    whole = vectors.select(F.col("vec_id").cast("long").alias("id"), "embedding", F.coalesce(is_query & F.col("vec_id").isNotNull(), F.lit(False)).alias("asks")).filter(kept)
    size = whole.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims"), F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))).alias("most")).first()
    dims, most = size.dims or 0, (size.most or 0.0) * SCALE + 1
    exact = 4 * dims * most**2 < EXACT
    stored = Stored(dims, np.dtype("<f4" if most < 1 << 24 else "<f8"))
    cells = Cells(_pivots(whole, size.n, dims, pivots) if exact else np.zeros((1, dims)), exact)
    shared = spark.sparkContext.broadcast(cells)  # PIVOTS vectors at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, dims):
            x = _quantised(batch.column(1), dims)
            cell, far = shared.value.nearest(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cell, pa.int32()), pa.array(far), stored.column(x)], names=["id", "asks", "cell", "far", "v"])

    tasks = tasks_for(spark, size.n * max(1, dims), NUMBERS * 16)
    placed = whole.repartition(tasks).mapInArrow(assign, "id long, asks boolean, cell int, far double, v binary").withColumn("number", F.monotonically_increasing_id())
    placed = written(placed, "voronoi-cells")
    asked = placed.filter("asks").groupBy("id", "cell", "v").agg(F.min("number").alias("number"))

    # The summaries: a row a pivot, so small whatever the table's size.
    rows = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.count_if("asks").alias("asking")).collect()
    n, asking, radius = np.zeros(len(cells.pivots), np.int64), np.zeros(len(cells.pivots), np.int64), np.full(len(cells.pivots), -np.inf)
    for r in rows:
        n[r.cell], asking[r.cell], radius[r.cell] = r.n, r.asking, r.radius
    group = _grouped(cells.pivots, asking, block)
    of = [(i, int(g), max(1, -(-int(n[group == g].sum()) // slice_)), max(1, -(-int(asking[group == g].sum()) // block))) for i, g in enumerate(group.tolist())]
    few = F.broadcast(spark.createDataFrame(of, "cell int, grp int, slices int, blocks int"))
    parts = placed.join(few, "cell").withColumn("slice", F.expr("CAST(pmod(xxhash64(number), slices) AS INT)"))
    queries = asked.join(few, "cell").selectExpr("number", "id", "grp AS home", "slices", "v", "grp * 4294967296L + pmod(xxhash64(number), blocks) AS block")
    queries = written(queries, "voronoi-queries")
    every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")

    def meetings(asks: DataFrame, data: DataFrame) -> DataFrame:
        sides = asks.select("block", "grp", "slice", F.lit(0).alias("kind"), "number", "id", "v", "floor"), data.select("block", "grp", "slice", F.lit(1).alias("kind"), "number", "id", "v", F.lit(None).cast("double").alias("floor"))
        return _solved(sides[0].unionByName(sides[1]), k, stored, exact)

    # Every query with its own group's cells.
    at_home = queries.select("block", F.col("home").alias("grp"), every, "number", "id", "v", F.lit(None).cast("double").alias("floor"))
    blocks = queries.select("block", F.col("home").alias("grp"), "slices").distinct().select("block", "grp", every)
    home = written(_first(meetings(at_home, parts.join(blocks, ["grp", "slice"])), k), "home-neighbours")

    # What else may come in between, by the k-th best score at home.
    bounds = home.groupBy("number").agg(F.when((F.count("*") >= k) & F.lit(exact), F.min("rough")).alias("floor"))  # a rounded score is no bound

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, dims):
            need = shared.value.needs(stored.matrix(batch.column(3)), batch.column(4).fill_null(-np.inf).to_numpy())
            row, cell = np.nonzero(need <= radius)
            away = group[cell] != batch.column(5).to_numpy()[row]
            row, cell = row[away], cell[away]
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            pairs = pa.StructArray.from_arrays([pa.array(cell, pa.int32()), pa.array(need[row, cell])], names=["cell", "need"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=["number", "id", "block", "v", "floor", "needs"])

    with_bounds = queries.join(bounds, "number", "left").select("number", "id", "block", "v", "floor", "home")
    wants = written(with_bounds.mapInArrow(wanted, "number long, id long, block long, v binary, floor double, needs array<struct<cell: int, need: double>>"), "wanted-cells")
    each = wants.select("number", "block", F.explode("needs").alias("x")).select("number", "block", "x.cell", "x.need").join(few, "cell")
    groups = each.select("number", "grp", "slices").distinct()
    asks = wants.drop("needs").join(groups, "number").select("block", "grp", every, "number", "id", "v", "floor")
    # A key of this join is one slice, so that it has a bounded number of vectors.
    least = each.groupBy("block", "cell", "slices").agg(F.min("need").alias("need")).select("block", "cell", every, "need")
    data = parts.join(least, ["cell", "slice"]).filter("far >= need")
    away = written(meetings(asks, data), "other-neighbours")
    best = _first(home.drop("rank").unionByName(away), k)
    out = written(best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "top-k")
    discard(placed, queries, home, wants, away)
    return out


def op11(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: the five best rows for each row whose vec_id is divisible by 50."""
    return top_k(vectors, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5"""
