import math
import random

import pytest
from pyspark.sql import functions as F

from tablemill.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=5, every=50):
    """The definition, row by row; queries with equal id and vector count once."""
    kept = []
    for i, v, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, tuple(math.floor(256 * x) for x in v)))
    out = []
    for i, q in {(i, q) for i, q in kept if i is not None and i % every == 0}:
        found = [(sum(a * b for a, b in zip(q, v)), j is None, j or 0, j) for j, v in kept if j != i]
        found.sort(key=lambda x: (-x[0], *x[1:3]))
        out += [(i, rank, j, score) for rank, (score, _, _, j) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def rows_of(rng, n, dims, clusters):
    centres = [[rng.choice([-1, 0, 1]) / 2 for _ in range(dims)] for _ in range(clusters)]
    return [(i, [c + rng.choice([-2, -1, 0, 1, 2]) / 64 for c in rng.choice(centres)], 0) for i in range(n)]


@pytest.mark.parametrize(("pivots", "block", "slice_"), [(1, 512, 10_000), (7, 3, 11), (64, 2, 5)])
def test_matches_brute_force(spark, pivots, block, slice_):
    rng = random.Random(pivots)
    rows = rows_of(rng, 300, 8, 6)
    rows += [(300 + i, rows[0][1], 1) for i in range(150)]  # a third are one vector
    rows += [(1000, None, 0), (1050, [], 0), (1100, [0.5, None], 0), (1150, [float("nan")] * 8, 0), (1200, [float("inf")] * 8, 0), (None, rows[3][1], 0)]
    rows += [(1250, [0.0] * 8, 0), (1300, [0.5, -0.25], 0), rows[0], rows[0], rows[7], (100, rows[9][1], 5)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("clash")).withColumn("v", F.lit(1))
    found = topk.top_k(df, F.col("vec_id") % 10 == 0, pivots=pivots, block=block, slice_=slice_)
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows, every=10)


def test_few_and_no_candidates(spark):
    rows = [(0, [1.0, 0.5], 0), (1, [0.25, 0.25], 0), (50, [-1.0, 0.0], 0)]
    found = topk.op11(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, found), key=str) == plain(rows)
    assert topk.op11(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0
    assert topk.op11(spark.createDataFrame([], SCHEMA)).count() == 0


def test_numbers_beyond_doubles(spark):
    rows = [(i, [float(2**24 + 2 * i), float(2**20 * (i % 5)), 1.0], 0) for i in range(60)] + [(100, [3e38, 1.0, 1.0], 0), (150, [3e38, 0.0, 1.0], 0)]
    found = sorted((tuple(r) for r in topk.op11(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    wanted = [(q, rank, j, max(-(2**63), min(2**63 - 1, s))) for q, rank, j, s in plain(rows)]
    assert [x[0::3] for x in found] == [x[0::3] for x in wanted] and len(found) == len(wanted)
    assert [x for x in found if x[3] < 2**63 - 1] == [x for x in wanted if x[3] < 2**63 - 1]


def test_bounds_exclude_cells():
    rng = random.Random(1)
    cells = topk.Cells(topk.np.array([[256.0, 0.0], [-256.0, 0.0]]), True)
    need = cells.needs(topk.np.array([[256.0, 0.0]]), topk.np.array([60000.0]))
    assert need[0, 0] < 0 and need[0, 1] > 400  # the far cell would need a radius beyond 400
    q, x = topk.np.array([[rng.randrange(-300, 300) for _ in range(5)] for _ in range(200)], float).reshape(2, 100, 5)
    p = topk.Cells(x[:7], True)
    cell, far = p.nearest(x)
    score = q @ x.T
    for i in range(100):
        assert (far[i] >= p.needs(q, score[:, i])[:, cell[i]]).all()  # a vector is never excluded by its own score
