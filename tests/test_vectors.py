"""Semantic match against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.operators import vectors
from tablemill.session import table

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k, every):
    own = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in own:
        if i % every == 0:
            n = np.linalg.norm(q)
            found = sorted(((-round(float(q @ v / (n * np.linalg.norm(v))) if n and np.linalg.norm(v) else 0.0, 9), j) for j, v in own if j != i))[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(found, 1)]
    return sorted(out)


def rows_of(rng, n):
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    return [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize(("cells", "slice_", "block"), [(1, 65_536, 512), (9, 20, 2)])
def test_all_cells_give_the_exact_result(spark, cells, slice_, block):
    rows = rows_of(random.Random(2), 300) + [(400 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(120)]
    rows += [(600, None), (610, [None] * 6), (620, [float("nan")] * 6), (630, [0.0] * 6), (640, [3e38] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cell", F.lit("clash"))
    index = vectors.VectorIndex.build(df, "vec_id", "embedding", cells, slice_=slice_)
    got = index.search(df.filter("vec_id % 10 = 0"), "vec_id", "embedding", 10, probes=cells, block=block)
    want = plain([(i, np.float32(v).tolist() if v and None not in v else v) for i, v in rows], 10, 10)
    found = sorted((r.query_id, r.rank, r.id, round(r.similarity, 9) + 0.0) for r in got.collect())
    assert [x[:2] + x[3:] for x in found] == [x[:2] + x[3:] for x in want]
    assert sum(a[2] == b[2] for a, b in zip(found, want, strict=True)) > 0.98 * len(want)  # others differ in what rounding makes of ties


def test_recall_of_the_cells_read(spark):
    """At least 0.9 of the ten true neighbours, over the given vectors, which have no clusters, and over clustered ones."""
    for rows in ([tuple(r) for r in table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding").collect()], rows_of(random.Random(5), 3000)):
        df = spark.createDataFrame(rows, SCHEMA)
        index = vectors.VectorIndex.build(df, "vec_id", "embedding")
        probes = index.probes(10)
        assert 1 <= probes < len(index.centres)
        got = {(r.query_id, r.id) for r in index.search(df.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10).collect()}
        want = {(q, j) for q, _, j, _ in plain(rows, 10, 50)}
        assert len(got & want) >= 0.9 * len(want)
    assert probes <= len(index.centres) / 3  # clusters leave most cells unread


def test_edges(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (50, [0.0])], SCHEMA)
    found = vectors.semantic_match(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.id) for r in found) == [(0, 1, 1), (0, 2, 50), (50, 1, 0), (50, 2, 1)]
    assert vectors.semantic_match(df.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0
    with pytest.raises(OpError):
        vectors.VectorIndex.build(df, "vec_id", "embedding").search(df, "vec_id", "embedding", 0)
