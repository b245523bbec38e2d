"""Cover selection against plain greedy."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.operators import cover

SCHEMA = "id long, grp string, kind string, words array<string>"


def value_of(rows, order):
    """What rows add up to if they are chosen in this order."""
    by_id, n = {r[0]: r for r in rows}, len(rows)
    often = collections.Counter(w for r in rows for w in {w for w in r[3] if w is not None})
    weight = {w: 1 + math.log1p(n / c) for w, c in often.items()}
    seen, groups, total = collections.Counter(), collections.Counter(), 0.0
    gain = lambda r: sum(weight[w] / (1 + seen[w]) for w in {w for w in r[3] if w}) / math.sqrt(max(1, len({w for w in r[3] if w}))) + 2 / (1 + groups[r[1]])
    for i in order:
        total += gain(by_id[i])
        seen.update({w for w in by_id[i][3] if w})
        groups[by_id[i][1]] += 1
    return total


def plain_greedy(rows, quota, most):
    order, left, kinds = [], list(rows), collections.Counter()
    while left and len(order) < quota:
        left = [r for r in left if kinds[r[2]] < most]
        if not left:
            break
        now = value_of(rows, order)
        best = max(left, key=lambda r: value_of(rows, [*order, r[0]]) - now)
        order.append(best[0])
        kinds[best[2]] += 1
        left.remove(best)
    return order


def table(rng, n):
    words = [f"w{i}" for i in range(80)]
    return [(i, f"g{rng.randrange(4)}", f"k{rng.randrange(6)}", rng.choices(words, [1 / (j + 1) for j in range(80)], k=rng.randrange(0, 12)) + ([None] if i % 9 == 0 else [])) for i in range(n)]


def test_value_is_near_greedys_and_caps_hold(spark):
    rows = table(random.Random(6), 150)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("gain", F.lit("clash"))
    got = cover.greedy_cover(df, "id", "words", 24, "grp", {"kind": (["kind"], 5)}, pool=60).collect()
    order = [r.id for r in sorted(got, key=lambda r: (r.round, -r.gain))]
    assert len(order) == len(set(order)) == 24
    assert max(collections.Counter(rows[i][2] for i in order).values()) <= 5
    assert value_of(rows, order) >= 0.9 * value_of(rows, plain_greedy(rows, 24, 5))
    assert max(r.round for r in got) < 24  # several rows a round


def test_caps_and_small_tables_end_it(spark):
    rows = table(random.Random(8), 12)
    df = spark.createDataFrame(rows, SCHEMA)
    kinds = collections.Counter(r[2] for r in rows)
    assert cover.greedy_cover(df, "id", "words", 50, "grp", {"kind": (["kind"], 1)}).count() == len(kinds)
    assert cover.greedy_cover(df.limit(0), "id", "words", 5, "grp").count() == 0
    assert cover.greedy_cover(df, "id", "words", 0, "grp").count() == 0
    with pytest.raises(OpError):
        cover.greedy_cover(df, "id", "words", -1, "grp")
