"""What keeps the work of some queries in proportion to their input, or spread over tasks."""

import operator
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tablemill.operators import joins, records
from tablemill.plans import discovery_queries


def tasks(df):
    return df.rdd.getNumPartitions()


def test_joins_by_comparisons_are_work_for_all_cores(spark):
    left = spark.range(400).selectExpr("id % 3 AS k", "id AS x").coalesce(1)
    right = spark.range(50).selectExpr("id % 3 AS j", "id AS y").coalesce(1)
    got = joins.join_pair(left, right, [{"left": "k", "right": "j"}, {"left": "x", "right": "y", "op": "<"}], ops=True)
    assert tasks(got) >= 4 * joins.TASKS
    assert sorted(tuple(r) for r in got.collect()) == sorted((x % 3, x, y % 3, y) for x in range(400) for y in range(50) if x % 3 == y % 3 and x < y)


@pytest.mark.parametrize("name", ["join_theta", "pred_compare_columns"])
def test_queries_of_many_pairs_are_work_for_all_cores(spark, name):
    assert tasks(__spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")) >= 4 * joins.TASKS


def copies():
    """Forty candidates of one task with two kinds of cells and one candidate that is like both, a null value and a null task."""
    rows = [("q", 10 + c, v) for c in range(40) for v in ("xxy" if c % 2 else "yz")] + [("q", 5, "x"), ("q", 5, "y"), ("q", 5, None), (None, 7, "x"), (None, 8, "x")]
    return rows


def test_candidates_with_the_same_cells_are_compared_once(spark):
    df = spark.createDataFrame(copies(), "task string, candidate int, value string").selectExpr("*", "'p' AS place")
    members, pairs = records._profiles(df, "candidate", "place", "value", "task")
    assert pairs.count() == 9 + 1 and members.count() == 43
    every = records.soft_similarity(df, "candidate", "place", "value", "task")
    assert every.count() == 41 * 41 + 4 and tasks(every) >= 4 * joins.TASKS
    got = {(r.task, r.a, r.b): r.similarity for r in every.collect()}
    assert got["q", 10, 12] == 1.0 and got["q", 10, 11] == 1 / 4 and got["q", 5, 11] == 2 / 4 and got["q", 10, 5] == 1 / 4 and got[None, 8, 7] == 1.0


def test_medoids_from_profiles(spark):
    df = spark.createDataFrame(copies(), "task string, candidate int, value string").selectExpr("*", "'p' AS place")
    plain = records.majority_medoid(records.soft_similarity(df, "candidate", "place", "value", "task"), "task")
    got = {tuple(r) for r in records.medoids(df, "candidate", "place", "value", "task").collect()}
    assert got == {tuple(r) for r in plain.collect()} and (None, 7) in got


def test_edit_distances_without_python(spark, capsys):
    rng = random.Random(2)
    rows = [(i, [rng.choice("ab\U0001f600é") for _ in range(rng.randrange(6))], [rng.choice(["a", "b", "\U0001f600", "é", "", "long"][: 4 + 2 * (i % 2)]) for _ in range(rng.randrange(6))]) for i in range(40)]
    df = records.edit_distances(spark.createDataFrame(rows, "i int, a array<string>, b array<string>"), "a", "b")
    capsys.readouterr()
    df.explain()
    assert "InPandas" not in capsys.readouterr().out

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    assert {r.i: r.edit_distance for r in df.collect()} == {i: plain(a, b) for i, a, b in rows}


def test_percentiles_compared_by_counts(spark):
    """What counts and the values beside a cut say of a percentile equals Spark's percentile itself."""
    rng = random.Random(8)
    for n in (1, 2, 7, 40, 101):
        df = spark.createDataFrame([(float(rng.randrange(30)),) for _ in range(n)], "x double")
        low, high = df.agg(F.percentile("x", F.lit([0.47, 0.53])).alias("p")).first().p
        cuts = spark.createDataFrame([(m / 2,) for m in range(-2, 62)], "m double")
        le, lt = F.col("x") <= F.col("m"), F.col("x") < F.col("m")
        sides = {"last": F.max(F.when(le, F.col("x"))), "next": F.min(F.when(~le, F.col("x"))), "before": F.max(F.when(lt, F.col("x"))), "first": F.min(F.when(~lt, F.col("x")))}
        each = df.crossJoin(cuts).groupBy("m").agg(F.count("*").alias("n"), F.count_if(le).alias("upto"), F.count_if(lt).alias("below"), *(c.alias(k) for k, c in sides.items()))
        bound = discovery_queries._percentile_bound
        got = each.select("m", bound(0.47, "upto", "last", "next", operator.le).alias("a"), bound(0.53, "below", "before", "first", operator.ge).alias("b")).collect()
        assert len(got) == 64 and all(r.a == (low <= r.m) and r.b == (high >= r.m) for r in got)


def shuffled(spark):
    """Bytes that all queries so far have shuffled."""
    executors = spark._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def different(n):
    """Candidates of a task that nearly all differ in how often they have each of five values, with some that are alike, a rare value and nulls."""
    rng = random.Random(4)
    return [("q", c, v) for c in range(n) for v in (rng.choices("abcde", [5, 4, 3, 2, 1], k=12) if c % 50 else list("aab")) + ["rare"] * (c % 97 == 0)] + [("q", 3, None), ("q", 5, None), (None, 1, "a"), (None, 2, "a")]


def plain_similarities(rows):
    """(task, a, b): similarity, from cells whose place is null for candidate 7's value a."""
    have, out = {}, {}
    for t, c, v in rows:
        cells = have.setdefault((t, c), {})
        cells[v] = cells.get(v, 0) + 1
    for (t, a), x in have.items():
        for (u, b), y in have.items():
            met = sum(min(n, y.get(v, 0)) for v, n in x.items() if not (7 in (a, b) and v == "a")) if t == u else 0
            if met:
                out[t, a, b] = met / (sum(x.values()) + sum(y.values()) - met)
    return out


def placed(spark, rows):
    return spark.createDataFrame(rows, "task string, candidate int, value string").selectExpr("*", "if(candidate = 7 AND value = 'a', NULL, 'p') AS place")


def test_medoids_of_different_candidates_without_shuffled_pairs(spark, monkeypatch):
    monkeypatch.setattr(records, "BLOCK", 150)
    rows, totals = different(450), {}
    for (t, a, _), s in sorted(plain_similarities(rows).items(), key=str):
        totals[t, a] = totals.get((t, a), 0) + s
    best = {(t, min((-round(s, 9), a) for (u, a), s in totals.items() if u == t)[1]) for t in ("q", None)}
    before = shuffled(spark)
    assert {tuple(r) for r in records.medoids(placed(spark, rows), "candidate", "place", "value", "task").collect()} == best
    assert shuffled(spark) - before < 5e5


def test_different_candidates_are_compared_without_shuffled_pairs(spark, monkeypatch):
    monkeypatch.setattr(records, "BLOCK", 150)
    rows, before = different(450), shuffled(spark)
    every = records.soft_similarity(placed(spark, rows), "candidate", "place", "value", "task")
    assert tasks(every) >= 4 * joins.TASKS
    assert {(r.task, r.a, r.b): r.similarity for r in every.collect()} == plain_similarities(rows)
    assert shuffled(spark) - before < 5e5


def test_joins_in_blocks_give_every_pair(spark, monkeypatch):
    """Keys of one row and of many, null keys and values, rows that are alike, columns that have no hash, and comparisons alone."""
    monkeypatch.setattr(joins, "BLOCK", 7)
    monkeypatch.setattr(joins, "PAIRS", 50)
    rng = random.Random(5)
    a = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(9)])) for _ in range(90)] + [(1, 4)] * 20 + [(7, 1)]
    b = [(rng.choice([1, 1, 2, None, 4]), rng.choice([None, *range(9)])) for _ in range(60)] + [(1, 5)] * 30 + [(7, 2)]
    left = spark.createDataFrame(a, "k int, x int").selectExpr("k", "x", "map('x', x) AS m")
    right = spark.createDataFrame(b, "j bigint, y int").selectExpr("j", "y", "map('y', y) AS w")
    bag = lambda df: sorted((r.k, r.x, r.m["x"], r.j, r.y, r.w["y"]) for r in df.collect())
    plain = lambda on: sorted((k, x, x, j, y, y) for k, x in a for j, y in b if None not in (x, y) and on(k, x, j, y))
    less = {"left": "x", "right": "y", "op": "<"}
    assert bag(joins.join_pair(left.filter("k IS NOT NULL"), right.filter("j IS NOT NULL"), [less], ops=True)) == plain(lambda k, x, j, y: k and j and x < y)
    assert bag(joins.join_pair(left, right, [less, {"left": "k", "right": "j"}], ops=True)) == plain(lambda k, x, j, y: k is not None and k == j and x < y)
    assert joins.join_pair(left.filter("k = 3"), right, [less, {"left": "k", "right": "j"}], ops=True).count() == 0


def bytes_a_row(df, path):
    df.write.parquet(str(path))
    return sum(f.stat().st_size for f in path.glob("*.parquet")) / df.sparkSession.read.parquet(str(path)).count()


def test_many_pairs_are_written_small(spark, tmp_path):
    value = "CAST(pmod(xxhash64(id, '{}'), 1000000) AS double) AS {}"
    left, right = spark.range(2000).selectExpr("id AS a", "id % 2 AS k", value.format("l", "x")), spark.range(1200).selectExpr("id AS b", "id % 2 AS j", value.format("r", "y"))
    got = joins.join_pair(left, right, [{"left": "k", "right": "j"}, {"left": "x", "right": "y", "op": "<"}], ops=True)
    assert bytes_a_row(got, tmp_path / "out") < 1.2


def test_compared_columns_are_written_small(spark, tmp_path):
    assert bytes_a_row(__spark_entry__.queries()["pred_compare_columns"](spark, "/root/testdata/sf0.1"), tmp_path / "out") < 1
