"""Levels, JSON, users' functions, keys, outer joins, streams and two-sample bootstraps, at their edges."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.operators import joins, json_columns, levels, records, user_functions
from tablemill.sources import keys
from tablemill.streaming import windows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# -- levels
def test_levels_equal_plain_grouping_sets(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, None), ("a", "x", 3.0), (None, "x", 5.0), (None, None, None)], "g string, h string, v double")
    got = levels.grouping_sets(df, ["g", "h"], levels.cube(["g", "h"]), {"n": {"op": "count"}, "s": {"op": "sum", "column": "v"}, "m": {"op": "avg", "column": "v"}, "d": {"op": "distinct", "column": "v"}, "q": {"op": "quantile", "column": "v", "at": 0.5}})
    want = df.cube("g", "h").agg(F.grouping_id().cast("int").alias("grouping_id"), F.count("*").alias("n"), F.sum("v").alias("s"), F.avg("v").alias("m"), F.count_distinct("v").alias("d"))
    assert rows(got.drop("q")) == rows(want)
    assert got.filter("q IS NULL").count() == got.filter("m IS NULL").count() == 1
    with pytest.raises(OpError):
        levels.grouping_sets(df, ["g"], [["h"]], {"n": {"op": "count"}})
    assert levels.grouping_sets(df.limit(0), ["g"], [["g"], []], {"n": {"op": "count"}}).collect()[0].n == 0


def test_sketches_stay_within_their_errors_when_merged(spark):
    df = spark.range(60_000).selectExpr("id % 7 AS a", "id % 11 AS b", "id * 7919 % 50021 AS v")
    got = levels.grouping_sets(df, ["a", "b"], [["a", "b"], ["a"], []], {"d": {"op": "distinct", "column": "v"}, "q": {"op": "quantile", "column": "v", "at": 0.9}})
    exact = df.agg(F.count_distinct("v").alias("d")).first().d
    whole = got.filter("grouping_id = 3").first()
    assert abs(whole.d - exact) <= 0.06 * exact and abs(whole.q - 0.9 * 50021) <= 0.02 * 50021


# -- JSON
def test_json_edges(spark):
    df = spark.createDataFrame([(1, '{"k": 1, "a": [1, "x", null]}'), (2, '{"k": "one"}'), (3, '{"k": '), (4, None), (5, ""), (6, '{"a": []}'), (7, '{"k": null}')], "i int, t string")
    got = {r.i: (r.k, r.bad) for r in json_columns.extract(df, "t", {"k": ("$.k", "int")}, "bad").collect()}
    assert got == {1: (1, False), 2: (None, False), 3: (None, True), 4: (None, False), 5: (None, True), 6: (None, False), 7: (None, False)}
    assert rows(json_columns.elements(df, "t", "$.a", "int").select("i", "position", "element")) == [(1, 0, 1), (1, 1, None), (1, 2, None)]
    row = json_columns.schema(df, "t").first()
    assert (row.rows, row.malformed) == (6, 2) and "ARRAY" in row.schema
    assert json_columns.schema(df.limit(0), "t").first().schema == "VOID"


# -- users' functions
MEAN = user_functions.Aggregate(first=lambda: (0, 0.0), fold=lambda s, v: (s[0] + len(v), s[1] + float(v.sum())), merge=lambda a, b: (a[0] + b[0], a[1] + b[1]), last=lambda s: s[1] / s[0] if s[0] else None, returns="double")


@pytest.mark.parametrize("held", [1, 50_000])
def test_aggregates_of_hot_null_and_empty_groups(spark, held):
    data = [("hot", float(i)) for i in range(500)] + [(None, 1.0), (None, 3.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    got = {r.g: r.m for r in user_functions.aggregate(df, ["g"], "v", MEAN, "m", held).collect()}
    assert got == {"hot": 249.5, None: 2.0, "none": None}
    assert user_functions.aggregate(df, [], "v", MEAN, "m").first().m == pytest.approx((124750 + 4) / 502)
    assert user_functions.aggregate(df.limit(0), ["g"], "v", MEAN, "m").count() == 0


def test_scalars_by_name(spark):
    user_functions.register_scalar(spark, "twice_own", lambda x: x * 2, "long")
    assert spark.sql("SELECT twice_own(CAST(4 AS BIGINT)) AS x").first().x == 8
    user_functions.register_scalar(spark, "twice_own", lambda x: x * 3, "long")
    for bad in ("sum", "not a name"):
        with pytest.raises(OpError):
            user_functions.register_scalar(spark, bad, lambda x: x, "long")


# -- keys
def test_keys_and_references_with_planted_violations(spark):
    parent = spark.createDataFrame([(i, f"n{i}", i % 3) for i in range(200)], "p_key int, p_name string, p_kind int")
    child = spark.createDataFrame([(i, i % 190 if i % 10 else None, i % 190 if i != 77 else 1000) for i in range(500)], "c_id int, c_key int, d_key int")
    again = parent.unionByName(parent.limit(1)).toDF("r_key", "r_name", "r_kind")
    none = parent.withColumn("p_key", F.when(F.col("p_key") > 0, F.col("p_key"))).toDF("s_key", "s_name", "s_kind")
    tables = {"parent": parent, "child": child, "again": again, "none": none, "empty": parent.limit(0).toDF("e_key", "e_name", "e_kind")}
    found, refs = keys.discovered(tables)
    assert sorted((f["table"], f["column"]) for f in found) == [("child", "c_id"), ("none", "s_name"), ("parent", "p_key"), ("parent", "p_name")]
    pairs = {(r["table"], r["column"], r["parent"], r["parent_column"]) for r in refs}
    assert ("child", "c_key", "parent", "p_key") in pairs and not any(r[1] == "d_key" for r in pairs)  # one value outside
    assert ("none", "s_key", "parent", "p_key") in pairs  # nulls refer to nothing
    assert not any(r[0] == "empty" or r[2] in ("again", "empty") for r in pairs)
    named = {(r.table_name, r.column_name, r.parent) for r in keys.found_foreign_keys(tables).collect()}
    assert ("child", "c_key", "parent") in named and ("child", "c_id", "parent") not in named


def test_outer_joins_keep_both_sides(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string"), spark.createDataFrame([(2, "p"), (3, "q"), (None, "r")], "j int, w string")
    edge = [{"left": "k", "right": "j"}]
    assert rows(joins.join_pair(a, b, edge, "full")) == sorted([(2, "y", 2, "p"), (1, "x", None, None), (None, "z", None, None), (None, None, 3, "q"), (None, None, None, "r")], key=str)
    assert rows(joins.join_pair(a, b, edge, "right")) == sorted([(2, "y", 2, "p"), (None, None, 3, "q"), (None, None, None, "r")], key=str)


# -- streams
def stream_of(spark, tmp_path, files):
    """Each list of (t seconds, key, value) becomes one file."""
    for i, part in enumerate(files):
        df = spark.createDataFrame([(t, k, v) for t, k, v in part], "t long, k string, v string")
        df.select(F.timestamp_seconds("t").alias("t"), "k", "v", F.lit(1).cast("long").alias("n")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return windows.table_stream(spark, f"{tmp_path}/in", "t timestamp, k string, v string, n long")


def test_late_rows_within_the_watermark_count_and_later_ones_do_not(spark, tmp_path):
    day = 86_400
    files = [[(100, "a", "x"), (5000, "a", "x")], [(3000, "a", "y"), (9000, "a", "x")], [(9 * day, "a", "x")], [(200, "a", "too late"), (10 * day, "a", "z")], [(99 * day, "a", "end")], [(199 * day, "a", "end")]]
    stream = stream_of(spark, tmp_path, files)
    windows.drained(windows.state_changes(stream, "t", "k", "v", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out").select("k", F.unix_timestamp("since").alias("t"), "value", "before")
    assert rows(got) == sorted([("a", 100, "x", None), ("a", 3000, "y", "x"), ("a", 5000, "x", "y"), ("a", 10 * day, "z", "x"), ("a", 99 * day, "end", "z")], key=str)
    windows.drained(windows.sessions(stream, "t", ["k"], "1 hour", "1 hour", "n"), f"{tmp_path}/out2", f"{tmp_path}/state2")
    got = spark.read.parquet(f"{tmp_path}/out2").select(F.unix_timestamp("session_start").alias("a"), F.unix_timestamp("session_end").alias("b"), "n")
    assert (100, 8600, 3) in rows(got) and (9000, 12_600, 1) in rows(got)  # the late row joins two sessions to one; the next is too far
    assert sum(r.n for r in got.collect()) == 7  # the row that came too late isn't among them, the last one is still open


# -- bootstraps
def test_two_sample_bootstrap_over_the_drawn_rows(spark):
    rng = random.Random(4)
    data = [(i, rng.choice([1.0, 1.0, 1.0, 2.0, 5.0]) + (i % 3 == 0), i % 3 == 0) for i in range(240)] + [(900, None, True), (901, 2.0, None)]
    df = spark.createDataFrame(data, "i long, v double, p boolean").repartition(4)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.statistic: r for r in records.bootstrap_two(df, "v", "p", rounds=40, key="i").collect()}
        split = {r.statistic: r for r in records.bootstrap_two(df.repartition(7, "v"), "v", "p", rounds=40, key="i").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    own = [(v, p, i) for i, v, p in data if v is not None and p is not None]
    import hashlib

    h = np.array([int(hashlib.md5(f"{i}#0".encode()).hexdigest()[:16], 16) for _, _, i in own], np.uint64)
    times = np.concatenate((np.ones((len(own), 1), int), records.draws(h, 40)), axis=1)
    aucs, gaps, ds = [], [], []
    for r in range(41):
        pos, neg = ([v for (v, p, _), t in zip(own, times[:, r], strict=True) for _ in range(t) if p == side] for side in (True, False))
        aucs.append(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
        gaps.append(np.mean(pos) - np.mean(neg))
        pooled = ((len(pos) - 1) * np.var(pos, ddof=1) + (len(neg) - 1) * np.var(neg, ddof=1)) / (len(pos) + len(neg) - 2)
        ds.append(gaps[-1] / math.sqrt(pooled))
    for name, values in (("auc", aucs), ("mean_difference", gaps), ("cohens_d", ds)):
        low, high = pd.Series(values[1:]).quantile([0.025, 0.975])
        for found in (got[name], split[name]):
            assert (found.estimate, found.low, found.high) == pytest.approx((values[0], low, high))
    assert records.bootstrap_two(df.filter("p"), "v", "p", rounds=5, key="i").filter("estimate IS NOT NULL").count() == 0
