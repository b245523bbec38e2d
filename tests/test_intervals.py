"""Interval joins against DuckDB's inequality joins, with long, short, equal and unsound intervals and a hot group."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.operators import intervals


@pytest.fixture
def tables(spark):
    rng = random.Random(8)
    group = lambda: rng.choice(["hot", "hot", "hot", "a", None])
    points = [(i, group(), rng.choice([None, 0.0, 5.0, rng.uniform(-50, 150)])) for i in range(300)]
    spans = []
    for i in range(200):
        low = rng.choice([0.0, 5.0, rng.uniform(-60, 150)])
        spans.append((i, group(), low, low + rng.choice([0, 0.5, 3, 3, 3, 40, 1000, -1])))
    spans += [(900, "hot", None, 1.0), (901, "hot", 1.0, None), (902, "hot", -1e6, 1e6), spans[0]]
    return spark.createDataFrame(points, "id int, g string, x double"), spark.createDataFrame(spans, "sid int, g string, lo double, hi double")


def rows(df):
    return sorted((tuple(None if v is None or v != v else v for v in r) for r in df), key=str)


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize(("by", "width"), [(["g"], None), ([], None), (["g"], 0.3), ([], 700.0)])
def test_points_in_intervals(tables, closed, how, by, width):
    points, spans = tables
    got = intervals.point_join(points, spans, by, "x", "lo", "hi", {"sid": "sid", "lo": "low"}, closed, how, width)
    p, s = points.toPandas(), spans.toPandas()  # noqa: F841
    same = "p.g = s.g AND" if by else ""
    want = duckdb.sql(f"SELECT p.id, sid, s.lo FROM p {how} JOIN s ON {same} s.lo <= p.x AND p.x {'<=' if closed else '<'} s.hi AND s.lo {'<=' if closed else '<'} s.hi").fetchall()
    assert rows(got.select("id", "sid", "low").collect()) == rows(want)


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize(("by", "width"), [(["g"], None), ([], 2.0)])
def test_overlapping_intervals(tables, closed, by, width):
    _, spans = tables
    left = spans.filter("sid % 2 = 0").select("g", F.col("sid").alias("id"), (F.col("lo") * 2).alias("a"), (F.col("hi") * 2).alias("b"))
    got = intervals.overlap_join(left, spans, by, ("a", "b"), ("lo", "hi"), {"sid": "sid"}, closed, width)
    l, s = left.toPandas(), spans.toPandas()  # noqa: F841
    op, same = "<=" if closed else "<", "l.g = s.g AND" if by else ""
    want = duckdb.sql(f"SELECT id, sid FROM l JOIN s ON {same} l.a {op} s.hi AND s.lo {op} l.b AND l.a {op} l.b AND s.lo {op} s.hi").fetchall()
    assert rows(got.select("id", "sid").collect()) == rows(want)


def test_times_are_bounds_too(spark):
    days = spark.sql("SELECT id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS t, date_add(date'2024-01-01', CAST(id AS INT)) AS d FROM range(10)")
    spans = days.selectExpr("id AS sid", "t AS lo", "t + interval 2 hours AS hi", "d AS dlo", "date_add(d, 3) AS dhi")
    assert intervals.point_join(days, spans, [], "t", "lo", "hi", {"sid": "sid"}).count() == 10 + 9 + 8
    assert intervals.point_join(days, spans, [], "d", "dlo", "dhi", {"sid": "sid"}, closed=False).count() == 10 + 9 + 8
    with pytest.raises(OpError, match="type_mismatch"):
        intervals.point_join(days.withColumn("t", F.lit("x")), spans, [], "t", "lo", "hi", {})


def test_no_nested_loop_and_few_bins(tables):
    points, spans = tables
    got = intervals.point_join(points, spans, [], "x", "lo", "hi", {"sid": "sid"})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    posted = intervals._intervals(spans, [], "lo", "hi", True, "r_").withColumn("level", intervals._level("r_", 3.0))
    bins = posted.select(F.size(F.sequence(intervals._bin(F.col("r_lo"), F.col("level"), 3.0), intervals._bin(F.col("r_hi"), F.col("level"), 3.0))).alias("n"))
    assert bins.agg(F.max("n")).first()[0] <= 3


def test_empty_tables(tables):
    points, spans = tables
    assert intervals.point_join(points, spans.limit(0), ["g"], "x", "lo", "hi", {"sid": "sid"}, how="left").count() == points.count()
    assert intervals.point_join(points.limit(0), spans, ["g"], "x", "lo", "hi", {"sid": "sid"}).count() == 0
    assert intervals.overlap_join(spans.limit(0), spans, [], ("lo", "hi"), ("lo", "hi"), {"sid": "s"}).count() == 0
