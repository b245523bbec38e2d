"""Ordered work by ranges against Spark's plain windows, with groups that lie in many ranges."""

import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.operators import ranges


@pytest.fixture
def rows(spark):
    """Two thirds of the rows are one user's; times repeat, and some keys and values are null."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    rng = random.Random(4)
    data = [(i, rng.choice(["hot", "hot", "hot", "hot", "a", "b", None]), rng.choice([0, 1, 1, 1, 1, 2, 5, 8]) + 10 * (i // 150), rng.choice([None, *range(20)])) for i in range(600)]
    yield spark.createDataFrame(data, "id int, user string, t int, v int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
    spark.conf.set("spark.sql.shuffle.partitions", before[1])


def same(got, want):
    key = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    assert got.columns == want.columns and key(got) == key(want)


def unique():
    return [F.col("t").asc(), F.col("id").asc()]


def over(by=("user",), order=None):
    return Window.partitionBy(*by).orderBy(*(order or unique()))


def test_ranges_are_many(rows):
    dealt = ranges.Ranges(rows, ["user"], unique())
    assert dealt.rows.filter("user = 'hot'").select("__range").distinct().count() > 3


@pytest.mark.parametrize("by", [["user"], [], ["user", "v"]])
def test_places_and_tiles(rows, by):
    same(ranges.places(rows, by, unique()), rows.withColumn("place", F.row_number().over(over(by)).cast("long")))
    for n in (1, 7, 1000):
        same(ranges.ntile(rows, by, unique(), n), rows.withColumn("tile", F.ntile(n).over(over(by))))
    with pytest.raises(OpError):
        ranges.ntile(rows, by, unique(), 0)


@pytest.mark.parametrize("fn", ["rank", "dense_rank", "percent_rank", "cume_dist"])
@pytest.mark.parametrize("by", [["user"], []])
def test_ranks_of_ties_over_ranges(rows, fn, by):
    order = [F.col("t").desc()]
    want = rows.withColumn("rank", getattr(F, fn)().over(over(by, order)))
    same(ranges.rank(rows, by, order, fn, [F.col("t")]), want)
    flat = rows.withColumn("t", F.when(F.col("t") < 3, 1).otherwise(F.lit(None)))
    same(ranges.rank(flat, by, [F.col("t").asc()], fn, [F.coalesce("t", F.lit(-1))]), flat.withColumn("rank", getattr(F, fn)().over(over(by, [F.col("t").asc()]))))


def test_running_figures(rows):
    figures = {"s": ("sum", "v"), "n": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "m": ("avg", "v")}
    want = rows.withColumns({n: getattr(F, f)(c).over(over().rowsBetween(Window.unboundedPreceding, 0)) for n, (f, c) in figures.items()})
    same(ranges.running(rows, ["user"], unique(), figures), want)


@pytest.mark.parametrize("k", [0, 1, 3, 200, -1, -5])
def test_lags_and_leads(rows, k):
    way = F.lag("v", k) if k >= 0 else F.lead("v", -k)
    same(ranges.shifted(rows, ["user"], unique(), "v", k), rows.withColumn("before", way.over(over())))


def test_a_default_stands_for_missing_rows_alone(rows):
    same(ranges.shifted(rows, ["user"], unique(), "v", 2, default=-7), rows.withColumn("before", F.lag("v", 2, -7).over(over())))


@pytest.mark.parametrize(("preceding", "following"), [(0, 0), (2, 0), (0, 3), (5, 5), (100, 0)])
def test_frames(rows, preceding, following):
    figures = {"s": ("sum", "v"), "n": ("count", "id"), "m": ("avg", "v"), "hi": ("max", "t")}
    frame = over().rowsBetween(-preceding, following)
    want = rows.withColumns({n: getattr(F, f)(c).over(frame) for n, (f, c) in figures.items()})
    same(ranges.framed(rows, ["user"], unique(), figures, preceding, following), want)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
def test_asof_join_equals_its_definition(rows, strict, forward):
    left, right = rows.filter("id % 3 = 0"), rows.filter("id % 3 != 0").select("user", "t", F.col("id").alias("rid"), F.col("v").alias("rv"))
    got = ranges.asof_join(left, right, ["user"], "t", "t", {"rid": "rid", "rv": "rv"}, strict, "rid", forward)
    op = {(False, False): ">=", (True, False): ">", (False, True): "<=", (True, True): "<"}[strict, forward]
    way = "" if forward else "DESC"
    l, r = left.toPandas(), right.toPandas()  # noqa: F841
    want = duckdb.sql(f"SELECT id, rid, rv FROM (SELECT l.id, r.rid, r.rv, row_number() OVER (PARTITION BY l.id ORDER BY r.t {way} NULLS LAST, r.rid {way} NULLS LAST) AS k FROM l LEFT JOIN r ON l.user = r.user AND l.t {op} r.t) WHERE k = 1").fetchall()
    key = lambda x: [None if v is None or v != v else int(v) for v in x]
    assert sorted(map(key, got.select("id", "rid", "rv").collect())) == sorted(map(key, want))


def test_asof_join_edges(spark, rows):
    left, right = rows.filter("id < 50"), rows.filter("id >= 50").select("user", "t", F.col("id").alias("rid"))
    near = ranges.asof_join(left, right, ["user"], "t", "t", {"t": "rt", "rid": "rid"}, tolerance=F.col("t") - F.col("rt") <= 1)
    assert near.filter("rid IS NOT NULL AND t - rt > 1").count() == 0 and near.count() == left.count()
    assert ranges.asof_join(left, right.limit(0), ["user"], "t", "t", {"rid": "rid"}).filter("rid IS NULL").count() == left.count()
    assert ranges.asof_join(left.limit(0), right, ["user"], "t", "t", {"rid": "rid"}).count() == 0
    assert ranges.asof_join(left.withColumn("t", F.lit(None).cast("int")), right, ["user"], "t", "t", {"rid": "rid"}).filter("rid IS NULL").count() == left.count()


def test_empty_tables(rows):
    none = rows.limit(0)
    for df in (ranges.places(none, ["user"], unique()), ranges.running(none, ["user"], unique(), {"s": ("sum", "v")}), ranges.shifted(none, ["user"], unique(), "v"), ranges.framed(none, ["user"], unique(), {"s": ("sum", "v")}, 2), ranges.rank(none, [], unique(), "rank", [F.col("t")])):
        assert df.count() == 0


def test_no_window_holds_a_whole_group(spark, rows):
    """All windows over rows are by range; those by group alone go over carries, two rows a range."""
    hot = rows.filter("user = 'hot'")
    dealt = ranges.Ranges(hot, ["user"], unique())
    carries = dealt.carries([F.count("*").alias("c")], {"c": F.col("c")})
    assert carries.count() <= 2 * dealt.rows.select("__range").distinct().count()
    biggest = dealt.rows.groupBy("user", "__range").count().agg(F.max("count")).first()[0]
    assert biggest < hot.count() / 4


def test_ranges_grow_in_number_and_not_in_size(rows, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", 20)
    dealt = ranges.Ranges(rows, ["user"], unique())
    sizes = [r["count"] for r in dealt.rows.groupBy(F.spark_partition_id().alias("task"), "__range").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 60 and sum(sizes) == 600 and dealt.rows.rdd.getNumPartitions() == 30
    ties = over(order=[F.col("t").asc()])
    for fn in ("rank", "dense_rank", "percent_rank", "cume_dist"):
        same(ranges.rank(rows, ["user"], [F.col("t").asc()], fn, [F.col("t")]), rows.withColumn("rank", getattr(F, fn)().over(ties).cast("double" if fn in ("percent_rank", "cume_dist") else "long")))
    same(ranges.shifted(rows, ["user"], unique(), "v", 2), rows.withColumn("before", F.lag("v", 2).over(over())))
    same(ranges.running(rows, ["user"], unique(), {"s": ("sum", "v")}), rows.withColumn("s", F.sum("v").over(over())))
