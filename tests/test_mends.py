"""Cases that lost rows, gave wrong answers or would not have scaled."""

import random
import types

import pytest
from pyspark.sql import functions as F

from tablemill import shared
from tablemill.errors import OpError
from tablemill.operators import compare, records, rows
from tablemill.plans import sql as sql_
from tablemill.sources import files


def test_a_cluster_needs_a_shared_folder():
    cluster = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared.shared_dir(cluster, "x")


def test_discard_deletes_written_tables_alone(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/own")
    own, made = spark.read.parquet(f"{tmp_path}/own"), shared.written(spark.range(5), "made")
    folder = made.inputFiles()[0].rpartition("/")[0]
    shared.discard(own, made)
    assert own.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)


def test_mask_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, True), (None, False), ("a", True)], "k string, correct boolean")
    assert sorted((r.k or "", r.mask) for r in records.ambiguity_mask(df, ["k"]).collect()) == [("", 0), ("", 0), ("a", 1)]


def test_large_and_infinite_numbers_compare_by_value(spark):
    one = lambda v, kind: spark.createDataFrame([(v,)], f"x {kind}")
    same = lambda a, b: compare.multiset(a, b).first().equal
    assert same(one(10**16, "long"), one(1e16, "double")) and not same(one(10**16, "long"), one(1e17, "double"))
    assert same(one(float("inf"), "double"), one("Infinity", "string")) and same(one(1e300, "double"), one("1e300", "string"))


def test_journal_keeps_a_key_once(spark, tmp_path):
    log = files.Journal(spark, f"file://{tmp_path}/j", {"run": 1}, "id int, x string", "id")
    assert log.append(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, x string")) == 2
    assert log.append(spark.createDataFrame([(2, "d"), (3, "e")], "id int, x string")) == 1
    assert sorted(r.id for r in log.records().collect()) == [1, 2, 3]


def test_sql_sees_given_tables_alone_and_keeps_views(spark, tmp_path):
    mine = spark.createDataFrame([(1,)], "a int")
    mine.createOrReplaceTempView("orders")
    mine.createOrReplaceTempView("secret")
    spark.range(1).write.parquet(f"{tmp_path}/p")
    assert sql_.execute_sql(spark, "SELECT b FROM orders", {"orders": spark.createDataFrame([(2,)], "b int")}).first().b == 2
    assert spark.table("orders").columns == ["a"] and spark.table("secret").count() == 1
    for text in ("SELECT * FROM secret", f"SELECT * FROM parquet.`{tmp_path}/p`", "SELECT reflect('java.lang.System', 'exit', 0)"):
        with pytest.raises(Exception):  # noqa: B017
            sql_.execute_sql(spark, text, {"orders": mine}).collect()
    assert spark.sql(f"SELECT * FROM parquet.`{tmp_path}/p`").count() == 1
    assert sql_.inputs_of("SELECT 'customer' FROM Orders o", ["orders", "customer"]) == ["orders"]


def test_not_in_is_unknown_where_sql_says_so(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    for members in ([], [1], [1, None]):
        other = spark.createDataFrame([(m,) for m in members], "x int")
        tree = {"column": "x", "op": "not in", "in_table": other}
        want = [x for x in (1, 2, None) if not members or (x is not None and x not in members and None not in members)]
        assert sorted((r.x for r in rows.condition_filter(df, tree).collect()), key=str) == sorted(want, key=str)
        back = [x for x in (1, 2, None) if members and x is not None and x in members]
        assert [r.x for r in rows.condition_filter(df, {"not": tree}).collect()] == back


def test_not_in_needs_no_broadcast(spark):
    df = spark.range(10).toDF("x")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rows.condition_filter(df, {"column": "x", "op": "not in", "in_table": spark.range(5).toDF("x")})._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_returns_of_long_and_null_groups(spark):
    rng = random.Random(1)
    data = [(g, i, rng.choice([None, rng.random()])) for g, n in (("a", 700), (None, 300), ("b", 1)) for i in range(n)]
    got = {(r.g, r.i): r.return_to_go for r in records.return_to_go(spark.createDataFrame(data, "g string, i int, r double").repartition(5), "g", "i", "r", 0.9).collect()}
    acc = {}
    for g, i, r in sorted(data, key=lambda x: -x[1]):
        acc[g] = acc.get(g, 0.0) if r is None else r + 0.9 * acc.get(g, 0.0)
        assert got[g, i] == pytest.approx(acc[g])
    assert len(got) == len(data)


def test_order_statistics(spark):
    values = [5, 1, None, 3, 3, 9, 7]
    df, own = spark.createDataFrame([(v,) for v in values], "x int"), sorted(v for v in values if v is not None)
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        place = q * (len(own) - 1)
        low = int(place)
        assert records.percentile(df, "x", q).first().value == pytest.approx(own[low] + (own[min(low + 1, 5)] - own[low]) * (place - low))
        assert records.percentile(df, "x", q, "floor").first().value == own[min(5, int(q * 6))]
        assert records.percentile(df, "x", q, "nearest").first().value == next(v for i, v in enumerate(own, 1) if i >= q * 6 - 1e-9)
    none = spark.createDataFrame([], "x int")
    assert records.percentile(none, "x", 0.5).first().value is None and records.distribution(none, "x").first().n == 0


def test_quotas_match_their_definition(spark):
    data = [(f"c{i % 7 % 4}" if i % 9 else None, i) for i in range(200)]
    df, sizes = spark.createDataFrame(data, "c string, k int"), {}
    for c, _ in data:
        sizes[c] = sizes.get(c, 0) + 1
    for total in (0, 1, 37, 500):
        got = {}
        for r in records.stratified_quota(df, "c", "k", total).collect():
            got[r.c] = got.get(r.c, 0) + 1
        assert got == {c: n for c, n in records.quotas(sizes, min(total, 200)).items() if n}


def test_bootstrap_is_the_same_however_rows_lie(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("v"))
    a, b = (records.bootstrap_ci(d, "v", rounds=100, key="id").first() for d in (df.repartition(2), df.repartition(7, "v")))
    assert [round(x, 9) for x in a] == [round(x, 9) for x in b] and a.low < a.mean < a.high


def test_sign_chances_beyond_whole_numbers(monkeypatch):
    exact = [records.binomial_two_sided(1900 + i, 2050) for i in range(3)]
    monkeypatch.setattr(records, "EXACT", 0)
    assert [records.binomial_two_sided(1900 + i, 2050) for i in range(3)] == pytest.approx(exact, rel=1e-9)
    assert records.binomial_two_sided(500_000, 500_000) == 1.0 and 0.04 < records.binomial_two_sided(499_000, 501_000) < 0.05


def test_results_are_bounded_in_bytes_and_cells(spark):
    df = spark.createDataFrame([("x" * 100,), ("y",)], "s string")
    assert sql_.bounded(df) is df
    for kw, code in (({"most": 1}, "too_many_rows"), ({"most_bytes": 50}, "too_many_bytes"), ({"most_cell": 50}, "cell_too_large")):
        with pytest.raises(OpError, match=code):
            sql_.bounded(df, **kw)


def test_cells_compare_as_the_same_text_whatever_their_type(spark):
    def plain(text):
        try:
            x = float(text)
        except ValueError:
            return text.strip(" ")
        return "nan" if x != x else text.lower() if abs(x) == float("inf") else str(round(x)) if abs(x - round(x)) < 1e-6 else f"{x:.4f}"

    numbers = [0.0, -0.0, 2.5, -2.5, 0.00004, -0.00004, 1.23456, -7.0000001, 123456.789, 0.5, float("nan"), float("inf"), float("-inf")]
    shown = [r.c0 for r in compare.normalized(spark.createDataFrame([(x,) for x in numbers], "x double")).collect()]
    want = ["infinity" if x == float("inf") else "-infinity" if x == float("-inf") else plain(str(x)) for x in numbers]
    assert shown == want
    texts = [" 5", "\t5.25", "+3", "R", "NATION_7", "info", "", "x1", "1e3", ".5", "-", "2020-01-01"]
    assert [r.c0 for r in compare.normalized(spark.createDataFrame([(x,) for x in texts], "x string")).collect()] == [plain(x) for x in texts]
    row = compare.normalized(spark.sql("SELECT true AS a, 7S AS b, DATE'2020-01-01' AS c, CAST(NULL AS DATE) AS d, 2.50BD AS e, CAST(9007199254740993 AS BIGINT) AS f")).first()
    assert tuple(row) == ("1", "7", "2020-01-01", "", "2.5000", "9007199254740992")
