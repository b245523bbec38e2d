import datetime as dt

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.functions import types as K
from tablemill.functions.typed import Builder
from tablemill.operators import compare, groups, joins, ordering, perception, records, rows, scalars, search, sets

D = dt.date
#: What a check that Spark makes while it runs raises; errors of subqueries come without Spark's own class.
FAILURE = (PySparkException, Py4JError)


@pytest.fixture(scope="module")
def people(spark):
    data = [(1, "a", 10.0, D(2020, 1, 1), " x "), (2, "a", None, D(2021, 5, 2), "Y"), (3, "b", 5.5, None, None), (3, "b", 5.5, None, None), (4, None, 7.0, D(2020, 1, 1), "z%")]
    return spark.createDataFrame(data, "id long, dept string, amount double, joined date, note string")


@pytest.fixture(scope="module")
def depts(spark):
    return spark.createDataFrame([("a", "A1"), ("a", "A2"), ("c", "C")], "dept string, label string")


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_conditions_have_three_values(people):
    leaf = {"column": "amount", "op": ">", "value": 6}
    assert ids(rows.condition_filter(people, leaf)) == [1, 4]
    assert ids(rows.condition_filter(people, {"not": leaf})) == [3, 3]  # null is neither
    assert ids(rows.condition_filter(people, {"or": [leaf, {"column": "dept", "op": "IS_NULL"}]})) == [1, 4]
    assert ids(rows.condition_filter(people, {"column": "dept", "op": "not in", "values": ["a", None]})) == []
    assert ids(rows.condition_filter(people, {"column": "note", "op": "contains", "value": "y"})) == [2]
    assert ids(rows.condition_filter(people, {"column": "joined", "op": "on date", "value": "2020-01-01"})) == [1, 4]
    assert ids(rows.condition_filter(people, [])) == [1, 2, 3, 3, 4]


def test_membership_in_tables_minds_nulls(people, depts):
    own = {"column": "dept", "op": "not in", "in_table": depts.select("dept")}
    assert ids(rows.condition_filter(people, own)) == [3, 3]
    assert ids(rows.condition_filter(people, {**own, "in_table": people.select("dept")})) == []


def test_values_from_tables_must_be_one_and_not_null(people):
    use = lambda df: rows.condition_filter(people, {"column": "amount", "op": ">=", "value_ref": df}).collect()
    assert len(use(people.agg(F.avg("amount")))) == 2
    for bad in (people.select("amount"), people.filter("id = 2").select("amount"), people.limit(0).select("amount")):
        with pytest.raises(FAILURE):
            use(bad)
    with pytest.raises(OpError, match="not_scalar"):
        use(people)


def test_names_resolve_or_are_rejected(people):
    assert rows.condition_filter(people, {"column": "x.AMOUNT", "op": ">", "value": 9}, ["ID"]).columns == ["id"]
    with pytest.raises(OpError, match="unknown_column") as e:
        rows.condition_filter(people, {"column": "nope", "op": "=", "value": 1})
    assert e.value.details["available_columns"] == people.columns
    with pytest.raises(OpError, match="duplicate_column"):
        rows.project(people, ["id", "dept AS ID"])


def test_typed_predicates_check_types(people):
    p = lambda op, v, col="amount": rows.filter_rows(people, {"op": op, "left": {"column": col}, "right": {"value": v}})
    assert ids(p(">", 6)) == [1, 4]
    assert ids(p(">=", "2021-01-01", "joined")) == [2]
    for bad in ("x", True, "2021"):
        with pytest.raises(OpError):
            p(">", bad)
    with pytest.raises(OpError, match="invalid_literal"):
        p("=", "2021-01-01T10:00:00", "joined")
    with pytest.raises(OpError, match="expression_depth_exceeded"):
        node = {"op": "is_null", "value": {"column": "id"}}
        for _ in range(6):
            node = {"op": "not", "arg": node}
        rows.filter_rows(people, node)
    both = rows.filter_rows(people, {"op": "not_contains", "value": {"column": "note"}, "pattern": {"value": "%"}})
    assert ids(both) == [1, 2]


def test_typed_expressions(people):
    v = lambda tree: [r[0] for r in people.orderBy("id", "dept").select(Builder(people).expression(tree).column).collect()]
    assert v({"op": "divide", "args": [{"column": "id"}, {"value": 2}]}) == [0.5, 1.0, 1.5, 1.5, 2.0]
    assert v({"op": "coalesce", "args": [{"column": "amount"}, {"value": 0}]})[1] == 0.0
    assert v({"op": "date_diff_days", "args": [{"column": "joined"}, {"column": "joined"}]})[0] == 0.0
    assert v({"op": "cast", "args": [{"column": "amount"}], "to": "TEXT"})[0] == "10.0"
    for tree in ({"op": "divide", "args": [{"column": "id"}, {"value": 0}]}, {"op": "cast", "args": [{"column": "amount"}], "to": "INTEGER"}):
        with pytest.raises(FAILURE):
            v(tree)
    for tree in ({"op": "modulo", "args": [{"column": "amount"}, {"value": 2}]}, {"op": "lower", "args": [{"column": "id"}]}, {"op": "abs", "args": []}, {"value": float("inf")}, {"op": "sin", "args": []}):
        with pytest.raises(OpError):
            v(tree)


def test_types():
    assert K.merged("INTEGER", "REAL") == "REAL" and K.merged("NULL", "TEXT") == "TEXT"
    assert [K.of_declared(x) for x in ("BIGINT", "varchar(9)", "DATE", "timestamp", "money", "", "boolean")] == ["INTEGER", "TEXT", "DATE", "DATETIME", "REAL", "BLOB", "BOOLEAN"]
    with pytest.raises(OpError):
        K.merged("TEXT", "INTEGER")


def test_projection_of_joined_names(people, depts):
    both = joins.join_tables(("people", people), [{"name": "depts", "table": depts, "on": [{"left": "people.dept", "right": "dept"}]}])
    assert both.columns[:2] == ["people.id", "people.dept"]
    out = rows.project(both, ["people.id AS i", "upper(label) || '-label' AS l", "people.id::text AS t"])
    assert got(out) == [(1, "A1-label", "1"), (1, "A2-label", "1"), (2, "A1-label", "2"), (2, "A2-label", "2")]
    nested = joins.join_tables(("prior", both), [{"name": "depts", "table": depts, "role": "again", "on": [{"left": "people.dept", "right": "dept"}]}])
    assert "again.label" in nested.columns and "people.id" in nested.columns
    with pytest.raises(OpError, match="duplicate_column"):
        joins.join_tables(("people", both), [{"name": "depts", "table": depts, "on": [{"left": "people.dept", "right": "dept"}]}])


def test_joins_and_null_keys(people, depts):
    on = [{"left": "dept", "right": "dept"}]
    assert len(joins.join_pair(people, depts, on, "left", "d").collect()) == 7
    assert ids(joins.join_pair(people, depts, on, "semi")) == [1, 2]
    assert ids(joins.join_pair(people, depts, on, "anti")) == [3, 3, 4]
    assert joins.unmatched_count(joins.join_pair(people, depts, on, "left", "d"), "d.dept").first()[0] == 3
    assert len(joins.join_pair(people.select("id"), people.select(F.col("id").alias("other")), [{"left": "id", "right": "other", "op": "<"}], ops=True).collect()) == 9
    for bad in ({"how": "cross", "edges": on}, {"how": "inner", "edges": []}, {"how": "outer", "edges": on}, {"how": "inner", "edges": [{"left": "dept"}]}):
        with pytest.raises(OpError):
            joins.join_pair(people, depts, **bad)


def test_groups(people):
    m = lambda op, c="*", **k: {"op": op, "column": c, "as": "v", **k}
    assert got(groups.group_aggregate(people, ["dept"], [m("count", "amount")])) == [("a", 1), ("b", 2), (None, 1)]
    assert got(groups.group_aggregate(people, [], [m("count_distinct")])) == [(4,)]
    assert got(groups.group_aggregate(people, [], [m("total", "amount", where={"column": "id", "op": ">", "value": 99})])) == [(0.0,)]
    assert got(groups.group_aggregate(people, ["dept"], [m("max", "amount")], passthrough=["id"])) == sorted([("a", 1, 10.0), ("b", 3, 5.5), (None, 4, 7.0)], key=str)
    wide = groups.group_aggregate(people, ["dept"], [m("count")], output_layout="columns", category_values=["b", "q"])
    assert (wide.columns, got(wide)) == (["b", "q"], [(2, 0)])
    for bad in (dict(group_by=[], aggregations=[]), dict(group_by=["dept"], aggregations=[m("sum")]), dict(group_by=["dept"], aggregations=[m("count"), m("count", "id")])):
        with pytest.raises(OpError):
            groups.group_aggregate(people, **bad)
    with pytest.raises(OpError, match="type_mismatch"):
        groups.aggregate_typed(people, [], [m("sum", "note")])


def test_pivot_needs_unique_keys(people):
    one = people.filter("dept = 'a' OR dept IS NULL").select("dept", "id").filter("id != 2")
    assert got(groups.pivot(one, "dept", "id", ["a", "x"], ["p", "q"])) == [(1, None)]
    with pytest.raises(FAILURE):
        groups.pivot(people, "dept", "id", ["a"]).collect()


def test_order(people):
    keys = [{"column": "amount", "direction": "desc"}]
    assert [r.id for r in ordering.sort(people, keys).collect()] == [1, 4, 3, 3, 2]
    assert [r.id for r in ordering.sort(people, [{"column": "amount", "nulls": "first"}]).collect()] == [2, 3, 3, 4, 1]
    assert [r.id for r in ordering.limit(people, keys, 2, 1).collect()] == [4, 3]
    assert len(ordering.rank_select(people, keys, 3, ["id"], with_ties=True).collect()) == 4
    assert len(ordering.rank_select(people, keys, 3, ["id"]).collect()) == 3
    assert [r.id for r in ordering.extreme_value_select(people, ["joined DESC", "id"], 1, ["id"]).collect()] == [2]
    ranks = ordering.add_rank(people, keys, "rank", "r", ["dept"])
    assert got(ranks.select("id", "r")) == [(1, 1), (2, 2), (3, 1), (3, 1), (4, 1)]
    with pytest.raises(OpError, match="unordered_input"):
        ordering.limit(people, [], 2)


def test_sets(people, depts):
    a, b = people.select("dept"), depts.select("dept")
    assert got(sets.set_op(a, b, "union")) == [("a",), ("b",), ("c",), (None,)]
    assert got(sets.set_op(a, people.select("note", "dept"), "except")) == []
    assert sets.set_operation(people.select("id"), people.select("amount"), "union_all").dtypes == [("id", "double")]
    for other in (people.select("note"), people.select("id", "note")):
        with pytest.raises(OpError):
            sets.set_operation(people.select("id"), other, "union")


def test_scalars(spark, people):
    assert scalars.compute("percent", [1, 3]) == 1 * 100 / 3
    assert scalars.compute("date_diff_days", ["2024-01-01", "2024-01-02T06:00:00Z".replace("Z", "")]) == 1.25
    for op, args in (("divide", [1, 0]), ("add", [1]), ("add", [1, None]), ("add", [1, True]), ("divide", [1, 2, 3]), ("power", [1, 2]), ("add", [1, float("nan")])):
        with pytest.raises(OpError):
            scalars.compute(op, args)
    n = people.agg(F.count("*").alias("n"))
    assert scalars.scalar_compute(spark, "divide", [n, 2], "half").first().half == 2.5
    assert scalars.scalar_compute_typed(n, [{"op": "multiply", "left": {"column": "n"}, "right": {"value": 3}, "as": "m", "multiplier": 2}]).first().m == 30
    with pytest.raises(FAILURE):
        scalars.scalar_compute_typed(people, [{"op": "add", "left": {"column": "id"}, "right": {"value": 1}, "as": "m"}]).collect()


def test_perception(people):
    assert got(perception.inspect_column(people, "dept")) == [("a", 2, True), ("b", 2, True)]
    assert got(perception.inspect_column(people, "dept", top_k=1, full_below=1)) == [("a", 2, False)]
    assert tuple(perception.column_summary(people, "amount").first()) == (3, 1, 5)
    page, more = perception.read_rows(people, ["id"], 2, order_by=[{"column": "id"}], offset=1)
    assert ([r.id for r in page.collect()], more) == ([2, 3], True)
    assert [r.value for r in perception.sample_values(people, "note", 5).collect()] == [" x ", "Y", "z%"]
    with pytest.raises(OpError):
        perception.read_subtable(people, limit=21)


def test_search(spark):
    words = ["Springfield High", "springfield high!", "Springfield", "High Springfield", "Springfeild Hihg", "New Springfield High School", "Other", None, ""]
    df = spark.createDataFrame([(w,) for w in words], "value string")
    found = search.search_values(df, "Springfield High").collect()
    expected = ["Springfield High", "springfield high!", "High Springfield", "New Springfield High School", "Springfeild Hihg", "Springfield"]
    assert [(r.value, r.tier) for r in found] == list(zip(expected, [0, 1, 3, 3, 5, 5], strict=True))
    bounded = search.search_values_bounded(df, "Springfield High").collect()
    assert [r.value for r in bounded][:2] == ["Springfield High", "springfield high!"] and not any(r.tier == 5 or r.capped for r in bounded)
    assert search.search_values_bounded(df, "Springfeild", candidates=1).first().capped
    assert search.search_values(df, "?!").collect() == []


def test_comparisons(people):
    assert compare.same_set(people, people.distinct()).first()[0]
    assert not compare.multiset(people, people.distinct()).first()[0]
    assert not compare.same_set(people.select("id"), people).first()[0]
    assert compare.similarity(people, people).first()[0] == pytest.approx(1.0)
    assert compare.fingerprint_set(people).first() == compare.fingerprint_set(people.distinct().repartition(3)).first()
    assert compare.multiset(people.select(F.lit(1.0).alias("x")), people.select(F.lit(1).alias("x"))).first()[0]
    assert compare.multiset(people.select(F.lit(" 2.50001 ").alias("x")), people.select(F.lit(2.5).alias("x"))).first()[0]
    assert compare.multiset(people.select(F.lit(True).alias("x")), people.select(F.lit("1").alias("x"))).first()[0]
    assert compare.similarity(people.select("id"), people).first()[0] == pytest.approx(0.1)


def test_statistics(spark):
    assert records.binomial_two_sided(0, 0) == 1.0 and records.binomial_two_sided(0, 5) == 2 / 32 and records.binomial_two_sided(3, 3) == 1.0
    assert records.quotas({"a": 5, "b": 3, "c": 2}, 4) == {"a": 2, "b": 1, "c": 1}
    one = spark.createDataFrame([(1.0, 1), (1.0, 0)], "s double, y int")
    assert records.roc_auc(one, "s", "y").first()[0] == 0.5
    assert records.roc_auc(one.filter("y = 1"), "s", "y").first()[0] is None
    assert records.pearson(one, "s", "y").first()[0] is None
    ci = records.bootstrap_ci(one.withColumn("s", F.lit(4.0)), "s", rounds=50).first()
    assert (ci["mean"], ci.low, ci.high) == (4.0, 4.0, 4.0)
    seeded = [records.bootstrap_ci(spark.range(50), "id", rounds=80, seed=3, cluster="id").first() for _ in range(2)]
    assert seeded[0] == seeded[1] and seeded[0].low < 24.5 < seeded[0].high
    pairs = spark.createDataFrame([(["a", "b", "c"], ["a", "c"]), ([], ["x"])], "l array<string>, r array<string>")
    assert got(records.edit_distances(pairs, "l", "r").select("edit_distance", "common_prefix")) == [(1, 0), (1, 1)]
    with pytest.raises(FAILURE):
        records.merge_disjoint([one.select("s"), one.select("s")], "s").collect()
