"""Queries for filters, projections, joins, groups, order, set operations and scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.functions.typed import Builder
from tablemill.operators import groups, joins, ordering, rows, scalars, sets
from tablemill.plans.base import Book, Tables

BOOK = Book()
add = BOOK.add


def flagship(spark: SparkSession, root: str) -> DataFrame:
    """Ten nations with the most revenue from orders of 1995 to 1997."""
    t = Tables(spark, root)
    chain = [
        {"name": "orders", "table": rows.condition_filter(t.orders, [{"column": "o_orderdate", "op": ">=", "value": "1995-01-01"}, {"column": "o_orderdate", "op": "<", "value": "1998-01-01"}]), "on": [{"left": "l.l_orderkey", "right": "o_orderkey"}], "role": "o"},
        {"name": "customer", "table": t.customer, "on": [{"left": "o.o_custkey", "right": "c_custkey"}], "role": "c"},
        {"name": "nation", "table": t.nation, "on": [{"left": "c.c_nationkey", "right": "n_nationkey"}], "role": "n"},
    ]
    lines = joins.join_tables(("lineitem", t.lineitem), chain, base_role="l")
    priced = rows.project(lines, ["n.n_name AS n_name", "l_extendedprice * (1 - l_discount) AS net"])
    total = groups.group_aggregate(priced, ["n_name"], [{"op": "sum", "column": "net", "as": "total"}])
    top = ordering.extreme_value_select(rows.project(total, ["n_name", "round(total, 2) AS revenue"]), ["revenue DESC", "n_name"], 10)
    return top


add("flagship", lambda t: flagship(t.spark, t.root), """
    SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1998-01-01'
    GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10""")

# -- filters -------------------------------------------------------------------------------
KEYS = ["l_orderkey", "l_linenumber", "l_quantity"]


def lines(conditions, columns=KEYS):
    return lambda t: rows.condition_filter(t.lineitem, conditions, columns)


def c(column: str, op: str, value=None, **more) -> dict:
    return {"column": column, "op": op, **({} if value is None else {"value": value}), **more}


def typed(op: str, column: str, value) -> dict:
    return {"op": op, "left": {"column": column}, "right": {"value": value}}


LABELLED = "documents d LEFT JOIN labels l USING (doc_id)"


def labelled(t: Tables) -> DataFrame:
    """Documents with their labels, null where there are none."""
    return t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id", "left")


L = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE "
add("filter", lines([c("l_quantity", ">", 25), c("l_returnflag", "=", "R")]), L + "l_quantity > 25 AND l_returnflag = 'R'")
add("filter_typed", lambda t: rows.filter_rows(t.lineitem, {"op": "and", "args": [typed(">=", "l_shipdate", "1996-01-01"), typed("<", "l_discount", 0.03)]}).select(*KEYS), L + "l_shipdate >= DATE '1996-01-01' AND l_discount < 0.03")
add("pred_compare", lines({"or": [c("l_quantity", "!=", 1, ), c("l_tax", "<=", 0.02)]}), L + "l_quantity <> 1 OR l_tax <= 0.02")
add("pred_compare_columns", lambda t: rows.condition_filter(joins.in_blocks(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal"), [("c_nationkey", "s_nationkey")], ["c_acctbal"]), c("c_acctbal", ">", column_value="s_acctbal"), ["c_custkey", "s_suppkey"]), "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > s_acctbal")
add("pred_in_list", lines(c("l_linenumber", "in", values=[1, 3, 5])), L + "l_linenumber IN (1, 3, 5)")
add("pred_not_in_list", lambda t: rows.condition_filter(labelled(t), c("quality", "not in", values=[0]), ["doc_id", "quality"]), f"SELECT doc_id, quality FROM {LABELLED} WHERE quality NOT IN (0)")
add("pred_in_table", lambda t: rows.condition_filter(t.orders, c("o_custkey", "in", in_table=t.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey")), ["o_orderkey"]), "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
add("pred_not_in_table", lambda t: rows.condition_filter(t.customer, c("c_custkey", "not in", in_table=t.orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey")), ["c_custkey"]), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
add("pred_not_in_table_null", lambda t: rows.condition_filter(t.nation, c("n_nationkey", "not in", in_table=labelled(t).select("quality")), ["n_nationkey"]), f"SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT quality FROM {LABELLED})")
add("pred_between", lines(c("l_quantity", "between", low=10, high=12)), L + "l_quantity BETWEEN 10 AND 12")
add("pred_like", lambda t: rows.condition_filter(t.part, c("p_name", "like", "*RE%"), ["p_partkey", "p_name"]), "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RE%'")
add("pred_contains_ci", lambda t: rows.condition_filter(t.part, c("p_name", "contains", "ED"), ["p_partkey"]), "SELECT p_partkey FROM part WHERE p_name ILIKE '%ED%'")
add("pred_not_contains_ci", lambda t: rows.condition_filter(t.part, c("p_name", "not_contains", "ED"), ["p_partkey"]), "SELECT p_partkey FROM part WHERE p_name NOT ILIKE '%ED%'")
add("pred_contains_cs", lambda t: rows.filter_rows(t.part, {"op": "contains", "value": {"column": "p_type"}, "pattern": {"value": "ECO"}}).select("p_partkey"), "SELECT p_partkey FROM part WHERE contains(p_type, 'ECO')")
add("pred_null", lambda t: rows.condition_filter(labelled(t), c("quality", "is_null"), ["doc_id"]), f"SELECT doc_id FROM {LABELLED} WHERE quality IS NULL")
add("pred_not_null", lambda t: rows.condition_filter(labelled(t), c("quality", "is not null"), ["doc_id", "quality"]), f"SELECT doc_id, quality FROM {LABELLED} WHERE quality IS NOT NULL")
add("pred_on_date", lambda t: rows.condition_filter(t.events, c("ts", "on_date", "2024-01-15"), ["event_id"]), "SELECT event_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'")
add("pred_bool", lines({"not": {"or": [c("l_returnflag", "=", "A"), {"and": [c("l_linestatus", "=", "O"), c("l_quantity", "<", 30)]}]}}), L + "NOT (l_returnflag = 'A' OR (l_linestatus = 'O' AND l_quantity < 30))")
add("pred_bool_unknown", lambda t: rows.condition_filter(labelled(t), {"not": c("quality", "=", 1)}, ["doc_id"]), f"SELECT doc_id FROM {LABELLED} WHERE NOT (quality = 1)")
add("pred_case_shorthand", lambda t: rows.condition_filter(t.part, {"contains": {"column": "p_brand", "value": "#1"}}, ["p_partkey"]), "SELECT p_partkey FROM part WHERE p_brand ILIKE '%#1%'")
add("pred_star_noop", lambda t: rows.condition_filter(t.nation, {"column": "*", "op": "="}), "SELECT * FROM nation")
add("value_ref", lambda t: rows.condition_filter(t.orders, c("o_totalprice", ">", value_ref=t.orders.agg(F.avg("o_totalprice"))), ["o_orderkey"]), "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")

# -- projections ---------------------------------------------------------------------------
add("project", lambda t: rows.project(t.orders, ["o_orderkey", "o_totalprice / 2 AS half", "o_custkey::text AS customer", {"op": "extract_year", "operands": [{"column": "o_orderdate"}], "as": "year"}]), "SELECT o_orderkey, o_totalprice / 2 AS half, CAST(o_custkey AS VARCHAR) AS customer, year(o_orderdate) AS year FROM orders")
add("project_distinct", lambda t: rows.project(t.lineitem, ["l_returnflag", "l_linestatus"], distinct=True), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
add("project_typed", lambda t: rows.project_typed(t.customer, [{"expression": {"column": "c_custkey"}}, {"expression": {"op": "multiply", "args": [{"column": "c_acctbal"}, {"value": 2}]}, "as": "twice"}]), "SELECT c_custkey, c_acctbal * 2 AS twice FROM customer")
add("shape_rows", lambda t: rows.shape_rows(t.nation, [{"column": "n_name", "as": "name"}, {"column": "n_regionkey", "as": "region"}]), "SELECT n_name AS name, n_regionkey AS region FROM nation")
add("derive_column", lambda t: rows.derive_column(t.supplier, "debt", "CASE WHEN s_acctbal < 0 THEN -s_acctbal ELSE 0 END"), "SELECT *, CASE WHEN s_acctbal < 0 THEN -s_acctbal ELSE 0 END AS debt FROM supplier")
add("distinct", lambda t: rows.distinct(t.lineitem.select("l_returnflag", "l_linenumber")), "SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem")
add("expr_sql", lambda t: rows.project(joins.join_tables(("nation", t.nation), [{"name": "region", "table": t.region, "on": [{"left": "nation.n_regionkey", "right": "r_regionkey"}]}]), ["upper(n_name) || '/' || lower(region.r_name) AS place"]), "SELECT upper(n_name) || '/' || lower(r_name) AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
add("expr_pg_cast", lambda t: rows.project(t.part, ["p_partkey", "p_size::real AS size"]), "SELECT p_partkey, CAST(p_size AS DOUBLE) AS size FROM part")

# -- joins ---------------------------------------------------------------------------------
DOCS, LABELS = (lambda t: t.documents.select("doc_id", "lang")), (lambda t: t.labels)
BY_DOC = [{"left": "doc_id", "right": "doc_id"}]
add("join_component", lambda t: rows.project(joins.join_tables(("orders", t.orders), [{"name": "customer", "table": t.customer, "on": [{"left": "orders.o_custkey", "right": "c_custkey"}]}, {"name": "nation", "table": t.nation, "on": [{"left": "customer.c_nationkey", "right": "n_nationkey"}], "type": "left"}]), ["orders.o_orderkey AS o_orderkey", "customer.c_name AS c_name", "nation.n_name AS n_name"]), "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
add("join_inner", lambda t: joins.join_pair(DOCS(t), LABELS(t), BY_DOC, "inner", "l"), "SELECT d.doc_id, lang, l.doc_id AS \"l.doc_id\", quality AS \"l.quality\", toxic AS \"l.toxic\" FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
add("join_left", lambda t: joins.join_pair(DOCS(t), LABELS(t), BY_DOC, "left", "l"), "SELECT d.doc_id, lang, l.doc_id AS \"l.doc_id\", quality AS \"l.quality\", toxic AS \"l.toxic\" FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
add("join_cross", lambda t: joins.join_pair(t.region, t.nation, [], "cross"), "SELECT * FROM region CROSS JOIN nation")
add("join_self", lambda t: rows.project(joins.join_tables(("nation", t.nation), [{"name": "nation", "table": t.nation, "on": [{"left": "a.n_regionkey", "right": "n_regionkey"}], "role": "b"}], base_role="a"), ["a.n_name AS a", "b.n_name AS b"]), "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
add("join_multi_edge", lambda t: joins.join_pair(t.customer.select("c_custkey", "c_nationkey"), t.orders.join(t.customer, t.orders.o_custkey == t.customer.c_custkey).select("o_orderkey", F.col("o_custkey").alias("k"), F.col("c_nationkey").alias("n")), [{"left": "c_custkey", "right": "k"}, {"left": "c_nationkey", "right": "n"}]), "SELECT c.c_custkey, c.c_nationkey, o_orderkey, o_custkey AS k, d.c_nationkey AS n FROM customer c JOIN (orders JOIN customer d ON o_custkey = d.c_custkey) ON c.c_custkey = o_custkey AND c.c_nationkey = d.c_nationkey")
add("join_theta", lambda t: joins.join_pair(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal"), [{"left": "c_nationkey", "right": "s_nationkey"}, {"left": "c_acctbal", "right": "s_acctbal", "op": "<"}], ops=True), "SELECT c_custkey, c_nationkey, c_acctbal, s_suppkey, s_nationkey, s_acctbal FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal")
add("join_semi", lambda t: joins.join_pair(t.customer.select("c_custkey"), t.orders.filter("o_totalprice > 300000"), [{"left": "c_custkey", "right": "o_custkey"}], "semi"), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
add("join_anti", lambda t: joins.join_pair(DOCS(t), LABELS(t), BY_DOC, "anti"), "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
add("join_legacy_nway", lambda t: joins.join_prefixed([t.nation, t.region], [[{"left": "c__n_regionkey", "right": "r__r_regionkey"}]], prefixes=["c", "r"]), "SELECT n_nationkey AS c__n_nationkey, n_name AS c__n_name, n_regionkey AS c__n_regionkey, r_regionkey AS r__r_regionkey, r_name AS r__r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
add("join_legacy_bare", lambda t: joins.join_prefixed([DOCS(t), LABELS(t)], [BY_DOC]), "SELECT d.doc_id, lang, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
add("join_null_stat", lambda t: joins.unmatched_count(joins.join_pair(DOCS(t), LABELS(t), BY_DOC, "left", "l"), "l.doc_id"), f"SELECT count(*) FILTER (WHERE quality IS NULL) AS unmatched FROM {LABELLED}")

# -- groups --------------------------------------------------------------------------------
def m(op: str, column: str, as_: str, **more) -> dict:
    return {"op": op, "column": column, "as": as_, **more}


def by_flag(*metrics, keys=("l_returnflag",)):
    return lambda t: groups.group_aggregate(t.lineitem, list(keys), list(metrics))


def flag_sql(select: str) -> str:
    return f"SELECT l_returnflag, {select} FROM lineitem GROUP BY l_returnflag"


add("agg_group", by_flag(m("sum", "l_quantity", "quantity"), m("count", "*", "n"), keys=("l_returnflag", "l_linestatus")), "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY ALL")
add("agg_global_empty", lambda t: groups.group_aggregate(t.lineitem.filter("l_quantity < 0"), [], [m("count", "*", "n"), m("sum", "l_quantity", "s"), m("avg", "l_quantity", "a")]), "SELECT count(*) AS n, sum(l_quantity) AS s, avg(l_quantity) AS a FROM lineitem WHERE l_quantity < 0")
add("agg_typed", lambda t: groups.aggregate_typed(t.orders, ["o_orderpriority"], [m("sum", "o_custkey", "keys"), m("max", "o_orderdate", "last"), {"op": "count", "as": "n"}]), "SELECT o_orderpriority, CAST(sum(o_custkey) AS BIGINT) AS keys, max(o_orderdate) AS last, count(*) AS n FROM orders GROUP BY ALL")
for op in ("sum", "avg", "min", "max"):
    add(f"agg_{op}", by_flag(m(op, "l_quantity", "value")), flag_sql(f"{op}(l_quantity) AS value"))
add("agg_count_star", by_flag(m("count", "*", "n")), flag_sql("count(*) AS n"))
add("agg_count_col", lambda t: groups.group_aggregate(labelled(t), ["lang"], [m("count", "quality", "n")]), f"SELECT lang, count(quality) AS n FROM {LABELLED} GROUP BY lang")
add("agg_count_distinct", by_flag(m("count_distinct", "l_suppkey", "n")), flag_sql("count(DISTINCT l_suppkey) AS n"))
add("agg_distinct_metric", lambda t: groups.aggregate_typed(t.lineitem, ["l_linestatus"], [m("sum", "l_linenumber", "s", distinct=True), m("avg", "l_quantity", "a", distinct=True)]), "SELECT l_linestatus, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, avg(DISTINCT l_quantity) AS a FROM lineitem GROUP BY ALL")
add("agg_total", lambda t: groups.group_aggregate(t.lineitem.filter("l_quantity < 0"), [], [m("total", "l_quantity", "total")]), "SELECT coalesce(sum(l_quantity), 0.0::DOUBLE) AS total FROM lineitem WHERE l_quantity < 0")
add("agg_count_distinct_rows", lambda t: groups.group_aggregate(t.lineitem.select("l_returnflag", "l_quantity"), [], [m("count_distinct", "*", "n")]), "SELECT count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_quantity FROM lineitem)")
add("agg_conditional", by_flag(m("count", "*", "large", where=c("l_quantity", ">", 40)), m("sum", "l_tax", "tax", where={"or": [c("l_linestatus", "=", "O"), c("l_discount", "=", 0.05)]})), flag_sql("count(*) FILTER (WHERE l_quantity > 40) AS large, sum(l_tax) FILTER (WHERE l_linestatus = 'O' OR l_discount = 0.05) AS tax"))
add("agg_filter", lambda t: groups.aggregate_typed(t.orders, ["o_orderstatus"], [m("count", "o_orderkey", "n", filter=typed(">", "o_totalprice", 100000.0)), m("count", "o_custkey", "d", distinct=True, filter=typed("=", "o_orderpriority", "1-URGENT"))]), "SELECT o_orderstatus, count(o_orderkey) FILTER (WHERE o_totalprice > 100000) AS n, count(DISTINCT o_custkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS d FROM orders GROUP BY ALL")
add("agg_wide", lambda t: groups.group_aggregate(t.orders, ["o_orderpriority"], [m("count", "*", "n")], output_layout="columns", category_values=["1-URGENT", "5-LOW", "9-NONE"], output_columns=["urgent", "low", "none"]), "SELECT count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low, count(*) FILTER (WHERE o_orderpriority = '9-NONE') AS none FROM orders")
add("agg_passthrough", lambda t: groups.group_aggregate(t.customer, ["c_nationkey"], [m("max", "c_acctbal", "most")], passthrough=["c_name"]), "SELECT c_nationkey, arg_max_null(c_name, c_acctbal) AS c_name, max(c_acctbal) AS most FROM customer GROUP BY c_nationkey")
add("agg_dedup", lambda t: groups.group_aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], []), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
add("agg_distinct_list", lambda t: groups.group_aggregate(t.part, [], [m("distinct", "p_brand", "brand"), m("distinct", "p_type", "type")]), "SELECT DISTINCT p_brand AS brand, p_type AS type FROM part")
add("agg_scalar", lambda t: t.spark.range(1).select(F.lit(groups.aggregate(t.orders, "o_totalprice", "max")).alias("value")), "SELECT max(o_totalprice) AS value FROM orders")
add("pivot", lambda t: groups.pivot(groups.group_aggregate(t.orders, ["o_orderstatus"], [m("count", "*", "n")]), "o_orderstatus", "n", ["F", "O", "P"]), "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS P FROM orders")
add("having", lambda t: groups.having(t.orders, ["o_custkey"], [m("count", "*", "n")], c("n", ">", 12)), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")

# -- order ---------------------------------------------------------------------------------
SOME = ["o_orderkey", "o_custkey", "o_totalprice"]
for fn in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist"):
    kind = "DOUBLE" if fn in ("percent_rank", "cume_dist") else "INTEGER"
    add(f"window_{fn}", lambda t, fn=fn: ordering.window(t.orders.select(*SOME), ["o_custkey"], ["o_totalprice DESC", "o_orderkey"], fn, "r"), f"SELECT o_orderkey, o_custkey, o_totalprice, CAST({fn}() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS {kind}) AS r FROM orders")
add("add_rank", lambda t: ordering.add_rank(t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity"), [{"column": "l_quantity", "direction": "desc"}], "dense_rank", "r", ["l_suppkey"]), "SELECT l_orderkey, l_suppkey, l_quantity, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS r FROM lineitem")
add("rank_select", lambda t: ordering.rank_select(t.orders, [{"column": "o_totalprice", "direction": "desc"}, {"column": "o_orderkey"}], 25, ["o_orderkey", "o_totalprice"]), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
add("rank_select_ties", lambda t: ordering.rank_select(t.lineitem, [{"column": "l_quantity", "direction": "desc"}, {"column": "l_discount"}], 5, ["l_orderkey", "l_quantity", "l_discount"], with_ties=True), "SELECT l_orderkey, l_quantity, l_discount FROM lineitem QUALIFY rank() OVER (ORDER BY l_quantity DESC, l_discount) <= 5")
add("sort", lambda t: ordering.sort(labelled(t), [{"column": "quality", "nulls": "first"}, {"column": "n_chars", "direction": "desc"}]), f"SELECT doc_id, lang, n_chars, quality, toxic FROM {LABELLED}")
add("limit", lambda t: ordering.limit(t.orders.select(*SOME), [{"column": "o_totalprice", "direction": "desc"}], 20, 10), "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
add("top_k", lambda t: ordering.extreme_value_select(t.customer, ["c_acctbal DESC", "c_custkey"], 15, ["c_custkey"]), "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15")

# -- set operations ------------------------------------------------------------------------
IDS, SQL_SET = (lambda t: (t.documents.select("doc_id"), t.labels.select("doc_id"))), {"union": "UNION", "union_all": "UNION ALL", "intersect": "INTERSECT", "except": "EXCEPT"}
for op, word in SQL_SET.items():
    add(f"set_{op}", lambda t, op=op: sets.set_op(*IDS(t), op), f"SELECT doc_id FROM documents {word} SELECT doc_id FROM labels")
add("set_nulls", lambda t: sets.set_op(labelled(t).select("quality"), labelled(t).select("toxic"), "intersect"), f"SELECT CAST(quality AS BIGINT) AS quality FROM {LABELLED} INTERSECT SELECT toxic FROM {LABELLED}")
add("set_typed", lambda t: sets.set_operation(t.part.select("p_size"), t.lineitem.select("l_quantity"), "union"), "SELECT CAST(p_size AS DOUBLE) AS p_size FROM part UNION SELECT l_quantity FROM lineitem")

# -- scalar expressions --------------------------------------------------------------------
def value(tree: dict, source=lambda t: t.lineitem, key=("l_orderkey", "l_linenumber")):
    def run(t: Tables) -> DataFrame:
        df = source(t)
        return df.select(*key, Builder(df).expression(tree).column.alias("v"))

    return run


def op_(op: str, *args) -> dict:
    return {"op": op, "args": [a if isinstance(a, dict) else {"column": a} for a in args]}


V = "SELECT l_orderkey, l_linenumber, {} AS v FROM lineitem"
add("math_arith", value(op_("subtract", op_("multiply", "l_quantity", "l_tax"), op_("add", "l_linenumber", {"value": 1}))), V.format("l_quantity * l_tax - (l_linenumber + 1)"))
add("math_modulo", value(op_("modulo", "l_partkey", {"value": 7})), V.format("l_partkey % 7"))
add("math_divide", value(op_("divide", "l_linenumber", {"value": 4})), V.format("l_linenumber / 4"))
add("math_abs", value(op_("abs", op_("subtract", "l_quantity", {"value": 25}))), V.format("abs(l_quantity - 25)"))
add("math_round", value(op_("round", op_("divide", "l_extendedprice", {"value": 7}), {"value": 3})), V.format("round(l_extendedprice / 7, 3)"))
PART, PK = (lambda t: t.part), ("p_partkey",)
for op in ("lower", "upper", "trim", "length"):
    add(f"str_{op}", value(op_(op, "p_type"), PART, PK), f"SELECT p_partkey, {op}(p_type) AS v FROM part")
add("str_concat", value(op_("concat", "p_brand", {"value": "/"}, "p_type"), PART, PK), "SELECT p_partkey, p_brand || '/' || p_type AS v FROM part")
add("null_coalesce", value(op_("coalesce", "quality", "toxic", {"value": -1}), labelled, ("doc_id",)), f"SELECT doc_id, CAST(coalesce(quality, toxic, -1) AS BIGINT) AS v FROM {LABELLED}")
add("case_when", value({"op": "case_when", "branches": [{"when": typed(">", "l_quantity", 40), "then": {"value": "many"}}, {"when": typed(">", "l_quantity", 20), "then": {"value": "some"}}], "else": {"value": "few"}}), V.format("CASE WHEN l_quantity > 40 THEN 'many' WHEN l_quantity > 20 THEN 'some' ELSE 'few' END"))
add("cast", value({"op": "cast", "args": [{"column": "l_quantity"}], "to": "INTEGER"}), V.format("CAST(l_quantity AS BIGINT)"))
ORDER, OK = (lambda t: t.orders), ("o_orderkey",)
for part in ("year", "month", "day"):
    add(f"date_extract_{part}", value(op_(f"extract_{part}", "o_orderdate"), ORDER, OK), f"SELECT o_orderkey, {part}(o_orderdate) AS v FROM orders")
add("date_diff_days", value(op_("date_diff_days", "o_orderdate", "l_shipdate"), lambda t: t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))), "SELECT l_orderkey, l_linenumber, date_diff('microsecond', o_orderdate, l_shipdate) / 86400000000.0::DOUBLE AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
add("scalar_compute", lambda t: scalars.scalar_compute(t.spark, "percent", [t.orders.filter("o_orderstatus = 'F'").agg(F.count("*")), t.orders.agg(F.count("*"))], "share"), "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') * 100 / count(*) AS share FROM orders")
add("scalar_compute_values", lambda t: scalars.scalar_compute(t.spark, "date_diff_days", ["2024-01-01", "2024-01-02T12:00:00"], "days"), "SELECT 1.5::DOUBLE AS days")
add("scalar_compute_typed", lambda t: scalars.scalar_compute_typed(t.orders.agg(F.sum("o_totalprice").alias("a"), F.count("*").alias("n")), [{"op": "divide", "left": {"column": "a"}, "right": {"column": "n"}, "as": "mean", "round_digits": 2}]), "SELECT round(sum(o_totalprice) / count(*), 2) AS mean FROM orders")
