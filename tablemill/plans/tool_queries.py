"""Queries for scans, perception, search, SQL and programs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.functions.typed import columns_of
from tablemill.operators import compare, joins, perception, search, suite
from tablemill.plans import sql as sql_
from tablemill.plans.base import Book, Tables
from tablemill.plans.workspace import Workspace, equivalent
from tablemill.shared import shared_dir
from tablemill.sources import catalog, files

BOOK = Book()
add = BOOK.add
SMALL = ("region", "nation", "customer", "supplier", "part", "orders")

add("scan_table", lambda t: files.scan_table(t.spark, f"{t.root}/nation.parquet"), "SELECT * FROM nation")
add("scan_catalog", lambda t: catalog.columns(t.spark, {n: s for n, s in catalog.load(t.spark, t.root, ("region", "nation", "part")).items()}), """
    SELECT * FROM (VALUES ('region', 0, 'r_regionkey', 'INTEGER', false), ('region', 1, 'r_name', 'TEXT', false),
      ('nation', 0, 'n_nationkey', 'INTEGER', false), ('nation', 1, 'n_name', 'TEXT', false), ('nation', 2, 'n_regionkey', 'INTEGER', false),
      ('part', 0, 'p_partkey', 'INTEGER', false), ('part', 1, 'p_name', 'TEXT', false), ('part', 2, 'p_brand', 'TEXT', false), ('part', 3, 'p_type', 'TEXT', false),
      ('part', 4, 'p_size', 'INTEGER', false), ('part', 5, 'p_retailprice', 'REAL', false)) AS v(table_name, position, column_name, canonical_type, is_key)""")
add("catalog_overview", lambda t: perception.catalog_overview({n: getattr(t, n) for n in SMALL}), " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in SMALL))
add("schema_map", lambda t: t.spark.createDataFrame([(n, c) for n, cs in perception.schema_map({"region": t.region, "nation": t.nation}).items() for c in cs], "table_name string, column_name string"), "SELECT * FROM (VALUES ('region', 'r_regionkey'), ('region', 'r_name'), ('nation', 'n_nationkey'), ('nation', 'n_name'), ('nation', 'n_regionkey')) AS v(table_name, column_name)")
add("describe_table", lambda t: perception.describe_table(t.spark, "labels", t.labels), "SELECT 'labels' AS table_name, position, column_name, type, true AS nullable FROM (VALUES (0, 'doc_id', 'bigint'), (1, 'quality', 'int'), (2, 'toxic', 'int')) AS v(position, column_name, type)")
add("inspect_column", lambda t: perception.inspect_column(t.part, "p_brand"), "SELECT p_brand AS value, count(*) AS frequency, true AS complete FROM part GROUP BY p_brand")
KEYED = {"region": (("r_regionkey",), ()), "nation": (("n_nationkey",), (catalog.ForeignKey("n_regionkey", "region"),)), "customer": (("c_custkey",), (catalog.ForeignKey("c_nationkey", "nation"),)), "orders": (("o_orderkey",), (catalog.ForeignKey("o_custkey", "customer", "c_custkey"),))}


def _keyed(t: Tables) -> dict[str, catalog.Source]:
    return {n: catalog.Source(n, getattr(t, n), *keys) for n, keys in KEYED.items()}


add("catalog_foreign_keys", lambda t: catalog.foreign_keys(t.spark, _keyed(t)), "SELECT table_name, column_name, parent, parent_column, row_count FROM (VALUES ('nation', 'n_regionkey', 'region', 'r_regionkey'), ('customer', 'c_nationkey', 'nation', 'n_nationkey'), ('orders', 'o_custkey', 'customer', 'c_custkey')) AS v(table_name, column_name, parent, parent_column) JOIN (SELECT 'nation' AS table_name, count(*) AS row_count FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders) USING (table_name)")
add("describe_table_keys", lambda t: perception.describe_source(t.spark, _keyed(t), "nation"), "SELECT 'nation' AS table_name, position, column_name, type, true AS nullable, position = 0 AS is_key, ref AS \"references\", (SELECT count(*) FROM nation) AS row_count FROM (VALUES (0, 'n_nationkey', 'int', NULL), (1, 'n_name', 'string', NULL), (2, 'n_regionkey', 'int', 'region.r_regionkey')) AS v(position, column_name, type, ref)")
add("inspect_column_summary", lambda t: perception.inspect_summary(t.documents.join(t.labels, "doc_id", "left"), "quality"), "WITH x AS (SELECT quality FROM documents LEFT JOIN labels USING (doc_id)) SELECT quality AS value, count(*) AS frequency, true AS complete, (SELECT count(DISTINCT quality) FROM x) AS distinct_values, (SELECT count(*) > count(quality) FROM x) AS has_null FROM x WHERE quality IS NOT NULL GROUP BY quality")
add("inspect_column_many", lambda t: perception.inspect_column(t.events, "user_id", top_k=10), "WITH c AS (SELECT user_id AS value, count(*) AS frequency FROM events GROUP BY user_id) SELECT value, frequency, (SELECT count(*) FROM c) <= 50 AS complete FROM c QUALIFY (SELECT count(*) FROM c) <= 50 OR row_number() OVER (ORDER BY frequency DESC, value) <= 10")
add("inspect_column_typed", lambda t: perception.value_counts(t.customer, "c_mktsegment"), "SELECT c_mktsegment AS value, count(*) AS frequency FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment")
add("column_summary", lambda t: perception.column_summary(t.documents.join(t.labels, "doc_id", "left"), "quality"), "SELECT count(DISTINCT quality) AS distinct_values, count(*) - count(quality) AS null_rows, count(*) AS total_rows FROM documents LEFT JOIN labels USING (doc_id)")
add("read_rows", lambda t: perception.read_subtable(t.orders, ["o_orderkey", "o_totalprice"], 20, {"column": "o_orderstatus", "op": "=", "value": "F"}, ["o_totalprice DESC", "o_orderkey"], 5), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
add("read_rows_typed", lambda t: perception.read_rows(t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left"), ["doc_id", "quality"], 20, {"op": "is_null", "value": {"column": "quality"}}, [{"column": "doc_id"}])[0], "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL ORDER BY doc_id LIMIT 20")
add("preview", lambda t: perception.preview(t.region, 100), "SELECT * FROM region")
add("sample_values", lambda t: perception.sample_values(t.part, "p_type", 4), "SELECT DISTINCT p_type AS value FROM part ORDER BY value LIMIT 4")
add("count_nulls", lambda t: perception.count_nulls(t.documents.join(t.labels, "doc_id", "left"), "toxic"), "SELECT count(*) - count(toxic) AS null_rows FROM documents LEFT JOIN labels USING (doc_id)")
add("collect_rows", lambda t: t.region, "SELECT * FROM region")
add("page_rows", lambda t: perception.page(t.supplier.select("s_suppkey", "s_name"), 1, 5, ["s_suppkey"]), "SELECT s_suppkey, s_name, (SELECT count(*) FROM supplier) AS total_rows FROM supplier ORDER BY s_suppkey LIMIT 5 OFFSET 5")
add("scan_parquet_sample", lambda t: files.scan_parquet_sample(t.customer, "c_custkey", 50, "7").select("c_custkey"), "SELECT c_custkey FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR) || '7'), c_custkey LIMIT 50")


def _values(t: Tables, *names: str, column: str | None = None) -> search.ValueIndex:
    """The index of these tables' values, built by the first query that asks for it."""
    return search.kept_index((t.root, names, column), lambda: search.ValueIndex.build({n: getattr(t, n) for n in names}, column), t.spark)


add("search_values", lambda t: _values(t, "part", column="p_type").search("economy").drop("table"), "SELECT 'p_type' AS \"column\", p_type AS value, count(*) AS frequency, 1 AS tier, 1.0::DOUBLE AS score FROM part WHERE lower(p_type) = 'economy' GROUP BY p_type")
add("search_values_fuzzy", lambda t: _values(t, "nation").search("NATION_7").drop("table"), None)
add("search_values_bounded", lambda t: _values(t, "customer", column="c_mktsegment").search_bounded("machinery").drop("table"), "SELECT 'c_mktsegment' AS \"column\", c_mktsegment AS value, count(*) AS frequency, 1 AS tier, 1.0::DOUBLE AS score, false AS capped FROM customer WHERE lower(c_mktsegment) = 'machinery' GROUP BY c_mktsegment")
add("search_database", lambda t: _values(t, "part", "nation", "customer").search_bounded("building"), "SELECT 'customer' AS \"table\", 'c_mktsegment' AS \"column\", c_mktsegment AS value, count(*) AS frequency, 1 AS tier, 1.0::DOUBLE AS score, false AS capped FROM customer WHERE lower(c_mktsegment) = 'building' GROUP BY c_mktsegment")

JOIN_SQL = "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
add("sql_guarded", lambda t: sql_.execute_sql(t.spark, JOIN_SQL, {"customer": t.customer, "nation": t.nation}), JOIN_SQL)
WITH_SQL = "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus"
add("sql_readonly", lambda t: sql_.execute_sql(t.spark, sql_.check_read_only(WITH_SQL), {"orders": t.orders}), WITH_SQL)
add("sql_predicted", lambda t: sql_.within(t.spark, 60, lambda: sql_.bounded(sql_.execute_sql(t.spark, "SELECT r_name FROM region ORDER BY r_name", {"region": t.region}))), "SELECT r_name FROM region")
TEXTS = ["SELECT a FROM t WHERE b = 'JOIN x'", "SELECT count(*) FROM a JOIN b ON a.i = b.i GROUP BY c ORDER BY 1 LIMIT 5", "SELECT x FROM (SELECT DISTINCT y FROM z) UNION SELECT 1"]


def _texts(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(list(enumerate(TEXTS)), "id int, sql string")


add("sql_profile", lambda t: sql_.profile(_texts(t), "sql").select("id", "n_joins", "n_selects", "n_aggregates", "difficulty"), "SELECT * FROM (VALUES (0, 0, 1, 0, 'easy'), (1, 1, 1, 1, 'medium'), (2, 0, 3, 0, 'hard')) AS v(id, n_joins, n_selects, n_aggregates, difficulty)")

STEPS = [
    {"id": "kept", "tool": "condition_filter", "args": {"table": "orders", "conditions": [{"column": "o_orderdate", "op": ">=", "value": "1997-01-01"}]}},
    {"id": "joined", "tool": "join_tables", "args": {"base": {"step": "kept"}, "joins": [{"table": "customer", "on": [{"left": "o.o_custkey", "right": "c_custkey"}], "role": "c"}], "base_role": "o"}},
    {"id": "mean", "tool": "group_aggregate", "args": {"table": {"step": "kept"}, "group_by": [], "aggregations": [{"op": "avg", "column": "o_totalprice", "as": "mean"}]}},
    {"id": "rich", "tool": "condition_filter", "args": {"table": {"step": "joined"}, "conditions": {"column": "o.o_totalprice", "op": ">", "value_ref": {"step": "mean"}}}},
    {"id": "counts", "tool": "group_aggregate", "args": {"table": {"step": "rich"}, "group_by": ["c.c_mktsegment"], "aggregations": [{"op": "count", "column": "*", "as": "n"}]}},
    {"id": "out", "tool": "project", "args": {"table": {"step": "counts"}, "expressions": ["c.c_mktsegment AS segment", "n"]}},
]
PROGRAM_SQL = "WITH kept AS (SELECT * FROM orders WHERE o_orderdate >= DATE '1997-01-01') SELECT c_mktsegment AS segment, count(*) AS n FROM kept JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > (SELECT avg(o_totalprice) FROM kept) GROUP BY c_mktsegment"


def _space(t: Tables) -> Workspace:
    return Workspace(t.spark, {"orders": t.orders, "customer": t.customer, "nation": t.nation})


def _after(t: Tables) -> Workspace:
    w = _space(t)
    w.run(STEPS)
    return w


add("run_plan", lambda t: _space(t).run(STEPS)["out"].df, PROGRAM_SQL)
add("program", lambda t: _space(t).run([*STEPS, {"id": "bad", "tool": "project", "args": {"table": "nowhere", "expressions": []}}], isolate=True)["out"].df, PROGRAM_SQL)
add("replay", lambda t: Workspace(t.spark, {}).replay("out", {"orders": t.orders, "customer": t.customer}, STEPS).df, PROGRAM_SQL)


def _restored(t: Tables) -> DataFrame:
    w = _space(t)
    w.checkpoint("start")
    w.call("distinct", table="nation")
    w.restore("start")
    return t.spark.createDataFrame([(n,) for n in w.handles], "handle string")


add("checkpoint_restore", _restored, "SELECT * FROM (VALUES ('orders'), ('customer'), ('nation')) AS v(handle)")
add("lineage_record", lambda t: _after(t).lineage(), "SELECT * FROM (VALUES ('filter_001', 'filter', 'orders'), ('join_002', 'join', 'filter_001'), ('join_002', 'join', 'customer'), ('group_003', 'group', 'filter_001'), ('filter_004', 'filter', 'join_002'), ('group_005', 'group', 'filter_004'), ('project_006', 'project', 'group_005')) AS v(handle, kind, input)")
add("backward_slice", lambda t: (lambda w: t.spark.createDataFrame([(n,) for n in w.backward_slice("filter_004")], "handle string"))(_after(t)), "SELECT * FROM (VALUES ('orders'), ('customer'), ('filter_001'), ('join_002'), ('filter_004')) AS v(handle)")
add("error_feedback", lambda t: t.spark.createDataFrame([(_space(t).try_call("project", table="order", expressions=["x"])["code"],), (_space(t).try_call("project", table="orders", expressions=["price"])["code"],)], "code string"), "SELECT * FROM (VALUES ('unknown_table'), ('unknown_column')) AS v(code)")
add("answer", lambda t: (lambda w: w.answer(w.run(STEPS)["out"].name))(_space(t)), PROGRAM_SQL)
add("join_unmatched_lineage", lambda t: joins.unmatched_count(joins.join_pair(t.customer.select("c_custkey"), t.orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey").distinct(), [{"left": "c_custkey", "right": "o_custkey"}], "left"), "o_custkey"), "SELECT count(*) AS unmatched FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")


# -- files -----------------------------------------------------------------------------------
NATION = "n_nationkey int, n_name string, n_regionkey int"


def _through(write, read):
    """Nations written to the shared folder and read again."""

    def run(t: Tables) -> DataFrame:
        path = shared_dir(t.spark, "files")
        write(t.nation, path)
        return read(t.spark, path)

    return run


add("scan_jsonl", _through(lambda df, p: df.write.json(p), lambda s, p: files.scan_jsonl(s, p, NATION)), "SELECT * FROM nation")
add("scan_json_array", _through(lambda df, p: df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value")).write.text(p), lambda s, p: files.scan_json_array(s, p, NATION)), "SELECT * FROM nation")
add("scan_csv", _through(lambda df, p: df.write.option("header", True).csv(p), lambda s, p: files.scan_csv(s, p, NATION)), "SELECT * FROM nation")
add("sink_parquet", _through(files.sink_parquet, lambda s, p: s.read.parquet(p)), "SELECT * FROM nation")
add("sample_parquet", _through(lambda df, p: files.sink_parquet(files.scan_parquet_sample(df, "n_nationkey", 7), p), lambda s, p: s.read.parquet(p)), "SELECT * FROM nation ORDER BY md5(CAST(n_nationkey AS VARCHAR) || '0'), n_nationkey LIMIT 7")
add("sink_sample", _through(lambda df, p: files.sink_sample(df, p, 5, "n_nationkey", "nation"), lambda s, p: files.scan_jsonl(s, p, NATION + ", source string")), "SELECT *, 'nation' AS source FROM nation ORDER BY md5(CAST(n_nationkey AS VARCHAR) || '0'), n_nationkey LIMIT 5")


def _journal(t: Tables) -> DataFrame:
    log = files.Journal(t.spark, shared_dir(t.spark, "journal"), {"run": 1}, NATION, "n_nationkey")
    log.append(t.nation.filter("n_nationkey < 10"))
    log.append(t.nation.filter("n_nationkey >= 5"))
    return log.records()


add("sink_jsonl", _journal, "SELECT * FROM nation")
add("page_jsonl", _through(lambda df, p: df.write.json(p), lambda s, p: perception.page(files.scan_jsonl(s, p, NATION).filter("n_regionkey BETWEEN 1 AND 3"), 1, 4, ["n_nationkey"])), "SELECT *, (SELECT count(*) FROM nation WHERE n_regionkey BETWEEN 1 AND 3) AS total_rows FROM nation WHERE n_regionkey BETWEEN 1 AND 3 ORDER BY n_nationkey LIMIT 4 OFFSET 4")
add("adapters", lambda t: files.tasks(t.benchmark, "bench", "dev", {"task_id": "item_id", "question": "text"}), "SELECT CAST(item_id AS VARCHAR) AS task_id, 'bench' AS dataset, 'dev' AS split, NULL::VARCHAR AS db_id, text AS question, NULL::VARCHAR AS gold_sql, NULL::VARCHAR AS metadata FROM benchmark")

# -- guards and provenance -----------------------------------------------------------------
def _code(action) -> str:
    try:
        action()
    except OpError as error:
        return error.code
    return "none"


def _words(t: Tables, *words: str) -> DataFrame:
    return t.spark.createDataFrame([(w,) for w in words], "word string")


add("validate_project", lambda t: _words(t, *_space(t).check("project", table="orders", expressions=["o_orderkey AS id", "o_totalprice * 2 AS twice"])), "SELECT * FROM (VALUES ('id'), ('twice')) AS v(word)")
add("resource_guard", lambda t: _words(t, _code(lambda: sql_.bounded(t.orders, 100)), _code(lambda: sql_.bounded(t.region, 100)), _code(lambda: sql_.bounded(t.orders, most_bytes=1000)), _code(lambda: sql_.bounded(t.region, most_cell=10))), "SELECT * FROM (VALUES ('too_many_rows'), ('none'), ('too_many_bytes'), ('cell_too_large')) AS v(word)")
add("deadline", lambda t: t.spark.range(1).select(F.lit(sql_.within(t.spark, 60, lambda: t.region.count())).alias("rows")), "SELECT CAST(count(*) AS INTEGER) AS rows FROM region")
add("sql_preview", lambda t: (lambda got: t.spark.createDataFrame([(len(got[0]), got[1])], "rows int, more boolean"))(sql_.preview(sql_.execute_sql(t.spark, "SELECT * FROM nation", {"nation": t.nation}), 10)), "SELECT 10 AS rows, true AS more")
add("denotation_score", lambda t: compare.same_set(_after(t).answer("project_006"), sql_.execute_sql(t.spark, PROGRAM_SQL, {"orders": t.orders, "customer": t.customer})), "SELECT true AS equal")
add("set_handle", lambda t: _words(t, _space(t).handle("ORDERS").name, *_space(t).call("distinct", table={"table": "nation"}).inputs), "SELECT * FROM (VALUES ('orders'), ('nation')) AS v(word)")
add("lineage_columns", lambda t: _words(t, *columns_of({"op": "case_when", "branches": [{"when": {"op": ">", "left": {"column": "a"}, "right": {"value": 1}}, "then": {"column": "b"}}], "else": {"op": "add", "args": [{"column": "a"}, {"column": "c"}]}})), "SELECT * FROM (VALUES ('a'), ('b'), ('c')) AS v(word)")
add("provenance_edges", lambda t: _after(t).provenance().filter("handle = 'filter_001' OR handle = 'project_006'"), "SELECT * FROM (VALUES ('filter_001', 'orders', 'o_orderdate'), ('project_006', 'group_005', 'c.c_mktsegment'), ('project_006', 'group_005', 'n')) AS v(handle, input, \"column\")")
OTHER = [*STEPS[:4], {"id": "counts", "tool": "execute_sql", "args": {"sql": "SELECT * FROM customer"}}, STEPS[5] | {"args": {"table": {"step": "kept"}, "expressions": ["o_orderstatus AS segment", "o_orderkey AS n"]}}]
add("counterfactual_suite", lambda t: equivalent(t.spark, STEPS, OTHER, "out", {"as it is": {"orders": t.orders, "customer": t.customer}, "empty": {"orders": t.orders.limit(0), "customer": t.customer}}).select("database", "equal", "has_rows"), "SELECT * FROM (VALUES ('as it is', false, true), ('empty', true, false)) AS v(database, equal, has_rows)")


# Two ways to an answer over databases made from the given one. BY_ORDERS agrees with SEGMENTS everywhere, BY_CUSTOMERS until customers repeat.
SEGMENTS = "SELECT c_mktsegment AS segment, count(DISTINCT c_custkey) AS buyers, count(o_totalprice) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"
BY_ORDERS = """SELECT segment, count(*) AS buyers, CAST(sum(n) AS BIGINT) AS n FROM (SELECT c_mktsegment AS segment, c_custkey, sum(n) AS n FROM customer
    JOIN (SELECT o_custkey, count(o_totalprice) AS n FROM orders GROUP BY o_custkey) AS o ON o_custkey = c_custkey GROUP BY c_mktsegment, c_custkey) AS x GROUP BY segment"""
BY_CUSTOMERS = """SELECT c_mktsegment AS segment, count(*) AS buyers, CAST(sum(n) AS BIGINT) AS n FROM customer
    JOIN (SELECT o_custkey, count(o_totalprice) AS n FROM orders GROUP BY o_custkey) AS o ON o_custkey = c_custkey GROUP BY c_mktsegment"""
DRAWN = "substr(md5(coalesce(CAST({} AS VARCHAR), '') || 's'), 1, 8) < '80000000'"
CHANGES = {
    "fewer orders": ("orders", f"(SELECT * FROM orders WHERE {DRAWN.format('o_orderkey')})"),
    "repeated orders": ("orders", "(SELECT * FROM orders UNION ALL SELECT * FROM orders)"),
    "empty orders": ("orders", "(SELECT * FROM orders WHERE false)"),
    "blank orders.o_totalprice": ("orders", f"(SELECT * REPLACE (CASE WHEN NOT {DRAWN.format('o_orderkey')} THEN o_totalprice END AS o_totalprice) FROM orders)"),
    "fewer customer": ("customer", f"(SELECT * FROM customer WHERE {DRAWN.format('c_custkey')})"),
    "repeated customer": ("customer", "(SELECT * FROM customer UNION ALL SELECT * FROM customer)"),
    "empty customer": ("customer", "(SELECT * FROM customer WHERE false)"),
}


def _outcomes(t: Tables, candidate: str) -> DataFrame:
    tables = {"orders": t.orders, "customer": t.customer}
    way = lambda text: lambda own: sql_.execute_sql(t.spark, text, own)
    return suite.outcomes(t.spark, way(candidate), way(SEGMENTS), tables, suite.variants(tables, {"orders": "o_orderkey", "customer": "c_custkey"}, {"orders": ["o_totalprice"]}, "s"))


def _outcomes_sql(candidate: str) -> str:
    """Both ways on each changed database, and the right one on the given database, compared as sets."""
    parts = []
    for name, (table, own) in CHANGES.items():
        c, g = (f"({re.sub(rf'(FROM|JOIN) {table}\b', rf'\1 {own} AS {table}', text)})" for text in (candidate, SEGMENTS))
        differ = lambda a, b: f"(EXISTS (SELECT * FROM {a} EXCEPT SELECT * FROM {b}) OR EXISTS (SELECT * FROM {b} EXCEPT SELECT * FROM {a}))"
        parts.append(f"SELECT '{name}' AS database, NOT {differ(c, g)} AS equal, {differ(g, f'({SEGMENTS})')} OR {differ(c, g)} AS informative, CAST(NULL AS VARCHAR) AS error")
    return " UNION ALL ".join(parts)


VERDICT_SQL = """SELECT failures = 0 AND informative >= 3 AS passed, CASE WHEN failures > 0 THEN 'counterexample_found' WHEN informative < 3 THEN 'insufficient_informative_databases' ELSE 'passed' END AS reason, * FROM (
    SELECT count(*) AS databases, count(*) FILTER (WHERE informative) AS informative, count(*) FILTER (WHERE NOT equal) AS failures, count(error) AS errors FROM ({}))"""
add("counterfactual_outcomes", lambda t: _outcomes(t, BY_CUSTOMERS), _outcomes_sql(BY_CUSTOMERS))
add("counterfactual_passed", lambda t: suite.verdict(_outcomes(t, BY_ORDERS), 3), VERDICT_SQL.format(_outcomes_sql(BY_ORDERS)))
add("counterfactual_failed", lambda t: suite.verdict(_outcomes(t, BY_CUSTOMERS), 3), VERDICT_SQL.format(_outcomes_sql(BY_CUSTOMERS)))
