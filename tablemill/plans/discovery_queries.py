"""Queries for semantic match, keys found in rows, levels of groups, JSON, users' own functions, streams, cover selection and bootstraps of two samples."""

from __future__ import annotations

import operator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.operators import cover, groups, joins, json_columns, levels, records, user_functions, vectors
from tablemill.plans.base import Book, Tables
from tablemill.shared import shared_dir, written
from tablemill.sources import keys
from tablemill.streaming import windows

BOOK = Book()
add = BOOK.add

# -- semantic match --------------------------------------------------------------------------------
ASKING = "vec_id % 50 = 0"


def _exact(t: Tables) -> DataFrame:
    index = vectors.VectorIndex.build(t.embeddings, "vec_id", "embedding")
    return index.search(t.embeddings.filter(ASKING), "vec_id", "embedding", 10, probes=len(index.centres))


add("semantic_match", lambda t: vectors.semantic_match(t.embeddings, "vec_id", "embedding", F.expr(ASKING)).withColumn("similarity", F.round("similarity", 6)))
add("semantic_match_all_cells", lambda t: _exact(t).withColumn("similarity", F.round("similarity", 6)), f"""
    WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS x FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.{ASKING})
    SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, id, round(x, 6) AS similarity FROM s WINDOW w AS (PARTITION BY query_id ORDER BY round(x, 12) DESC, id) QUALIFY row_number() OVER w <= 10""")

# -- keys of tables ----------------------------------------------------------------------------------
COLUMNS = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "supplier": ("s_suppkey", "s_name", "s_nationkey"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"),
}


def _keyed(t: Tables) -> dict[str, DataFrame]:
    return {n: getattr(t, n) for n in COLUMNS}


REFERS = [(a, c, b, k) for a, cs in COLUMNS.items() for c in cs for b, ks in COLUMNS.items() for k in ks if (a, c) != (b, k) and c[2:] == k[2:]]
add("found_keys", lambda t: keys.found_keys(_keyed(t)), " UNION ALL ".join(f"SELECT '{n}' AS table_name, '{c}' AS column_name, count(*) AS row_count FROM {n} HAVING count(*) = count(DISTINCT {c}) AND count(*) > 0" for n, cs in COLUMNS.items() for c in cs))
add("found_foreign_keys", lambda t: keys.found_foreign_keys(_keyed(t)), " UNION ALL ".join(
    f"SELECT '{a}' AS table_name, '{c}' AS column_name, '{b}' AS parent, '{k}' AS parent_column WHERE (SELECT count(*) = count(DISTINCT {k}) FROM {b}) AND NOT EXISTS (SELECT 1 FROM {a} WHERE {c} NOT IN (SELECT {k} FROM {b}))" for a, c, b, k in REFERS))

# -- outer joins and more aggregates ---------------------------------------------------------------------
add("join_right", lambda t: joins.join_pair(t.labels, t.documents.select("doc_id", "lang").withColumnRenamed("doc_id", "d"), [{"left": "doc_id", "right": "d"}], "right"), "SELECT labels.*, documents.doc_id AS d, lang FROM labels RIGHT JOIN documents ON labels.doc_id = documents.doc_id")
add("join_full", lambda t: joins.join_pair(t.customer.filter("c_acctbal > 3000").select("c_custkey", "c_acctbal"), t.orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey"), [{"left": "c_custkey", "right": "o_custkey"}], "full"),
    "SELECT c_custkey, c_acctbal, o_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 3000) FULL JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey")
SPREADS = {"middle": "median", "sd": "stddev", "sd_all": "stddev_pop", "var": "variance", "var_all": "variance_pop"}
add("agg_spread", lambda t: groups.group_aggregate(t.lineitem, ["l_returnflag"], [{"op": op, "column": "l_quantity", "as": n} for n, op in SPREADS.items()]).select("l_returnflag", *(F.round(n, 6).alias(n) for n in SPREADS)),
    "SELECT l_returnflag, round(median(l_quantity), 6) AS middle, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sd_all, round(var_samp(l_quantity), 6) AS var, round(var_pop(l_quantity), 6) AS var_all FROM lineitem GROUP BY l_returnflag")
add("agg_approx_distinct", lambda t: t.lineitem.groupBy("l_returnflag").agg((F.abs(F.approx_count_distinct("l_partkey", 0.02) - F.count_distinct("l_partkey")) <= 0.06 * F.count_distinct("l_partkey")).alias("near")), "SELECT l_returnflag, true AS near FROM lineitem GROUP BY l_returnflag")

# -- levels ----------------------------------------------------------------------------------------------
FIGURES = {"n": {"op": "count"}, "quantity": {"op": "sum", "column": "l_quantity"}, "least": {"op": "min", "column": "l_extendedprice"}, "most": {"op": "max", "column": "l_extendedprice"}, "mean": {"op": "avg", "column": "l_quantity"}}
EXACT = "count(*) AS n, sum(l_quantity) AS quantity, min(l_extendedprice) AS least, max(l_extendedprice) AS most, avg(l_quantity) AS mean FROM lineitem GROUP BY"
FLAGS = ["l_returnflag", "l_linestatus", "l_linenumber"]
IDS = f"SELECT {', '.join(FLAGS)}, CAST(GROUPING({', '.join(FLAGS)}) AS INTEGER) AS grouping_id, "
add("agg_cube", lambda t: levels.grouping_sets(t.lineitem, FLAGS, levels.cube(FLAGS), FIGURES), f"{IDS}{EXACT} CUBE ({', '.join(FLAGS)})")
add("agg_rollup", lambda t: levels.grouping_sets(t.lineitem, FLAGS, levels.rollup(FLAGS), FIGURES), f"{IDS}{EXACT} ROLLUP ({', '.join(FLAGS)})")
add("agg_grouping_sets", lambda t: levels.grouping_sets(t.lineitem, FLAGS, [FLAGS[:1], FLAGS[1:], []], FIGURES), f"{IDS}{EXACT} GROUPING SETS ((l_returnflag), (l_linestatus, l_linenumber), ())")


def _sketched(t: Tables) -> DataFrame:
    """For each level whether estimates from merged sketches are within their errors of the exact figures.

    Distinct values are counted once they are distinct in the finest level. A median lies between two percentiles if the rows up to it and from
    it on say so, which takes counts and the values beside it instead of all values of a group in one task.
    """
    by, sets = ["l_returnflag", "l_linestatus"], levels.cube(["l_returnflag", "l_linestatus"])
    near = written(levels.grouping_sets(t.lineitem, by, sets, {"parts": {"op": "distinct", "column": "l_partkey"}, "middle": {"op": "quantile", "column": "l_extendedprice", "at": 0.5}}), "sketched")
    parts = t.lineitem.select(*by, "l_partkey").distinct().cube(*by).agg(F.grouping_id().cast("int").alias("g"), F.count_distinct("l_partkey").alias("exact"))
    rows = t.lineitem.select(*by, F.col("l_extendedprice").alias("x")).filter("x IS NOT NULL")
    every = None
    for own in sets:
        level = sum(1 << (len(by) - 1 - i) for i, k in enumerate(by) if k not in own)
        cuts = near.filter(F.col("grouping_id") == level).select(*(F.col(k).alias(f"__{k}") for k in by), F.col("grouping_id").alias("__g"), F.col("middle").alias("m"))
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in own]
        beside = (rows.join(F.broadcast(cuts), same) if same else rows.crossJoin(F.broadcast(cuts))).groupBy("__g", *(f"__{k}" for k in by)).agg(
            F.max("m").alias("m"), F.count("*").alias("n"), F.count_if(F.col("x") <= F.col("m")).alias("upto"), F.count_if(F.col("x") < F.col("m")).alias("below"),
            F.max(F.when(F.col("x") <= F.col("m"), F.col("x"))).alias("last"), F.min(F.when(F.col("x") > F.col("m"), F.col("x"))).alias("next"),
            F.max(F.when(F.col("x") < F.col("m"), F.col("x"))).alias("before"), F.min(F.when(F.col("x") >= F.col("m"), F.col("x"))).alias("first"))
        every = beside if every is None else every.unionByName(beside)
    both = near.join(parts, [near[c].eqNullSafe(parts[c]) for c in by] + [near["grouping_id"] == parts["g"]]).select(*(near[c] for c in by), "grouping_id", "parts", "exact")
    both = both.join(every, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col("grouping_id") == F.col("__g")], "left")
    between = _percentile_bound(0.47, "upto", "last", "next", operator.le) & _percentile_bound(0.53, "below", "before", "first", operator.ge)
    return both.select(*by, "grouping_id", (F.abs(F.col("parts") - F.col("exact")) <= 0.06 * F.col("exact")).alias("distinct_near"), between.alias("median_near"))


def _percentile_bound(share: float, count: str, last: str, next_: str, holds) -> Column:
    """Whether the percentile of ``n`` values is ``holds`` (at most, at least) ``m``, from how many values come before a cut at ``m`` and the two beside it."""
    at = share * (F.col("n") - 1)
    low, high = F.floor(at), F.ceil(at)
    between = F.col(last) + (at - low) * (F.col(next_) - F.col(last))
    before, after = F.lit(holds is operator.le), F.lit(holds is operator.ge)
    return F.when(high < F.col(count), before).when(low >= F.col(count), after).otherwise(holds(between, F.col("m")))


add("agg_cube_sketches", _sketched, "SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag, l_linestatus) AS INTEGER) AS grouping_id, true AS distinct_near, true AS median_near FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")


# -- JSON ------------------------------------------------------------------------------------------------
def _texts(t: Tables) -> DataFrame:
    """Events with nested properties; every seventh text is cut off, every eleventh holds text for a number."""
    whole = F.concat(F.lit('{"k": '), F.when(F.col("event_id") % 11 == 0, '"many"').otherwise(F.get_json_object("props", "$.k")), F.lit(', "path": ["'), "event_type", F.lit('", "user '), "user_id", F.lit('"], "at": {"id": '), "event_id", F.lit("}}"))
    return t.events.select("event_id", F.when(F.col("event_id") % 7 == 0, F.substring(whole, 1, 12)).otherwise(whole).alias("doc"))


DOCS = """(SELECT event_id, CASE WHEN event_id % 7 = 0 THEN substr(w, 1, 12) ELSE w END AS doc, event_id % 7 <> 0 AS sound, event_id % 11 <> 0 AS number, event_type, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS kk FROM (
    SELECT *, '{"k": ' || CASE WHEN event_id % 11 = 0 THEN '"many"' ELSE json_extract_string(props, '$.k') END || ', "path": ["' || event_type || '", "user ' || user_id || '"], "at": {"id": ' || event_id || '}}' AS w FROM events))"""
FIELDS = {"k": ("$.k", "bigint"), "id": ("$.at.id", "bigint"), "first": ("$.path[0]", "string"), "none": ("$.nowhere", "string")}
add("json_extract", lambda t: json_columns.extract(_texts(t), "doc", FIELDS, "malformed").drop("doc"),
    f"SELECT event_id, CASE WHEN sound AND number THEN kk END AS k, CASE WHEN sound THEN event_id END AS id, CASE WHEN sound THEN event_type END AS first, CAST(NULL AS VARCHAR) AS none, NOT sound AS malformed FROM {DOCS}")
add("json_elements", lambda t: json_columns.elements(_texts(t), "doc", "$.path", "string").drop("doc"), f"SELECT event_id, CAST(i AS INTEGER) AS position, CASE WHEN i = 0 THEN event_type ELSE 'user ' || user_id END AS element FROM {DOCS}, (SELECT unnest([0, 1]) AS i) WHERE sound")
add("json_schema", lambda t: json_columns.schema(t.events, "props"), "SELECT 'OBJECT<k: BIGINT>' AS schema, count(props) AS rows, count(*) FILTER (WHERE NOT json_valid(props)) AS malformed FROM events")


# -- users' own functions ----------------------------------------------------------------------------------
def _initials(names: pd.Series) -> pd.Series:
    return names.str.replace(r"[^#0-9]", "", regex=True)


def _own_scalar(t: Tables) -> DataFrame:
    user_functions.register_scalar(t.spark, "digits_of", _initials, "string")
    return t.customer.selectExpr("c_custkey", "digits_of(c_name) AS digits")


SECOND = user_functions.Aggregate(first=list, fold=lambda s, v: sorted([*s, *v.nlargest(2)])[-2:], merge=lambda a, b: sorted([*a, *b])[-2:], last=lambda s: s[0] if len(s) > 1 else None, returns="double")
add("udf_scalar", _own_scalar, "SELECT c_custkey, regexp_replace(c_name, '[^#0-9]', '', 'g') AS digits FROM customer")
add("udf_aggregate", lambda t: user_functions.aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", SECOND, "second"), "SELECT l_returnflag, l_linestatus, list_sort(list(l_extendedprice), 'DESC')[2] AS second FROM lineitem GROUP BY ALL")

# -- streams -------------------------------------------------------------------------------------------------
STREAMED = "event_id long, ts timestamp, user_id long, event_type string, cents long"


def _streamed(t: Tables, make) -> DataFrame:
    """What ``make`` gives of a stream of all events, in files by time. The stream is stopped after half of them and started again."""
    rows = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    cuts = rows.agg(F.percentile_approx(F.unix_micros("ts"), F.lit([0.25, 0.5, 0.75])), F.max("ts").alias("last")).first()
    folder, out, state = (shared_dir(t.spark, n) for n in ("stream-input", "stream-result", "stream-state"))
    at, edges = F.unix_micros("ts"), [None, *(cuts[0] or []), None]
    result = lambda: make(windows.table_stream(t.spark, folder, STREAMED))

    def arrive(df: DataFrame) -> None:
        df.coalesce(1).write.mode("append").parquet(folder)

    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        arrive(rows.filter((at > low if low is not None else F.lit(True)) & (at <= high if high is not None else F.lit(True))))
        if i == 1:
            windows.drained(result(), out, state)
    if cuts.last is not None:
        for days in (1000, 2000):  # rows that only move the watermark on, so that what is open is given
            arrive(t.spark.createDataFrame([(None, cuts.last + timedelta(days=days), -1, "later", 0)], STREAMED))
    windows.drained(result(), out, state)
    return t.spark.read.schema(result().schema).parquet(out)


def _plain_times(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


CENTS = "(SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"
add("stream_sliding", lambda t: _plain_times(_streamed(t, lambda s: windows.sliding(s, "ts", ["event_type"], "1 day", "6 hours", "1 hour", "cents")).filter("event_type != 'later'"), "window_start"),
    f"SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOURS AS window_start, event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM {CENTS}, (SELECT unnest(range(4)) AS k) GROUP BY ALL")
add("stream_sessions", lambda t: _plain_times(_streamed(t, lambda s: windows.sessions(s, "ts", ["user_id"], "6 hours", "1 hour", "cents")).filter("user_id >= 0"), "session_start", "session_end"),
    f"SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 HOURS AS session_end, user_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM {CENTS})) GROUP BY user_id, s")
add("stream_changes", lambda t: _plain_times(_streamed(t, lambda s: windows.state_changes(s, "ts", "user_id", "event_type", "1 hour")).filter("user_id >= 0"), "since"),
    "SELECT user_id, ts AS since, event_type AS value, before FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE before IS NULL OR before <> event_type")


# -- cover selection and bootstraps ------------------------------------------------------------------------------
def _cover(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", "source", F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+").alias("words"))
    return cover.greedy_cover(rows, "doc_id", "words", 30, "source", {"pair": (["source", "lang"], 3), "lang": (["lang"], 12)}).withColumn("gain", F.round("gain", 6))


add("greedy_cover", _cover)
SCORED = "(SELECT * FROM documents JOIN labels USING (doc_id))"
ROUNDS = 60


def drawn_sql(key: str, rounds: int) -> str:
    """(h, round, times) from a table x of distinct keys: the draws of ``records.draws``, in SQL."""
    mixed = "xor(z, z >> 33)"
    by = lambda inner, c: f"CAST((CAST({mixed.replace('z', inner)} AS UHUGEINT) * {c}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)"
    steps = f"CAST(((r)::UHUGEINT * {records.STEP}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)"
    chances = ", ".join(repr(float(c)) for c in records.CHANCES)
    return f"""(SELECT key, r AS round, len(list_filter([{chances}], lambda c: c <= u)) AS times FROM (SELECT key, r, CAST(xor(b, b >> 33) >> 11 AS DOUBLE) / 9007199254740992 AS u FROM (
        SELECT key, r, {by('a', records.MIX[1])} AS b FROM (SELECT key, r, {by('y', records.MIX[0])} AS a FROM (
        SELECT key, r, xor(('0x' || substr(md5(CAST(key AS VARCHAR) || '#0'), 1, 16))::UBIGINT, {steps}) AS y FROM {key}, (SELECT unnest(range(1, {rounds + 1})) AS r))))))"""


SAMPLE = "(SELECT event_id, user_id % 20 AS task, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"
add("bootstrap_ci_drawn", lambda t: records.bootstrap_ci(t.labels, "quality", rounds=ROUNDS, key="doc_id").select(*(F.round(c, 9).alias(c) for c in ("mean", "low", "high"))),
    f"SELECT round((SELECT avg(quality) FROM labels), 9) AS mean, round(quantile_cont(x, 0.025), 9) AS low, round(quantile_cont(x, 0.975), 9) AS high FROM (SELECT round, sum(quality * times) / sum(times) AS x FROM labels JOIN {drawn_sql('(SELECT DISTINCT doc_id AS key FROM labels)', ROUNDS)} d ON d.key = doc_id GROUP BY round)")
add("bootstrap_cluster_ci_drawn", lambda t: records.bootstrap_ci(t.events.select((F.col("user_id") % 20).alias("task"), F.round(F.col("value") * 100).cast("long").alias("cents")), "cents", rounds=ROUNDS, cluster="task").select(*(F.round(c, 6).alias(c) for c in ("mean", "low", "high"))),
    f"SELECT round((SELECT avg(cents) FROM {SAMPLE}), 6) AS mean, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM (SELECT round, sum(s * times) / sum(n * times) AS x FROM (SELECT task, sum(cents)::DOUBLE AS s, count(*) AS n FROM {SAMPLE} GROUP BY task) JOIN {drawn_sql(f'(SELECT DISTINCT task AS key FROM {SAMPLE})', ROUNDS)} d ON d.key = task GROUP BY round)")
WITH_DRAWS = f"(SELECT doc_id, n_chars::DOUBLE AS v, quality = 1 AS p, round, times FROM {SCORED} JOIN (SELECT * FROM {drawn_sql('(SELECT DISTINCT doc_id AS key FROM labels)', ROUNDS)} UNION ALL SELECT doc_id, 0, 1 FROM labels) d ON d.key = doc_id)"
TWO_SIDED = f"""(SELECT round, n1, n0, s1, s0, q1, q0, pairs FROM (
    SELECT round, sum(times) FILTER (WHERE p) AS n1, sum(times) FILTER (WHERE NOT p) AS n0, sum(times * v) FILTER (WHERE p) AS s1, sum(times * v) FILTER (WHERE NOT p) AS s0, sum(times * v * v) FILTER (WHERE p) AS q1, sum(times * v * v) FILTER (WHERE NOT p) AS q0,
        sum(CASE WHEN p THEN times * (coalesce(below, 0) + coalesce(equal, 0) / 2.0) END) AS pairs
    FROM (SELECT *, sum(CASE WHEN p THEN 0 ELSE times END) OVER (PARTITION BY round ORDER BY v) - sum(CASE WHEN p THEN 0 ELSE times END) OVER (PARTITION BY round, v) AS below, sum(CASE WHEN p THEN 0 ELSE times END) OVER (PARTITION BY round, v) AS equal FROM {WITH_DRAWS}) GROUP BY round) WHERE n1 > 0 AND n0 > 0)"""
add("bootstrap_two_sample", lambda t: records.bootstrap_two(t.documents.join(t.labels, "doc_id").select("doc_id", "n_chars", (F.col("quality") == 1).alias("good")), "n_chars", "good", rounds=ROUNDS, key="doc_id").select("statistic", *(F.round(c, 6).alias(c) for c in ("estimate", "low", "high"))),
    " UNION ALL ".join(f"SELECT '{n}' AS statistic, round(max(x) FILTER (WHERE round = 0), 6) AS estimate, round(quantile_cont(x, 0.025) FILTER (WHERE round > 0), 6) AS low, round(quantile_cont(x, 0.975) FILTER (WHERE round > 0), 6) AS high FROM (SELECT round, {f} AS x FROM {TWO_SIDED})" for n, f in records.STATISTICS.items()))
