"""The gate before SQL: what Spark's parser finds decides, however the text is written."""

import pytest
from pyspark.errors import ParseException

from tablemill.errors import OpError
from tablemill.plans import sql as sql_

BAD = [
    "SELECT `java_method`('java.lang.System', 'getProperty', 'user.name')",
    r"SELECT '\'', java_method('java.lang.System', 'getProperty', 'user.name'), '\''",
    "SELECT /* x */ REFLECT /* y */ ('java.lang.System', 'getProperty', 'user.name')",
    "SELECT system.builtin.reflect('java.lang.System', 'getProperty', 'user.name')",
    "SELECT a FROM t WHERE a IN (SELECT try_reflect('java.lang.System', 'getProperty', 'user.name'))",
    "SELECT rank() OVER w FROM t WINDOW w AS (ORDER BY java_method('java.lang.System', 'getProperty', 'a'))",
    "WITH x AS (SELECT 1 AS a), y AS (SELECT reflect('a', 'b')) SELECT * FROM y",
    "VALUES (java_method('a', 'b'))",
    "SELECT IDENTIFIER('java_method')('a', 'b')",
    "SELECT * FROM IDENTIFIER('t')",
    "SELECT TRANSFORM(a) USING 'cat' FROM t",
    "SELECT mine(a) FROM t",
    "SELECT a FROM t; SELECT a FROM t",
    "INSERT INTO t SELECT 1",
    "FROM t INSERT INTO u SELECT a",
    "CREATE TEMPORARY VIEW v AS SELECT 1",
    "SET spark.sql.ansi.enabled = false",
    "EXPLAIN SELECT java_method('a', 'b')",
]
HIDDEN = ["SELECT * FROM global_temp.g", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM elsewhere", "SELECT (SELECT max(x) FROM elsewhere) FROM t", "SELECT * FROM spark_catalog.default.t", "TABLE elsewhere"]
GOOD = [
    'SELECT "a;b" AS a FROM t',
    "SELECT 'java_method(1)' AS a -- reflect(1); DROP TABLE t\nFROM T",
    "WITH t2 AS (SELECT a FROM t) SELECT * FROM t2 JOIN t USING (a) ORDER BY a LIMIT 1;",
    "SELECT a FROM t LATERAL VIEW explode(array(1)) AS b",
    "SELECT t.a FROM t, LATERAL (SELECT t.a + 1 AS b) WHERE EXISTS (SELECT 1 FROM range(3))",
    "SELECT a, sum(count(*)) OVER (PARTITION BY a ORDER BY a) AS s FROM t GROUP BY ROLLUP (a) HAVING count(*) > 0",
    "FROM t |> WHERE a > 0 |> SELECT a",
    "SELECT a FROM t UNION ALL SELECT 2 EXCEPT SELECT 3",
    "VALUES (1, 'x')",
    r"SELECT 'it\'s' AS q, 'a''b' AS r, `a` FROM `t`",
]


@pytest.fixture
def table(spark):
    spark.udf.register("mine", lambda x: x)
    spark.range(1).createOrReplaceGlobalTempView("g")
    spark.range(1).createOrReplaceTempView("elsewhere")
    return {"t": spark.createDataFrame([(1,)], "a int")}


@pytest.mark.parametrize("text", BAD)
def test_what_does_more_than_read_is_rejected(spark, table, text):
    with pytest.raises(OpError, match="not_read_only"):
        sql_.execute_sql(spark, text, table)


@pytest.mark.parametrize("text", HIDDEN)
def test_other_tables_cannot_be_read(spark, table, text):
    with pytest.raises(OpError, match="table_or_view_not_found"):
        sql_.execute_sql(spark, text, table)


@pytest.mark.parametrize("text", GOOD)
def test_what_only_reads_is_run(spark, table, text):
    assert sql_.execute_sql(spark, text, table).count() >= 1


def test_faults_of_grammar_are_told_as_such(spark, table):
    with pytest.raises(ParseException):
        sql_.execute_sql(spark, "SELECT 1 + FROM (", table)


def test_inputs_are_those_of_the_plan(spark):
    text = "WITH c AS (SELECT * FROM b) SELECT 'd', (SELECT 1 FROM E) FROM c, a -- f"
    assert sql_.inputs_of(text, ["a", "b", "c", "d", "e", "f"]) == ["a", "b", "e"]
