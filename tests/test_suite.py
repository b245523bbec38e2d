"""Suites of changed databases, against answers worked out in plain Python."""

import pytest
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.operators import suite


@pytest.fixture(scope="module")
def tables(spark):
    sales = spark.createDataFrame([(i, f"shop{i % 3}", float(i % 7)) for i in range(60)] + [(None, "shop0", 1.0), (60, None, None)], "id long, shop string, price double")
    return {"sales": sales, "shops": spark.createDataFrame([(f"shop{i}", i * 10) for i in range(3)], "name string, rent int")}


def count(db):
    return db["sales"].groupBy("shop").agg(F.count("*").alias("n"))


def suite_of(spark, tables, way, **more):
    own = suite.variants(tables, {"sales": "id", "shops": "name"}, {"sales": ["price"]}, "x")
    return suite.outcomes(spark, way, more.get("gold", count), tables, own)


def test_an_equal_way_passes_and_informs(spark, tables):
    found = suite_of(spark, tables, lambda db: db["sales"].selectExpr("coalesce(shop, 'none') AS s", "shop").groupBy("s", "shop").count().select("shop", "count"))
    rows = {r.database: (r.equal, r.informative, r.error) for r in found.collect()}
    assert all(r[0] and r[2] is None for r in rows.values()) and len(rows) == 7
    # The answer counts sales, so it changes with these alone.
    assert {n for n, r in rows.items() if r[1]} == {"fewer sales", "repeated sales", "empty sales"}
    assert suite.verdict(found, 3).first().asDict() == {"passed": True, "reason": "passed", "databases": 7, "informative": 3, "failures": 0, "errors": 0}
    assert suite.verdict(found, 4).first().reason == "insufficient_informative_databases"


def test_ways_that_agree_on_the_given_database_alone_are_found(spark, tables):
    fixed = count(tables).collect()
    constant = lambda db: spark.createDataFrame(fixed, "shop string, n long")
    wrong = {r.database for r in suite_of(spark, tables, constant).collect() if not r.equal}
    assert wrong == {"fewer sales", "repeated sales", "empty sales"}
    distinct = lambda db: count({"sales": db["sales"].distinct()})
    assert {r.database for r in suite_of(spark, tables, distinct).collect() if not r.equal} == {"repeated sales"}
    filled = lambda db: db["sales"].groupBy("shop").agg((F.count("price") + F.sum(F.expr("CAST(shop IS NULL AS INT)"))).alias("n"))
    assert {r.database for r in suite_of(spark, tables, filled).collect() if not r.equal} == {"blank sales.price"}


def test_errors_and_widths(spark, tables):
    divided = lambda db: count(db).select("shop", (F.col("n") + F.lit(0) / db["shops"].count() * 0).cast("long").alias("n"))
    rows = {r.database: r for r in suite_of(spark, tables, divided).collect()}
    assert rows["empty shops"].error == "DIVIDE_BY_ZERO" and not rows["empty shops"].equal and rows["fewer sales"].equal
    missing = suite_of(spark, tables, lambda db: db["sales"].select("nowhere"))
    assert missing.filter("error IS NOT NULL AND informative").count() == 7
    assert suite.verdict(missing).first().asDict() == {"passed": False, "reason": "counterexample_found", "databases": 7, "informative": 7, "failures": 7, "errors": 7}
    assert suite_of(spark, tables, lambda db: count(db).select("shop")).filter("equal OR error IS NOT NULL").count() == 0
    with pytest.raises(OpError):
        suite.outcomes(spark, count, count, tables, {"other": {**tables, "shops": tables["shops"].drop("rent")}})
    empty = suite.outcomes(spark, count, count, tables, {})
    assert suite.verdict(empty).first().reason == "empty_suite"
    with pytest.raises(OpError):
        suite.verdict(empty, 0)


def test_rows_are_drawn_by_key(spark, tables):
    kept = suite.fewer(tables["sales"], "ID", "x").collect()
    assert 15 < len(kept) < 45 and suite.fewer(tables["sales"].repartition(7), "id", "x").count() == len(kept)
    nulls = suite.blanked(tables["sales"], "price", "id", "x")
    assert nulls.columns == ["id", "shop", "price"] and {r.id for r in nulls.filter("price IS NULL").collect()} >= {r.id for r in kept}
    assert suite.fewer(tables["sales"], "id", share=1.0).count() == 62 and suite.fewer(tables["sales"], "id", share=0.0).count() == 0
