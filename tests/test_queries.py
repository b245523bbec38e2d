"""Every query that has SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = __spark_entry__.oracle_sql()
PLAIN = [n for n in SQL if not (n.startswith("op") and n[2].isdigit())]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


def bag(rows):
    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the test tables")
@pytest.mark.parametrize("name", PLAIN)
def test_matches_sql(spark, duck, name):
    found = __spark_entry__.queries()[name](spark, ROOT)
    names = sorted(found.columns)
    expected = duck.sql(SQL[name])
    assert names == sorted(expected.columns)
    quoted = ", ".join(f'"{n}"' for n in names)
    assert bag(found.select(*(f"`{n}`" for n in names)).collect()) == bag(duck.sql(f"SELECT {quoted} FROM expected").fetchall())


def test_every_query_but_some_has_sql():
    without = {n for n in __spark_entry__.queries() if n not in SQL}
    assert {n for n in without if not n.startswith(("op", "pipeline"))} == {"search_values_fuzzy", "bootstrap_ci", "bootstrap_cluster_ci", "semantic_match", "greedy_cover"}


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
