"""Suites of changed databases: whether two ways to an answer agree on all of them, and not by chance.

Two ways may give the same answer on one database though one of them misses a DISTINCT, a join or a null. So both run over databases made from
the given one: with fewer rows, rows repeated, a table empty, values blanked. A database is informative if the right answer there
isn't the one it has on the given database, or if the ways differ; a suite passes if they agree on every database and enough of them are informative.

All databases are Spark plans over the given tables, chosen by hashes of keys, so they grow with these and reruns agree. Each database is one job
that compares sets of rows by one grouping, and gives one row.

Edge cases: a null key hashes like an empty text; a way that gives another number of columns disagrees; an error that data or a plan cause is told by its name and
counts as a disagreement, any other (a lost executor) is raised; a database with other tables, columns or types than the given one is an error; an empty suite fails.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException, NumberFormatException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.functions.names import col, find
from tablemill.operators.compare import positional

Database = Mapping[str, DataFrame]
Way = Callable[[Database], DataFrame]

DATA_ERRORS = (OpError, AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException, NumberFormatException, SparkRuntimeException)
#: Reasons of a verdict, in the order in which they are tried.
REASONS = ("empty_suite", "counterexample_found", "insufficient_informative_databases", "passed")


def _drawn(key: str, seed: str, share: float) -> Column:
    """Whether a row is in a share of all, by the first eight digits of the hash of its key."""
    return F.substring(F.md5(F.concat(F.coalesce(col(key).cast("string"), F.lit("")), F.lit(seed))), 1, 8) < f"{min(int(share * 16**8), 16**8 - 1):08x}"


def fewer(df: DataFrame, key: str, seed: str = "", share: float = 0.5) -> DataFrame:
    """The rows whose key's hash is in the lower ``share``."""
    return df.filter(_drawn(find(df.columns, key), seed, share))


def blanked(df: DataFrame, column: str, key: str, seed: str = "", share: float = 0.5) -> DataFrame:
    """``df`` with null in a column of the rows whose key's hash is in the lower ``share``."""
    name, key = find(df.columns, column), find(df.columns, key)
    return df.select(*(F.when(~_drawn(key, seed, share), col(c)).alias(c) if c == name else col(c) for c in df.columns))


def variants(tables: Database, keys: Mapping[str, str], blanks: Mapping[str, Sequence[str]] | None = None, seed: str = "") -> dict[str, Database]:
    """Databases by name: for each table of ``keys`` (table: its key) one with fewer rows, one with the rows twice and one without any, and one for each column of ``blanks``."""
    out = {}
    for name, key in keys.items():
        df = tables[name]
        changed = {f"fewer {name}": fewer(df, key, seed), f"repeated {name}": df.unionAll(df), f"empty {name}": df.limit(0)}
        changed |= {f"blank {name}.{c}": blanked(df, c, key, seed) for c in (blanks or {}).get(name, ())}
        out |= {what: {**tables, name: own} for what, own in changed.items()}
    return out


def _types(tables: Database) -> dict:
    return {n: [(f.name, f.dataType.simpleString()) for f in df.schema] for n, df in tables.items()}


def _compared(candidate: DataFrame, gold: DataFrame, before: DataFrame) -> tuple[bool, bool]:
    """(equal, changed): whether the candidate's set of rows is the right one, and whether that isn't the one before."""
    fits = len(candidate.columns) == len(gold.columns)
    sides = [(gold, 2), (before, 4), *([(candidate, 1)] if fits else [])]
    rows = None
    for df, bit in sides:
        own = positional(df).withColumn("__side", F.lit(bit))
        rows = own if rows is None else rows.unionAll(own)
    sets = rows.groupBy(*(c for c in rows.columns if c != "__side")).agg(F.bit_or("__side").alias("sides"))
    odd = sets.agg(F.count_if(F.col("sides").isin(1, 2, 5, 6)).alias("wrong"), F.count_if(F.col("sides").isin(2, 3, 4, 5)).alias("other")).first()
    return fits and odd.wrong == 0, odd.other > 0


def outcomes(spark: SparkSession, candidate: Way, gold: Way, tables: Database, databases: Mapping[str, Database]) -> DataFrame:
    """(database, equal, informative, error): how two ways to an answer compare on each database."""
    given, before, out = _types(tables), gold(tables), []
    for name, own in databases.items():
        if _types(own) != given:
            raise OpError("type_mismatch", f"the database {name} has other tables, columns or types than the given one")
        right = gold(own)
        try:
            equal, changed = _compared(candidate(own), right, before)
            out.append((name, equal, changed or not equal, None))
        except DATA_ERRORS as e:
            out.append((name, False, True, e.code if isinstance(e, OpError) else e.getCondition() or type(e).__name__))
    return spark.createDataFrame(out, "database string, equal boolean, informative boolean, error string")


def verdict(found: DataFrame, least: int = 1) -> DataFrame:
    """(passed, reason, databases, informative, failures, errors) of the outcomes; at least ``least`` databases are to be informative."""
    if least < 1:
        raise OpError("invalid_argument", "at least one database is to be informative")
    sums = found.agg(F.count("*").alias("databases"), F.count_if("informative").alias("informative"), F.count_if(~F.col("equal")).alias("failures"), F.count("error").alias("errors"))
    empty, wrong, few, fine = map(F.lit, REASONS)
    reason = F.when(F.col("databases") == 0, empty).when(F.col("failures") > 0, wrong).when(F.col("informative") < least, few).otherwise(fine)
    return sums.select((reason == REASONS[-1]).alias("passed"), reason.alias("reason"), "databases", "informative", "failures", "errors")
