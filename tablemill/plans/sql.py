"""Read-only SQL over named tables, bounded in rows and time, and facts about many SQL texts."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping

from py4j.java_gateway import is_instance_of
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.functions.names import col, quoted

#: Limits of a result: rows, bytes of all cells and of one.
MOST_ROWS, MOST_BYTES, MOST_CELL = 100_000, 64 << 20, 4 << 20
ON_FILES = "spark.sql.runSQLOnFiles"
LOCK = threading.Lock()


#: Parts of a query's plan, as Spark names them, that only read.
READING = {
    "Project", "Filter", "Aggregate", "Join", "LateralJoin", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Tail", "Distinct", "Union", "Intersect", "Except",
    "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedRelation", "UnresolvedWith", "UnresolvedInlineTable", "UnresolvedHaving", "UnresolvedHint",
    "WithWindowDefinition", "Generate", "LocalRelation", "OneRowRelation", "OneRowRelation$", "Pivot", "Unpivot", "Sample", "PipeOperator", "UnresolvedTableValuedFunction",
}
#: Of the built-in functions those that run other code than Spark's, and the generators and tables that make rows of their arguments alone.
RUNS_CODE = {"java_method", "reflect", "try_reflect"}
MAKES_ROWS = {"explode", "explode_outer", "inline", "inline_outer", "json_tuple", "posexplode", "posexplode_outer", "range", "stack", "variant_explode", "variant_explode_outer"}
PACKAGE = "org.apache.spark.sql.catalyst."


def _each(values) -> Iterator:
    """The elements of a Scala collection."""
    found = values.iterator()
    while found.hasNext():
        yield found.next()


class Parsed:
    """A text as Spark parses it, before it knows any table: the parts of its plan, the tables and the functions it names."""

    def __init__(self, spark: SparkSession, text: str):
        session, gateway = spark._jsparkSession, spark.sparkContext._gateway
        is_a = lambda x, name: is_instance_of(gateway, x, PACKAGE + name)
        plan = session.sessionState().sqlParser().parsePlan(text)
        self.nodes, self.relations, self.functions, self.tables_of, self.ctes = set(), [], [], [], set()
        self.computed_names = False
        left = [plan.logicalPlan() if plan.getClass().getSimpleName() == "ExplainCommand" else plan]
        while left:
            x = left.pop()
            kind, inner = x.getClass().getSimpleName(), is_a(x, "plans.QueryPlan")
            left += _each(x.children())
            self.computed_names |= "UnresolvedIdentifier" in kind
            if inner:
                self.nodes.add(kind)
                left += [*_each(x.expressions()), *_each(x.innerChildren())]
            elif is_a(x, "expressions.PlanExpression"):
                left.append(x.plan())
            match kind:
                case "UnresolvedRelation":
                    self.relations.append([str(n) for n in _each(x.multipartIdentifier())])
                case "UnresolvedWith":
                    self.ctes |= {str(r._1()).casefold() for r in _each(x.cteRelations())}
                case "WithWindowDefinition":
                    left += _each(x.windowDefinitions().values())
                case "UnresolvedFunction":
                    self.functions.append([str(n) for n in _each(x.nameParts())])
                case "UnresolvedTableValuedFunction":
                    self.tables_of.append([str(n) for n in _each(x.name())])
                case "UnresolvedGenerator":
                    self.tables_of.append([str(x.name().funcName())])


def parsed(sql: str, spark: SparkSession | None = None) -> Parsed:
    """The text parsed; several statements are an error of ours, other faults of grammar are Spark's."""
    spark = spark or SparkSession.active()
    try:
        return Parsed(spark, sql)
    except ParseException:
        for at in (i for i, c in enumerate(sql) if c == ";"):
            try:
                Parsed(spark, sql[:at])
            except ParseException:
                continue
            raise OpError("not_read_only", "one statement at a time") from None
        raise


def check_read_only(sql: str, tables: Iterable[str] | None = None) -> str:
    """The text of one query that only reads; with ``tables`` also one that reads no other tables than these.

    Spark parses the text, and what is checked is its plan, so that quoting, comments and escapes can hide nothing:
    all its parts are among those that read, all names of tables are plain ones, and all functions are built-in ones that run
    no foreign code. Names worked out from texts (IDENTIFIER) are rejected.
    """
    found = parsed(sql)
    if other := sorted(found.nodes - READING):
        raise OpError("not_read_only", f"only queries are read, not {other[0]}")
    if found.computed_names:
        raise OpError("not_read_only", "names of tables and functions are written out")
    builtin = SparkSession.active()._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.functionSet()
    allowed = {str(f.funcName()) for f in _each(builtin)} - RUNS_CODE
    for names, known in ((found.functions, allowed), (found.tables_of, MAKES_ROWS)):
        for name in names:
            if name[-1].casefold() not in known or name[:-1] not in ([], ["builtin"], ["system", "builtin"]):
                raise OpError("not_read_only", f"the function {'.'.join(name)} isn't one of those that may be called")
    own = None if tables is None else {t.casefold() for t in tables} | found.ctes
    for name in found.relations:
        if len(name) > 1 or own is not None and name[0].casefold() not in own:
            raise OpError("table_or_view_not_found", f"no table {'.'.join(name)}")
    return sql.rstrip().rstrip(";").rstrip()


def execute_sql(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The query over the given tables, by name.

    The tables are views only while Spark analyses the text, which it does at once; the result keeps
    their plans. The caller's views of the same names are put back, its other views and files can't be read. Calls
    take turns, so that two of them don't see each other's names.
    """
    text = check_read_only(sql, tables)
    with LOCK:
        files, low = spark.conf.get(ON_FILES), {n.casefold() for n in tables}
        views = {t.name: spark.table(quoted(t.name)) for t in spark.catalog.listTables() if t.isTemporary}
        try:
            spark.conf.set(ON_FILES, "false")
            for name in views:
                if name.casefold() not in low:
                    spark.catalog.dropTempView(name)
            for name, df in tables.items():
                df.createOrReplaceTempView(quoted(name))
            return spark.sql(text)
        finally:
            spark.conf.set(ON_FILES, files)
            for name in tables:
                spark.catalog.dropTempView(name)
            for name, df in views.items():
                df.createOrReplaceTempView(quoted(name))


def inputs_of(sql: str, tables: Iterable[str]) -> list[str]:
    """Those of ``tables`` that a query reads."""
    found = parsed(sql)
    named = {n[0].casefold() for n in found.relations if len(n) == 1} - found.ctes
    return [t for t in tables if t.casefold() in named]


def bounded(df: DataFrame, most: int = MOST_ROWS, most_bytes: int = MOST_BYTES, most_cell: int = MOST_CELL) -> DataFrame:
    """``df``; more rows than ``most``, or bytes in all or in one cell than they may be, are an error, never cut off."""
    sizes = [F.coalesce(F.octet_length(col(f.name) if f.dataType.typeName() == "binary" else F.to_json(F.struct(col(f.name)))), F.lit(0)) for f in df.schema.fields]
    first = df.limit(most + 1).select(F.array(*sizes).alias("s"))
    own = first.agg(F.count("*").alias("n"), F.sum(F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x)).alias("bytes"), F.max(F.array_max("s")).alias("cell")).first()
    for code, found, limit in (("too_many_rows", own.n, most), ("too_many_bytes", own.bytes or 0, most_bytes), ("cell_too_large", own.cell or 0, most_cell)):
        if found > limit:
            raise OpError(code, f"{found} is more than {limit}")
    return df


def preview(df: DataFrame, most: int) -> tuple[list, bool]:
    """The first rows, and whether there are more."""
    rows = df.limit(most + 1).collect()
    return rows[:most], len(rows) > most


def within(spark: SparkSession, seconds: float, action: Callable[[], object]):
    """What ``action`` gives; its Spark jobs are cancelled after ``seconds``, which is an error."""
    group, late = uuid.uuid4().hex, threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.setJobGroup(group, "bounded call", interruptOnCancel=True)
    timer.start()
    try:
        return action()
    except Exception:
        if late.is_set():
            raise OpError("deadline_exceeded", f"took more than {seconds} s") from None
        raise
    finally:
        timer.cancel()
        for key in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(key, None)


#: Features of a SQL text: name and the pattern counted, after literals are masked.
FEATURES = {
    "n_joins": r"(?i)\bJOIN\b", "n_selects": r"(?i)\bSELECT\b", "n_aggregates": r"(?i)\b(?:COUNT|SUM|AVG|MIN|MAX)\s*\(", "n_distinct": r"(?i)\bDISTINCT\b",
    "n_group_by": r"(?i)\bGROUP\s+BY\b", "n_order_by": r"(?i)\bORDER\s+BY\b", "n_limit": r"(?i)\bLIMIT\b", "n_set_ops": r"(?i)\b(?:UNION|INTERSECT|EXCEPT)\b", "n_case": r"(?i)\bCASE\b",
}


def profile(df: DataFrame, column: str) -> DataFrame:
    """``df`` with counts of SQL features, a skeleton with literals masked, and a difficulty of easy, medium or hard."""
    masked = F.regexp_replace(F.regexp_replace(col(column), "'(?:[^']|'')*'", "?"), r"\b\d+(?:\.\d+)?\b", "?")
    skeleton = F.trim(F.regexp_replace(F.upper(masked), r"\s+", " "))
    out = df.withColumn("skeleton", skeleton).withColumns({n: F.coalesce(F.regexp_count(F.col("skeleton"), F.lit(p)), F.lit(0)) for n, p in FEATURES.items()})
    load = F.col("n_joins") + 2 * (F.col("n_selects") - 1) + F.col("n_group_by") + 2 * F.col("n_set_ops") + F.col("n_case")
    return out.withColumn("difficulty", F.when(load <= 1, "easy").when(load <= 3, "medium").otherwise("hard"))
