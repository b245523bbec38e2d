"""Filters and projections. Every function takes a DataFrame and gives a new one, without running it."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.functions.conditions import _no_tables, condition
from tablemill.functions.names import check_unique, col, find, quoted
from tablemill.functions.typed import Builder

Tables = Callable[[object], DataFrame]
NAME = r"[A-Za-z_]\w*"
ALIAS = re.compile(rf"^(.+?)\s+AS\s+({NAME})$", re.I | re.S)
CAST = re.compile(rf"^([\w.]+)\s*::\s*({NAME})$")
#: Type names that SQL text uses, to Spark's.
DECLARED = {"integer": "bigint", "int": "bigint", "real": "double", "float": "double", "text": "string", "numeric": "double"}


def condition_filter(df: DataFrame, conditions, return_columns: list[str] | None = None, tables: Tables = _no_tables) -> DataFrame:
    """Rows for which the condition tree is true, with the named columns."""
    out = df.filter(condition(conditions, df.columns, tables)) if conditions else df
    return out.select(*(col(find(df.columns, c)) for c in return_columns)) if return_columns else out


def filter_rows(df: DataFrame, conditions: Mapping) -> DataFrame:
    """Rows for which the typed predicate is true; bags stay bags."""
    return df.filter(Builder(df).predicate(conditions))


def with_quoted_names(expression: str, columns: list[str]) -> str:
    """SQL text in which dotted column names, and suffixes that mean one column, are quoted; literals stay."""
    known = {c.casefold(): c for c in columns}
    bases: dict[str, list[str]] = {}
    for c in columns:
        bases.setdefault(c.rpartition(".")[2].rpartition("__")[2].casefold(), []).append(c)
    known = {b: cs[0] for b, cs in bases.items() if len(cs) == 1} | known
    word = re.compile("(?<![\\w.`\"])(?:" + "|".join(map(re.escape, sorted(known, key=len, reverse=True))) + ")(?![\\w.`\"(])", re.I)
    parts = re.split(r"('(?:[^'\\]|''|\\.)*'|`[^`]*`)", expression)
    return "".join(p if i % 2 else word.sub(lambda m: quoted(known[m[0].casefold()]), p) for i, p in enumerate(parts))


def output(df: DataFrame, text: str | Mapping) -> Column:
    """One projected column: a name, ``expr AS name``, ``col::type AS name``, or a typed date operation."""
    if isinstance(text, Mapping):
        args = [{"column": find(df.columns, o["column"])} if "column" in o else {"op": "cast", "to": "DATETIME", "args": [{"value": o["value"]}]} for o in text["operands"]]
        return Builder(df).expression({"op": text["op"], "args": args}).column.alias(text["as"])
    body = text.strip()
    if body in df.columns:
        return col(body)
    named = ALIAS.match(body)
    body, name = (named[1].strip(), named[2]) if named else (body, None)
    cast = CAST.match(body)
    if cast:
        source = find(df.columns, cast[1])
        return col(source).cast(DECLARED.get(cast[2].lower(), cast[2])).alias(name or source)
    if re.fullmatch(r"[\w.]+", body) and not body[0].isdigit() or body in df.columns:
        source = find(df.columns, body)
        return col(source).alias(name or source)
    own = F.expr(with_quoted_names(body, df.columns))
    return own.alias(name) if name else own


def project(df: DataFrame, expressions: list[str | Mapping] | None, distinct: bool = False) -> DataFrame:
    """SQL projections, or all columns; ``distinct`` drops repeated rows."""
    out = df.select(*(output(df, e) for e in expressions)) if expressions else df
    check_unique(out.columns)
    return out.distinct() if distinct else out


def project_typed(df: DataFrame, outputs: list[Mapping]) -> DataFrame:
    """Typed outputs ``{"expression", "as"}``; a computed one must be named."""
    build, columns = Builder(df), []
    for i, item in enumerate(outputs):
        name = item.get("as") or item["expression"].get("column")
        if not name or name.startswith("__"):
            raise OpError("missing_alias", "a computed output needs a name that doesn't start with __", f"outputs[{i}]")
        columns.append(build.expression(item["expression"], f"outputs[{i}]").column.alias(name))
    out = df.select(*columns)
    check_unique(out.columns)
    return out


def shape_rows(df: DataFrame, outputs: list[Mapping], distinct: bool = False) -> DataFrame:
    """Columns ``{"column", "as"?}`` in the given order."""
    check_unique([o.get("as", o["column"]) for o in outputs])
    out = df.select(*(col(find(df.columns, o["column"])).alias(o.get("as", o["column"])) for o in outputs))
    return out.distinct() if distinct else out


def derive_column(df: DataFrame, new_column: str, expression: str) -> DataFrame:
    """``df`` with one computed column more."""
    check_unique([*df.columns, new_column])
    return df.withColumn(new_column, F.expr(with_quoted_names(expression, df.columns)))


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()
