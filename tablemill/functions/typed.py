"""Typed expressions and predicates: JSON trees checked against a schema and turned into Columns.

Expressions: ``{"column"}``, ``{"value"}``, or ``{"op", "args"}`` with add, subtract,
multiply, divide, modulo, abs, round, lower, upper, trim, length, concat, coalesce,
extract_year, extract_month, extract_day, date_diff_days; ``cast`` with ``to``; ``case_when``
with branches and else. Predicates: comparisons (left, right), and, or (args), not (arg),
between (value, lower, upper), in, not_in (value, values), like, not_like, contains,
not_contains (value, pattern), is_null, is_not_null (value). Nothing is converted silently
but whole numbers beside REAL, and ISO text beside a date.
"""

from __future__ import annotations

import datetime as dt
import operator
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.functions import types as K
from tablemill.functions.names import col

DEPTH = 5
MOST_ARGS, MOST_VALUES = 8, 50
ANY = object()


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: str
    literal: object = ANY


def real(x: Typed) -> Column:
    return x.column.cast("double")


def strict_cast(x: Typed, to: str) -> Column:
    """A cast that fails where a value would be changed: 1.5 is no INTEGER and a time no DATE."""
    own, kind = x.column, K.SPARK[to]
    if to == "INTEGER" and x.kind == "REAL":
        return F.when(own == F.floor(own), own.cast(kind)).when(own.isNull(), None).otherwise(F.raise_error(F.lit("a fraction is no INTEGER")).cast(kind))
    if to == "DATE" and x.kind == "TEXT":
        return F.when(own.rlike(r"^\d{4}-\d\d-\d\d$"), own.cast(kind)).when(own.isNull(), None).otherwise(F.raise_error(F.lit("no ISO date")).cast(kind))
    if to == "DATE" and x.kind == "DATETIME":
        return F.when(own == F.date_trunc("day", own), own.cast(kind)).when(own.isNull(), None).otherwise(F.raise_error(F.lit("a time is no DATE")).cast(kind))
    return own.cast(kind)


def _days(start: Typed, end: Typed) -> Column:
    micros = [F.unix_micros(x.column.cast("timestamp_ntz").cast("timestamp")) for x in (start, end)]
    return (micros[1] - micros[0]) / F.lit(86_400_000_000.0)


def _same(*args: Typed) -> str:
    return reduce(K.merged, (a.kind for a in args))


#: op: (least and most arguments, allowed kinds or None, result kind, column)
FUNCTIONS: dict[str, tuple[int, int, set | None, Callable[..., str], Callable[..., Column]]] = {
    "add": (2, 2, K.NUMBERS, _same, lambda a, b: a.column + b.column),
    "subtract": (2, 2, K.NUMBERS, _same, lambda a, b: a.column - b.column),
    "multiply": (2, 2, K.NUMBERS, _same, lambda a, b: a.column * b.column),
    "divide": (2, 2, K.NUMBERS, lambda *_: "REAL", lambda a, b: real(a) / real(b)),  # zero raises, as Spark is in ANSI mode
    "modulo": (2, 2, {"INTEGER"}, lambda *_: "INTEGER", lambda a, b: a.column % b.column),
    "abs": (1, 1, K.NUMBERS, _same, lambda a: F.abs(a.column)),
    "round": (1, 2, K.NUMBERS, lambda *_: "REAL", lambda a, n=None: F.round(real(a), 0 if n is None else n.column)),
    "lower": (1, 1, {"TEXT"}, lambda *_: "TEXT", lambda a: F.lower(a.column)),
    "upper": (1, 1, {"TEXT"}, lambda *_: "TEXT", lambda a: F.upper(a.column)),
    "trim": (1, 1, {"TEXT"}, lambda *_: "TEXT", lambda a: F.trim(a.column)),
    "length": (1, 1, {"TEXT"}, lambda *_: "INTEGER", lambda a: F.length(a.column).cast("long")),
    "concat": (2, MOST_ARGS, {"TEXT"}, lambda *_: "TEXT", lambda *a: F.concat(*(x.column for x in a))),
    "coalesce": (2, MOST_ARGS, None, _same, lambda *a: F.coalesce(*(x.column for x in a))),
    "extract_year": (1, 1, K.TIMES, lambda *_: "INTEGER", lambda a: F.year(a.column).cast("long")),
    "extract_month": (1, 1, K.TIMES, lambda *_: "INTEGER", lambda a: F.month(a.column).cast("long")),
    "extract_day": (1, 1, K.TIMES, lambda *_: "INTEGER", lambda a: F.dayofmonth(a.column).cast("long")),
    "date_diff_days": (2, 2, K.TIMES, lambda *_: "REAL", _days),
}
COMPARE = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def _keys(node: Mapping, keys: set[str], path: str) -> None:
    if set(node) != keys:
        raise OpError("invalid_expression", f"needs exactly {sorted(keys)}, has {sorted(node)}", path)


class Builder:
    """Builds Columns over one DataFrame's schema."""

    def __init__(self, df: DataFrame):
        self.fields = {f.name: f.dataType for f in df.schema.fields}

    def expression(self, node, path: str = "expression", depth: int = 1) -> Typed:
        if depth > DEPTH:
            raise OpError("expression_depth_exceeded", f"trees are {DEPTH} deep at most", path)
        if not isinstance(node, Mapping):
            raise OpError("invalid_expression", "an expression is an object", path)
        if "column" in node:
            _keys(node, {"column"}, path)
            if node["column"] not in self.fields:
                raise OpError("unknown_column", f"no column {node['column']!r}", path, available_columns=list(self.fields))
            kind = K.of_spark(self.fields[node["column"]])
            return Typed(col(node["column"]).cast(K.SPARK[kind]) if kind in K.NUMBERS else col(node["column"]), kind)
        if "op" not in node:
            _keys(node, {"value"}, path)
            return Typed(F.lit(node["value"]), K.of_literal(node["value"]), node["value"])
        op = node["op"]
        if op == "case_when":
            return self._case(node, path, depth)
        if op == "cast":
            _keys(node, {"op", "args", "to"}, path)
            if node["to"] not in K.SPARK or len(node["args"]) != 1:
                raise OpError("invalid_expression", "cast takes one argument and a known type", path)
            return Typed(strict_cast(self.expression(node["args"][0], f"{path}.args[0]", depth + 1), node["to"]), node["to"])
        if op not in FUNCTIONS:
            raise OpError("unsupported_expression_operator", f"no operator {op!r}", path)
        _keys(node, {"op", "args"}, path)
        least, most, kinds, result, build = FUNCTIONS[op]
        if not isinstance(node["args"], list) or not least <= len(node["args"]) <= most:
            raise OpError("invalid_expression_arity", f"{op} takes {least} to {most} arguments", path)
        args = [self.expression(a, f"{path}.args[{i}]", depth + 1) for i, a in enumerate(node["args"])]
        if kinds:
            for i, a in enumerate(args):
                if a.kind not in kinds | {"NULL"}:
                    raise OpError("type_mismatch", f"{op} takes {sorted(kinds)}, not {a.kind}", f"{path}.args[{i}]")
        return Typed(build(*args), result(*args))

    def _case(self, node: Mapping, path: str, depth: int) -> Typed:
        _keys(node, {"op", "branches", "else"}, path)
        if not node["branches"]:
            raise OpError("invalid_expression_arity", "case_when needs a branch", path)
        other = self.expression(node["else"], f"{path}.else", depth + 1)
        whens = [(self.predicate(b["when"], f"{path}.when", depth + 1), self.expression(b["then"], f"{path}.then", depth + 1)) for b in node["branches"]]
        kind = _same(*(t for _, t in whens), other)
        cast = (lambda x: x.column.cast("double")) if kind == "REAL" else (lambda x: x.column)
        chain = F.when(whens[0][0], cast(whens[0][1]))
        for when, then in whens[1:]:
            chain = chain.when(when, cast(then))
        return Typed(chain.otherwise(cast(other)), kind)

    def _pair(self, a: Typed, b: Typed, path: str) -> tuple[Column, Column, str]:
        """Two operands of one kind; ISO text beside a date is read as one."""
        for x, y, swap in ((a, b, False), (b, a, True)):
            if x.kind in K.TIMES and y.kind == "TEXT" and isinstance(y.literal, str):
                try:
                    value = dt.datetime.fromisoformat(y.literal.replace("Z", ""))
                except ValueError:
                    raise OpError("invalid_literal", f"{y.literal!r} is no ISO date", path) from None
                if x.kind == "DATE" and len(y.literal) != 10:
                    raise OpError("invalid_literal", f"{y.literal!r} has a time", path)
                y = Typed(F.lit(value.date() if x.kind == "DATE" else value).cast(K.SPARK[x.kind]), x.kind)
                return (y.column, x.column, x.kind) if swap else (x.column, y.column, x.kind)
        return a.column, b.column, K.merged(a.kind, b.kind, path)

    def predicate(self, node, path: str = "conditions", depth: int = 1) -> Column:
        if depth > DEPTH:
            raise OpError("expression_depth_exceeded", f"trees are {DEPTH} deep at most", path)
        if not isinstance(node, Mapping):
            raise OpError("invalid_predicate", "a predicate is an object", path)
        op = node.get("op")
        value = lambda key: self.expression(node[key], f"{path}.{key}", depth + 1)
        if op in COMPARE:
            _keys(node, {"op", "left", "right"}, path)
            a, b, kind = self._pair(value("left"), value("right"), path)
            if kind in ("BOOLEAN", "BLOB") and op not in ("=", "!="):
                raise OpError("type_mismatch", f"{kind} has no order", path)
            return COMPARE[op](a, b)
        if op in ("and", "or"):
            _keys(node, {"op", "args"}, path)
            if len(node["args"]) < 2:
                raise OpError("invalid_predicate_arity", f"{op} takes two arguments at least", path)
            parts = [self.predicate(a, f"{path}.args[{i}]", depth + 1) for i, a in enumerate(node["args"])]
            return reduce(operator.and_ if op == "and" else operator.or_, parts)
        if op == "not":
            _keys(node, {"op", "arg"}, path)
            return ~self.predicate(node["arg"], f"{path}.arg", depth + 1)
        if op == "between":
            _keys(node, {"op", "value", "lower", "upper"}, path)
            own, low, kind = self._pair(value("value"), value("lower"), path)
            _, high, other = self._pair(value("value"), value("upper"), path)
            if {kind, other} & {"BOOLEAN", "BLOB"}:
                raise OpError("type_mismatch", f"between doesn't take {kind}", path)
            return own.between(low, high)
        if op in ("in", "not_in"):
            _keys(node, {"op", "value", "values"}, path)
            if not 1 <= len(node["values"]) <= MOST_VALUES or any(set(v) != {"value"} for v in node["values"]):
                raise OpError("invalid_predicate_arity", f"{op} takes 1 to {MOST_VALUES} literals", path)
            own = value("value")
            found = own.column.isin([self._pair(own, self.expression(v, path, depth + 1), path)[1] for v in node["values"]])
            return ~found if op == "not_in" else found
        if op in ("like", "not_like", "contains", "not_contains"):
            _keys(node, {"op", "value", "pattern"}, path)
            own, pattern = value("value"), value("pattern")
            if {own.kind, pattern.kind} - {"TEXT", "NULL"}:
                raise OpError("type_mismatch", f"{op} takes TEXT", path)
            if op.endswith("like"):
                found = F.call_function("like", F.lower(own.column), F.lower(pattern.column))
            else:
                found = F.contains(own.column, pattern.column)
            return ~found if op.startswith("not_") else found
        if op in ("is_null", "is_not_null"):
            _keys(node, {"op", "value"}, path)
            own = value("value").column
            return own.isNull() if op == "is_null" else own.isNotNull()
        raise OpError("unsupported_predicate_operator", f"no predicate {op!r}", path)


def columns_of(tree) -> list[str]:
    """The columns that an expression or predicate reads, in order and once."""
    found: dict[str, None] = {}

    def visit(node) -> None:
        if isinstance(node, Mapping):
            if isinstance(node.get("column"), str):
                found[node["column"]] = None
            for v in node.values():
                visit(v)
        elif isinstance(node, list):
            for v in node:
                visit(v)

    visit(tree)
    return list(found)
