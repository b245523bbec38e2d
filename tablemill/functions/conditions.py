"""Condition trees: ``{"column", "op", "value"}`` leaves under and, or, not; a list means and.

Operators: ``= != <> > >= < <=`` with value, column_value or a one-cell DataFrame as
value_ref; ``in``/``not in`` with values or in_table; ``between`` low, high; ``like``,
``not like`` (``*`` is a wildcard too) and ``contains``, ``not contains`` without regard to
case; ``is null``, ``is not null``; ``on date``. Underscores and case in operators don't matter.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.functions.names import col, find

COMPARE = {"=": operator.eq, "==": operator.eq, "!=": operator.ne, "<>": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
SHORT = ("contains", "like", "in")


def one_cell(df: DataFrame, column: str | None = None) -> Column:
    """The value of a table of one row as a scalar subquery; more than one row is an error when it runs."""
    if column is None and len(df.columns) != 1:
        raise OpError("not_scalar", f"a value needs one column, there are {len(df.columns)}")
    name = df.columns[0] if column is None else find(df.columns, column)
    # A missing row and a null are errors, as a condition on them would silently be unknown.
    checked = df.agg(F.when(F.count("*") == 1, F.max(col(name))).otherwise(F.raise_error(F.lit("a value needs exactly one row"))).alias("v"))
    return checked.select(F.coalesce("v", F.raise_error(F.lit("a value can't be null")))).scalar()


def normal(tree):
    """Operator spellings made one, and ``{"contains": {...}}`` turned into a leaf."""
    if isinstance(tree, list):
        return {"and": [normal(x) for x in tree]}
    if not isinstance(tree, Mapping):
        raise OpError("invalid_condition", f"a condition is an object, not {tree!r}")
    if len(tree) == 1:
        (key, value), = tree.items()
        if key in ("and", "or"):
            return {key: [normal(x) for x in value]}
        if key == "not":
            return {key: normal(value)}
        if key in SHORT and isinstance(value, Mapping):
            return normal({"op": key, **value})
    return {**tree, "op": str(tree.get("op", "=")).strip().lower().replace("_", " ")}


def _not_in(own: Column, members: DataFrame) -> Column:
    """SQL's NOT IN with its unknowns, by a plain IN, which Spark may shuffle for; its own form of NOT IN broadcasts the members whatever their size."""
    some = members.agg((F.count("*") > 0).alias("some")).scalar()
    nulls = members.agg((F.count("*") > F.count("__member")).alias("nulls")).scalar()
    unknown = F.when(own.isNull() | nulls, F.lit(None).cast("boolean")).otherwise(True)
    return F.when(~some, True).when(own.isin(members), False).otherwise(unknown)


def _leaf(leaf: Mapping, columns: list[str], table: Callable[[object], DataFrame]) -> Column:
    op, name = leaf["op"], leaf.get("column")
    if name == "*" and leaf.get("value") is None:
        return F.lit(True)
    if name is None:
        raise OpError("invalid_condition", "a condition names its column")
    own = col(find(columns, name))
    plain, negative = op.removeprefix("not "), op.startswith("not ")
    if plain in ("contains", "like"):
        value = str(leaf["value"])
        found = own.cast("string").ilike(f"%{value}%" if plain == "contains" else value.replace("*", "%"))
    elif plain == "in" and "in_table" in leaf:
        other = table(leaf["in_table"])
        member = other.columns[0] if len(other.columns) == 1 else find(other.columns, name)
        if negative:
            return _not_in(own, other.select(col(member).alias("__member")))
        found = own.isin(other.select(col(member)))
    elif plain == "in":
        values = leaf.get("values", leaf.get("value", []))
        found = own.isin(list(values) if isinstance(values, (list, tuple)) else [values])
    elif op == "between":
        return own.between(leaf["low"], leaf["high"])
    elif op in ("is null", "is not null"):
        return own.isNull() if op == "is null" else own.isNotNull()
    elif op == "on date":
        return F.try_to_date(own.cast("string").substr(1, 10)) == F.to_date(F.lit(str(leaf["value"])[:10]))
    elif op in COMPARE:
        if "column_value" in leaf:
            other = col(find(columns, leaf["column_value"]))
        elif "value_ref" in leaf:
            ref = leaf["value_ref"]
            ref = ref if isinstance(ref, Mapping) else {"table": ref}
            other = one_cell(table(ref["table"]), ref.get("column"))
        else:
            other = F.lit(leaf["value"])
        return COMPARE[op](own, other)
    else:
        raise OpError("unsupported_operator", f"no operator {op!r}")
    return ~found if negative else found


def _no_tables(ref) -> DataFrame:
    if isinstance(ref, DataFrame):
        return ref
    raise OpError("unknown_table", f"no table {ref!r}")


def condition(tree, columns: list[str], table: Callable[[object], DataFrame] = _no_tables) -> Column:
    """The tree as a Column over ``columns``; ``table`` gives the DataFrame of a table named in it."""

    def build(node) -> Column:
        for key, join in (("and", operator.and_), ("or", operator.or_)):
            if key in node:
                return reduce(join, map(build, node[key])) if node[key] else F.lit(True)
        if "not" in node:
            return ~build(node["not"])
        return _leaf(node, columns, table)

    return build(normal(tree))
