"""Set operations by position; nulls equal each other."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablemill.errors import OpError
from tablemill.functions import types as K
from tablemill.functions.names import col, find

OPS = ("union", "union_all", "intersect", "except")


def _combined(left: DataFrame, right: DataFrame, op: str) -> DataFrame:
    if op == "union":
        return left.union(right).distinct()
    if op == "union_all":
        return left.union(right)
    return left.intersect(right) if op == "intersect" else left.subtract(right)


def set_op(left: DataFrame, right: DataFrame, op: str) -> DataFrame:
    """By position; if the widths differ the right side's columns are chosen by the left side's names."""
    if op not in OPS:
        raise OpError("unsupported_operator", f"no set operation {op!r}")
    if len(left.columns) != len(right.columns):
        right = right.select(*(col(find(right.columns, c)) for c in left.columns))
    return set_operation(left, right, op)


def set_operation(left: DataFrame, right: DataFrame, op: str) -> DataFrame:
    """Both sides need as many columns, of types that go together; whole numbers become REAL beside REAL."""
    if op not in OPS:
        raise OpError("unsupported_operator", f"no set operation {op!r}")
    if len(left.columns) != len(right.columns):
        raise OpError("width_mismatch", f"{len(left.columns)} and {len(right.columns)} columns")
    kinds = [K.merged(K.of_spark(a.dataType), K.of_spark(b.dataType), a.name) for a, b in zip(left.schema, right.schema, strict=True)]
    typed = lambda df: df.select(*(col(c).cast(K.SPARK[k]).alias(n) for c, k, n in zip(df.columns, kinds, left.columns, strict=True)))
    return _combined(typed(left), typed(right), op)
