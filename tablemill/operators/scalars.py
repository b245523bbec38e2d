"""Arithmetic on single values."""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.functions.conditions import one_cell
from tablemill.functions.typed import Builder

MANY = {"add", "subtract", "multiply"}
PAIR = {"divide", "percent", "percent_change", "date_diff_days"}


def _number(value):
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise OpError("invalid_operand", f"{value!r} is no finite number")
    return value


def _moment(value) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    try:
        return dt.datetime.fromisoformat(str(value).strip().replace("Z", "+00:00"))
    except ValueError:
        raise OpError("invalid_operand", f"{value!r} is no ISO date or time") from None


def compute(operation: str, operands: list):
    """The value of an operation on Python values."""
    if operation not in MANY | PAIR:
        raise OpError("unsupported_operator", f"no operation {operation!r}")
    if len(operands) < 2 or operation in PAIR and len(operands) > 2:
        raise OpError("invalid_arity", f"{operation} of {len(operands)} operands")
    if any(v is None for v in operands):
        raise OpError("null_scalar", "operands can't be null")
    if operation == "date_diff_days":
        start, end = map(_moment, operands)
        return (end - start).total_seconds() / 86400
    first, *rest = map(_number, operands)
    if operation == "add":
        return sum(rest, first)
    if operation == "subtract":
        return first - sum(rest)
    if operation == "multiply":
        return math.prod(rest, start=first)
    if rest[0] == 0:
        raise OpError("divide_by_zero", f"{operation} by zero")
    # 100 comes before the division, so that results equal part * 100 / whole to the last bit.
    return {"divide": lambda: first / rest[0], "percent": lambda: first * 100 / rest[0], "percent_change": lambda: (first - rest[0]) / rest[0] * 100}[operation]()


def scalar_compute(spark: SparkSession, operation: str, operands: list, result_name: str = "value") -> DataFrame:
    """A table of one cell. An operand is a value, or a one-cell DataFrame, which stays a subquery of the result."""
    if not re.fullmatch(r"[A-Za-z_]\w*", result_name):
        raise OpError("invalid_name", f"{result_name!r} is no identifier")
    operation = operation.strip().lower()
    if not any(isinstance(o, DataFrame) for o in operands):
        return spark.range(1).select(F.lit(compute(operation, operands)).alias(result_name))
    if operation not in MANY | PAIR - {"date_diff_days"} or len(operands) < 2 or operation in PAIR and len(operands) > 2:
        raise OpError("invalid_arity", f"{operation} of {len(operands)} operands")
    own = [one_cell(o) if isinstance(o, DataFrame) else F.lit(_number(o)) for o in operands]
    out = own[0]
    for other in own[1:]:
        if operation == "add":
            out = out + other
        elif operation == "subtract":
            out = out - other
        elif operation == "multiply":
            out = out * other
        elif operation == "percent_change":
            out = (out - other) / other.cast("double") * 100
        else:
            out = (out * 100 if operation == "percent" else out) / other.cast("double")
    return spark.range(1).select(out.alias(result_name))


def scalar_compute_typed(df: DataFrame, outputs: list[Mapping]) -> DataFrame:
    """Outputs ``{"op", "left", "right", "as", "multiplier"?, "round_digits"?}`` on a table of exactly one row."""
    build = Builder(df)
    one = df.limit(2).agg(F.when(F.count("*") == 1, True).otherwise(F.raise_error(F.lit("needs exactly one row"))).alias("ok")).scalar()
    columns = []
    for i, o in enumerate(outputs):
        out = build.expression({"op": o["op"], "args": [o["left"], o["right"]]}, f"outputs[{i}]").column
        if o.get("multiplier") is not None:
            out = out * F.lit(_number(o["multiplier"]))
        if (digits := o.get("round_digits")) is not None:
            if not 0 <= digits <= 10:
                raise OpError("invalid_operand", "round_digits is 0 to 10", f"outputs[{i}]")
            out = F.round(out.cast("double"), digits)
        columns.append(out.alias(o["as"]))
    return df.filter(one).select(*columns)
