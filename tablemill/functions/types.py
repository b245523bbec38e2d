"""The closed set of types of the typed operators, and Spark's types for them."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import types as T

from tablemill.errors import OpError

SPARK = {
    "NULL": "void", "BOOLEAN": "boolean", "INTEGER": "bigint", "REAL": "double",
    "TEXT": "string", "DATE": "date", "DATETIME": "timestamp_ntz", "BLOB": "binary",
}
NUMBERS = {"INTEGER", "REAL"}
TIMES = {"DATE", "DATETIME"}


def of_spark(kind: T.DataType) -> str:
    """The canonical type of a Spark type; nested types have none."""
    for name, kinds in (
        ("NULL", T.NullType), ("BOOLEAN", T.BooleanType), ("INTEGER", T.IntegralType), ("REAL", (T.FractionalType,)),
        ("TEXT", T.StringType), ("DATE", T.DateType), ("DATETIME", (T.TimestampType, T.TimestampNTZType)), ("BLOB", T.BinaryType),
    ):
        if isinstance(kind, kinds):
            return name
    raise OpError("unsupported_type", f"{kind.simpleString()} can't be used in an expression")


def of_declared(text: str | None) -> str:
    """The canonical type of a declared SQL type, by the words it contains."""
    words = (text or "").upper()
    if not words or "BLOB" in words:
        return "BLOB"
    if words == "DATE":
        return "DATE"
    for name, marks in (("BOOLEAN", ["BOOL"]), ("INTEGER", ["INT"]), ("TEXT", ["CHAR", "CLOB", "TEXT", "JSON"]), ("DATETIME", ["DATE", "TIME"])):
        if any(m in words for m in marks):
            return name
    return "REAL"


def of_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, float) and not math.isfinite(value):
        raise OpError("invalid_literal", "numbers must be finite")
    for name, kind in (("BOOLEAN", bool), ("INTEGER", int), ("REAL", float), ("TEXT", str), ("DATETIME", dt.datetime), ("DATE", dt.date), ("BLOB", (bytes, bytearray))):
        if isinstance(value, kind):
            return name
    raise OpError("invalid_literal", f"{type(value).__name__} is no literal")


def merged(a: str, b: str, path: str = "") -> str:
    """The type both fit: NULL fits all, and whole numbers become REAL beside REAL; nothing else changes."""
    if a == b or b == "NULL":
        return a
    if a == "NULL":
        return b
    if {a, b} == NUMBERS:
        return "REAL"
    raise OpError("type_mismatch", f"{a} and {b} don't go together", path)
