"""Ranking, ordering and limits.

``sort`` gives its rows in order but numbers none: a global number needs one task, and is
asked for by ``limit`` with an offset alone.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.functions import types as K
from tablemill.functions.names import check_unique, col, find

RANKS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}
WINDOWS = RANKS | {"percent_rank": F.percent_rank, "cume_dist": F.cume_dist}


def text_key(df: DataFrame, item: str) -> Column:
    """``column``, ``column ASC`` or ``column DESC``; nulls first upwards and last downwards."""
    name, _, way = item.rpartition(" ")
    if name and way.upper() in ("ASC", "DESC"):
        own = col(find(df.columns, name))
        return own.desc() if way.upper() == "DESC" else own.asc()
    return col(find(df.columns, item)).asc()


def typed_key(df: DataFrame, key: Mapping) -> Column:
    """``{"column", "direction"?, "nulls"?}``; nulls last either way unless asked for."""
    name = find(df.columns, key["column"])
    if K.of_spark(df.schema[name].dataType) == "BLOB":
        raise OpError("type_mismatch", "BLOB has no order")
    down, first = key.get("direction", "asc") == "desc", key.get("nulls", "last") == "first"
    own = col(name)
    return (own.desc_nulls_first() if first else own.desc_nulls_last()) if down else (own.asc_nulls_first() if first else own.asc_nulls_last())


def _ties(df: DataFrame) -> list[Column]:
    """All columns that have an order, so that equal keys come in one order always."""
    out = []
    for f in df.schema.fields:
        try:
            if K.of_spark(f.dataType) != "BLOB":
                out.append(col(f.name).asc_nulls_last())
        except OpError:
            continue
    return out


def window(df: DataFrame, partition_by: list[str], order_by: list[str], fn: str, as_: str) -> DataFrame:
    """``df`` with a ranking function; without ``partition_by`` all rows go through one task, as a global rank must."""
    if fn not in WINDOWS:
        raise OpError("unsupported_window", f"no window function {fn!r}")
    check_unique([*df.columns, as_])
    over = Window.partitionBy(*(col(find(df.columns, c)) for c in partition_by)).orderBy(*(text_key(df, o) for o in order_by))
    return df.withColumn(as_, WINDOWS[fn]().over(over))


def add_rank(df: DataFrame, order_by: list[Mapping], method: str, as_: str, partition_by: list[str] | None = None) -> DataFrame:
    """row_number (ties broken by all columns), rank or dense_rank."""
    if method not in RANKS:
        raise OpError("unsupported_window", f"no rank {method!r}")
    check_unique([*df.columns, as_])
    keys = [typed_key(df, k) for k in order_by] + (_ties(df) if method == "row_number" else [])
    over = Window.partitionBy(*(col(find(df.columns, c)) for c in partition_by or [])).orderBy(*keys)
    return df.withColumn(as_, RANKS[method]().over(over).cast("long"))


def sort(df: DataFrame, keys: list[Mapping]) -> DataFrame:
    return df.orderBy(*(typed_key(df, k) for k in keys), *_ties(df))


def limit(df: DataFrame, keys: list[Mapping], count: int, offset: int = 0) -> DataFrame:
    """``count`` rows of the order after ``offset``; each task keeps ``count + offset`` rows at most."""
    if not keys:
        raise OpError("unordered_input", "a limit needs an order")
    out = sort(df, keys).limit(count + offset)
    return out.offset(offset) if offset else out


def rank_select(df: DataFrame, order_by: list[Mapping], top_k: int, outputs: list[str], with_ties: bool = False) -> DataFrame:
    """The first ``top_k`` rows, or with ties all rows of the first ``top_k`` ranks."""
    kept = [col(find(df.columns, c)) for c in outputs]
    if not with_ties:
        return sort(df, order_by).limit(top_k).select(*kept)
    # The last key among the first rows is found by a plain top-k, so that no task ranks all rows.
    names = [find(df.columns, k["column"]) for k in order_by]
    firsts = sort(df, order_by).limit(top_k).select(*map(col, names)).distinct()
    same = firsts.select(*(col(n).alias(f"__k{i}") for i, n in enumerate(names)))
    on = [col(n).eqNullSafe(F.col(f"__k{i}")) for i, n in enumerate(names)]
    return df.join(same, on, "left_semi").orderBy(*(typed_key(df, k) for k in order_by)).select(*kept)


def extreme_value_select(df: DataFrame, order_by: list[str], top_k: int | None = None, return_columns: list[str] | None = None) -> DataFrame:
    """Rows in order, the first ``top_k`` of them; the order's columns need not be returned."""
    out = df.orderBy(*(text_key(df, o) for o in order_by)) if order_by else df
    out = out if top_k is None else out.limit(int(top_k))
    return out.select(*(col(find(df.columns, c)) for c in return_columns)) if return_columns else out
