"""Grouping, conditional and wide aggregates, and pivots of unique keys."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.functions import types as K
from tablemill.functions.conditions import _no_tables, condition
from tablemill.functions.names import check_unique, col, find
from tablemill.functions.typed import Builder

#: op: what it makes of a column (null rows don't count)
PLAIN: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "avg": lambda c: F.avg(c).cast("double"), "min": F.min, "max": F.max, "count": F.count,
    "count_distinct": F.count_distinct, "total": lambda c: F.coalesce(F.sum(c.cast("double")), F.lit(0.0)),
}
PLAIN["mean"] = PLAIN["avg"]
PLAIN |= {"median": F.median, "stddev": F.stddev_samp, "stddev_pop": F.stddev_pop, "variance": F.var_samp, "variance_pop": F.var_pop, "approx_distinct": F.approx_count_distinct}
DISTINCT: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum_distinct, "count": F.count_distinct, "min": F.min, "max": F.max,
    "avg": lambda c: F.sum_distinct(c) / F.count_distinct(c),
}


def _metric(df: DataFrame, item: Mapping, tables) -> Column:
    op, name, where = str(item["op"]).lower(), item.get("column", "*"), item.get("where")
    if op not in PLAIN or (name == "*" and op != "count"):
        raise OpError("unsupported_aggregate", f"no {op} of {name}")
    own = F.lit(1) if name == "*" else col(find(df.columns, name))
    return PLAIN[op](F.when(condition(where, df.columns, tables), own) if where else own).alias(item["as"])


def _passthrough(df: DataFrame, names: list[str], metrics: list[Mapping]) -> list[Column]:
    """A bare column comes from the row of the minimum or maximum if there is just one such metric, else from any row."""
    extremes = [m for m in metrics if str(m["op"]).lower() in ("min", "max")]
    if len(extremes) == 1 and not extremes[0].get("where"):
        by = F.max_by if extremes[0]["op"].lower() == "max" else F.min_by
        key = col(find(df.columns, extremes[0]["column"]))
        return [by(col(n), key).alias(n) for n in names]
    return [F.any_value(col(n)).alias(n) for n in names]


def group_aggregate(
    df: DataFrame, group_by: list[str], aggregations: list[Mapping], passthrough: list[str] | None = None, output_layout: str = "rows",
    category_values: list | None = None, output_columns: list[str] | None = None, tables=_no_tables,
) -> DataFrame:
    """Metrics ``{"op", "column", "as", "where"?}`` by group; without metrics the distinct keys.

    ``output_layout="columns"`` gives one row with a column for each of ``category_values``: a
    category that is missing counts 0 and sums to null.
    """
    keys = [find(df.columns, k) for k in group_by]
    if output_layout == "columns":
        names = output_columns or [str(v) for v in category_values or []]
        if len(keys) != 1 or len(aggregations) != 1 or not names or len(names) != len(category_values) or passthrough:
            raise OpError("invalid_layout", "columns need one key, one metric, and a name for each category")
        check_unique(names)
        is_one = [{"column": keys[0], "op": "=", "value": v} for v in category_values]
        where = aggregations[0].get("where")
        wide = [{**aggregations[0], "as": n, "where": [where, c] if where else c} for n, c in zip(names, is_one, strict=True)]
        return df.agg(*(_metric(df, m, tables) for m in wide))
    if not (keys or aggregations or passthrough):
        raise OpError("nothing_to_do", "no keys and no metrics")
    ops = {str(m["op"]).lower() for m in aggregations}
    if ops == {"distinct"}:
        return df.select(*(col(find(df.columns, m["column"])).alias(m.get("as", m["column"])) for m in aggregations)).distinct()
    if ops == {"count_distinct"} and len(aggregations) == 1 and aggregations[0].get("column", "*") == "*" and not keys and not aggregations[0].get("where"):
        return df.distinct().agg(F.count("*").alias(aggregations[0]["as"]))
    extra = _passthrough(df, [find(df.columns, p) for p in passthrough or []], aggregations)
    columns = [*extra, *(_metric(df, m, tables) for m in aggregations)]
    check_unique([*keys, *(passthrough or []), *(m["as"] for m in aggregations)])
    if not columns:
        return df.select(*map(col, keys)).distinct()
    return df.groupBy(*map(col, keys)).agg(*columns)


def aggregate_typed(df: DataFrame, group_by: list[str], metrics: list[Mapping]) -> DataFrame:
    """Typed metrics ``{"op", "column"?, "as", "distinct"?, "filter"?}``: sums and means of numbers only, no order on blobs."""
    kinds, build, out = {f.name: f.dataType for f in df.schema.fields}, Builder(df), []
    for i, m in enumerate(metrics):
        op, name = m["op"], m.get("column")
        if name is None and op != "count" or op not in DISTINCT:
            raise OpError("unsupported_aggregate", f"no {op} of {name}", f"metrics[{i}]")
        kind = K.of_spark(kinds[find(df.columns, name)]) if name else "INTEGER"
        if op in ("sum", "avg") and kind not in K.NUMBERS or op in ("min", "max") and kind in ("BLOB", "BOOLEAN"):
            raise OpError("type_mismatch", f"no {op} of {kind}", f"metrics[{i}]")
        own = col(find(df.columns, name)) if name else F.lit(1)
        if m.get("filter"):
            own = F.when(build.predicate(m["filter"]), own)
        out.append((DISTINCT if m.get("distinct") else PLAIN)[op](own).alias(m["as"]))
    check_unique([*group_by, *(m["as"] for m in metrics)])
    keys = [col(find(df.columns, k)) for k in group_by]
    return df.groupBy(*keys).agg(*out) if out else df.select(*keys).distinct()


def pivot(df: DataFrame, key_column: str, value_column: str, key_values: list, output_columns: list[str] | None = None) -> DataFrame:
    """One row with a column for each key; a key with two rows is an error when it runs."""
    key, value = find(df.columns, key_column), find(df.columns, value_column)
    names = output_columns or [str(v) for v in key_values]
    if not key_values or len(names) != len(key_values):
        raise OpError("invalid_layout", "a pivot needs keys, and as many names")
    check_unique(names)
    own = [F.when(col(key) == F.lit(v), col(value)) for v in key_values]
    twice = F.raise_error(F.lit(f"a key of {key} has two rows; group first"))
    return df.agg(*(F.when(F.count_if(col(key) == F.lit(v)) > 1, twice).otherwise(F.max(c)).alias(n) for v, c, n in zip(key_values, own, names, strict=True)))


def aggregate(df: DataFrame, column: str, op: str):
    """One value, as Python has it."""
    return df.agg(_metric(df, {"op": op, "column": column, "as": "value"}, _no_tables)).first()[0]


def having(df: DataFrame, group_by: list[str], aggregations: list[Mapping], conditions) -> DataFrame:
    """Groups that fit the conditions, which may name metrics; only asked-for columns stay."""
    out = group_aggregate(df, group_by, aggregations)
    return out.filter(condition(conditions, out.columns))
