"""Grouping sets, cubes and rollups, with sketches that are merged up the levels.

Rows are read once, for the finest level. Each coarser level is made of the smallest level already there that has its keys:
sums and counts add up, extremes are compared, and distinct counts and quantiles are kept as sketches (HyperLogLog, KLL) in
columns, which merge without going back to rows. So a level costs what the level below it has groups.

Edge cases: null keys are keys of their own, told apart from keys that a level leaves out by ``grouping_id``, whose bits
stand for the keys from the first on and are set where one is left out; null values are left out; a group without values has sum, extremes, mean and quantile null
and counts 0; an empty table has no groups, and 0 counts on the level without keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.functions.names import check_unique, col, find
from tablemill.shared import written

#: Sizes of sketches: 2 ** 12 registers (an error of about 1.6 %), and 400 items a level (about 0.7 % of the rank).
REGISTERS, ITEMS = 12, 400

#: How a part of a figure is made of rows, and of parts.
PARTS = {
    "sum": (F.sum, F.sum), "count": (F.count, F.sum), "min": (F.min, F.min), "max": (F.max, F.max),
    "hll": (lambda c: F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), F.lit(REGISTERS)), F.hll_union_agg),
    "kll": (lambda c: F.kll_sketch_agg_double(c.cast("double"), F.lit(ITEMS)), F.kll_merge_agg_double),
}
NEEDS = {"sum": ("sum",), "count": ("count",), "min": ("min",), "max": ("max",), "avg": ("sum", "count"), "distinct": ("hll", "count"), "quantile": ("kll", "count")}


def rollup(by: Sequence[str]) -> list[tuple[str, ...]]:
    return [tuple(by[:n]) for n in range(len(by), -1, -1)]


def cube(by: Sequence[str]) -> list[tuple[str, ...]]:
    return [c for n in range(len(by), -1, -1) for c in combinations(by, n)]


def _figure(name: str, item: Mapping) -> Column:
    part = lambda kind: F.col(f"__{name}_{kind}")
    op = item["op"]
    if op == "avg":
        return F.when(part("count") > 0, part("sum") / part("count"))
    if op == "distinct":
        return F.when(part("count") > 0, F.hll_sketch_estimate(part("hll"))).otherwise(0)
    if op == "quantile":
        return F.when(part("count") > 0, F.kll_sketch_get_quantile_double(part("kll"), F.lit(float(item["at"]))))
    return F.coalesce(part("count"), F.lit(0)) if op == "count" else part(op)


def grouping_sets(df: DataFrame, by: Sequence[str], sets: Sequence[Sequence[str]], figures: Mapping[str, Mapping]) -> DataFrame:
    """(by…, grouping_id, figures…) of each set of keys; figures are {name: {"op", "column", "at"?}}.

    Operations: sum, count, min, max, avg, distinct (estimated) and quantile (estimated, ``at`` a share of the rows).
    """
    keys = [find(df.columns, b) for b in by]
    check_unique([*keys, "grouping_id", *figures])
    wanted = [tuple(find(df.columns, k) for k in s) for s in sets]
    if bad := [k for s in wanted for k in s if k not in keys]:
        raise OpError("invalid_argument", f"{bad[0]} is no key of any level")
    makes = []
    for name, item in figures.items():
        if item["op"] not in NEEDS or item["op"] == "quantile" and not 0 <= item.get("at", -1) <= 1:
            raise OpError("unsupported_aggregate", f"no {item['op']} by levels")
        column = F.lit(1) if item.get("column", "*") == "*" else col(find(df.columns, item["column"]))
        makes += [(f"__{name}_{kind}", kind, column) for kind in NEEDS[item["op"]]]
    levels = {tuple(keys): written(df.groupBy(*map(col, keys)).agg(*(PARTS[kind][0](c).alias(n) for n, kind, c in makes)), "finest-level")}
    for own in sorted(set(wanted), key=len, reverse=True):
        if own in levels:
            continue
        below = min((s for s in levels if set(own) <= set(s)), key=len)
        merged = levels[below].groupBy(*map(col, own)).agg(*(PARTS[kind][1](n).alias(n) for n, kind, _ in makes))
        levels[own] = written(merged, "coarser-level")
    out = None
    for own in wanted:
        left_out = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in own)
        columns = [col(k) if k in own else F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys]
        level = levels[own].select(*columns, F.lit(left_out).alias("grouping_id"), *(_figure(n, item).alias(n) for n, item in figures.items()))
        out = level if out is None else out.unionByName(level)
    return out
