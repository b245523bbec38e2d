"""Joins with flat ``relation.column`` names.

Spark picks the physical join by the sizes it sees when it runs; nothing is broadcast by hand.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.functions.names import check_unique, col, find
from tablemill.shared import written

COMPARE = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
#: Inside a join the right side's columns carry this mark, so that both sides may have one name.
RIGHT = "__right__"
#: Tasks for each core that the left rows of a join with few keys are dealt to.
TASKS = 16
#: Right rows of a block on average at most, and pairs of rows with one key that aren't dealt to several parts.
BLOCK, PAIRS = 256, 2**20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to tasks: a join that gives many rows for each of its rows is then work for all cores, however few files and keys there are."""
    return df.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism)


def in_blocks(left: DataFrame, right: DataFrame, equal: list[tuple[str, str]], compared: list[str]) -> DataFrame:
    """The inner join where each two columns in ``equal`` are equal, for conditions on ``compared`` left columns that leave many right rows for a left one.

    A key's left rows are dealt to parts by its share of all pairs, and its right rows to blocks, each one row with an array. A part takes a block with all its left rows in the
    order of ``compared``, then the next one; so rows beside each other have the same left row and nearly the same series of right rows, and written they take a small part of what
    they take in any other order. This order, and that no side is held whole, is what the merge join is asked for. Names of both sides differ. Counts of keys are written
    first, so that both sides are dealt alike.
    """
    n = TASKS * left.sparkSession.sparkContext.defaultParallelism
    keys = [f"__key{i}" for i in range(max(1, len(equal)))]
    by = [[col(pair[side]) for pair in equal] or [F.lit(0)] for side in (0, 1)]
    count = lambda df, own, name: df.groupBy(*(c.alias(k) for c, k in zip(own, keys, strict=True))).agg(F.count("*").alias(name))
    sizes = written(count(left, by[0], "__m").join(count(right, by[1], "__n"), keys), "sizes-of-keys")
    pairs = F.col("__m") * F.col("__n").cast("double")
    total = sizes.agg(F.sum(pairs)).first()[0] or 1.0
    parts = F.least(F.col("__m"), F.ceil(pairs / max(PAIRS, total / (4 * n))))
    sizes = sizes.select(*keys, parts.cast("int").alias("__parts"), F.ceil(F.col("__n") / BLOCK).cast("int").alias("__blocks"))

    def dealt(df: DataFrame, own: list, among: str, as_: str) -> DataFrame:
        """``df`` with its key's numbers of parts and blocks, and the row's own of one of them by its hash; without null keys."""
        hashed = [col(f.name) for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        known = df.filter(reduce(operator.and_, (c.isNotNull() for c in own)))
        named = known.withColumns(dict(zip(("__own" + k for k in keys), own, strict=True)))
        both = named.join(sizes, [F.col("__own" + k) == F.col(k) for k in keys], "left").drop(*keys).withColumnsRenamed({"__own" + k: k for k in keys})
        both = both.withColumns({c: F.coalesce(c, F.lit(1)) for c in ("__parts", "__blocks")})
        return both.withColumn(as_, F.pmod(F.xxhash64(*hashed, F.lit(0)), F.col(among)).cast("int"))

    place = [*keys, "__part"]
    one = dealt(left, by[0], "__parts", "__part").drop("__parts", "__blocks").repartition(n, *place)
    # Spark takes a sort below a join away, but not below a condition that it can't foresee.
    one = one.sortWithinPartitions(*place, *map(col, compared)).filter(F.monotonically_increasing_id() >= 0)
    blocks = dealt(right, by[1], "__blocks", "__block").groupBy(*keys, "__block", "__parts").agg(F.collect_list(F.struct(*map(col, right.columns))).alias("__rows"))
    each = blocks.select(*(F.col(k).alias(RIGHT + k) for k in keys), "__rows", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias(RIGHT + "__part"))
    met = each.repartition(n, *(RIGHT + k for k in place)).hint("merge").join(one, [F.col(RIGHT + k) == F.col(k) for k in place])
    return met.select(*map(col, left.columns), F.inline("__rows"))


def namespaced(df: DataFrame, role: str) -> DataFrame:
    """``role.column`` for every column that has no namespace yet."""
    names = [c if "." in c else f"{role}.{c}" for c in df.columns]
    check_unique(names)
    return df.select(*(col(c).alias(n) for c, n in zip(df.columns, names, strict=True)))


def _on(left: DataFrame, right: DataFrame, edges: list[Mapping], ops: bool = False):
    """The edges as one condition on ``left`` and the marked ``right``."""
    parts = []
    for i, edge in enumerate(edges):
        if set(edge) - {"left", "right", "op"} or not {"left", "right"} <= set(edge) or ("op" in edge and not ops):
            raise OpError("invalid_edge", "an edge has left and right" + " and op" * ops, f"on[{i}]")
        op = edge.get("op", "=")
        if op not in COMPARE:
            raise OpError("unsupported_operator", f"no comparison {op!r}", f"on[{i}]")
        a, b = find(left.columns, edge["left"]), find(right.columns, edge["right"])
        parts.append(COMPARE[op](col(a), col(RIGHT + b)))
    return reduce(operator.and_, parts)


def _marked(df: DataFrame) -> DataFrame:
    return df.select(*(col(c).alias(RIGHT + c) for c in df.columns))


def join_pair(left: DataFrame, right: DataFrame, edges: list[Mapping], how: str = "inner", role: str | None = None, ops: bool = False) -> DataFrame:
    """One join. ``how``: inner, left, right, full, cross, semi or anti; ``ops`` allows edges to compare otherwise than by ``=``; inner joins then work in blocks.

    Null keys match nothing: a left row with one is kept by left, full and anti joins, a right one by right and full joins.
    """
    if how not in ("inner", "left", "right", "full", "cross", "semi", "anti"):
        raise OpError("unsupported_join", f"no join {how!r}")
    if (how == "cross") == bool(edges):
        raise OpError("invalid_edge", "a cross join has no edges and every other join has some")
    marked = _marked(right)
    if how in ("semi", "anti"):
        return left.join(marked, _on(left, right, edges, ops), f"left_{how}")
    names = [c if "." in c or role is None else f"{role}.{c}" for c in right.columns]
    check_unique([*left.columns, *names])
    if how == "inner" and any(e.get("op", "=") != "=" for e in edges):
        _on(left, right, edges, ops)  # what is wrong with an edge
        named = [(find(left.columns, e["left"]), RIGHT + find(right.columns, e["right"])) for e in edges if e.get("op", "=") == "="]
        others = [e for e in edges if e.get("op", "=") != "="]
        # Equal columns are the blocks' keys already; asked for again they would be keys of the join, for which Spark deals rows anew.
        both = in_blocks(left, marked, named, [find(left.columns, e["left"]) for e in others]).filter(_on(left, right, others, ops))
    else:
        both = left.crossJoin(marked) if how == "cross" else left.join(marked, _on(left, right, edges, ops), how)
    return both.select(*(col(c) for c in left.columns), *(col(RIGHT + c).alias(n) for c, n in zip(right.columns, names, strict=True)))


def join_tables(base: tuple[str, DataFrame], joins: list[Mapping], base_role: str | None = None) -> DataFrame:
    """A left-deep chain from ``base`` (name, rows): each join has name, table, on, and may have type and role.

    Output columns are ``role.column``; a relation joined twice needs distinct roles.
    """
    out = namespaced(base[1], base_role or base[0])
    for j in joins:
        out = join_pair(out, j["table"], j.get("on", []), j.get("type", "inner"), j.get("role") or j["name"], ops=True)
    return out


def join_prefixed(tables: list[DataFrame], on: list[list[Mapping]], types: list[str] | None = None, prefixes: list[str | None] | None = None) -> DataFrame:
    """The older form: ``prefix__column`` names, or without prefixes bare names of which the left one stays."""
    types = types or ["inner"] * (len(tables) - 1)
    named = lambda df, p: df.select(*(col(c).alias(f"{p}__{c}" if p else c) for c in df.columns))
    out = named(tables[0], prefixes and prefixes[0])
    for i, (table, edges, how) in enumerate(zip(tables[1:], on, types, strict=True), 1):
        right = named(table, prefixes and prefixes[i])
        pairs = [(find(out.columns, e["left"]), find(right.columns, e["right"])) for e in edges]
        marked = _marked(right)
        cond = reduce(operator.and_, (col(a) == col(RIGHT + b) for a, b in pairs)) if pairs else None
        both = out.crossJoin(marked) if cond is None else out.join(marked, cond, how)
        have = {c.casefold() for c in out.columns}
        new = [c for c in right.columns if prefixes or c.casefold() not in have]
        check_unique([*out.columns, *new])
        out = both.select(*(col(c) for c in out.columns), *(col(RIGHT + c).alias(c) for c in new))
    return out


def unmatched_count(joined: DataFrame, right_key: str) -> DataFrame:
    """How many rows of a left join had no match, as one row ``unmatched``."""
    return joined.agg(F.count_if(col(find(joined.columns, right_key)).isNull()).alias("unmatched"))
