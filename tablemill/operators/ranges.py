"""Ordered work over groups of any size, cut by ranges of the order: positions, ranks, running figures, frames, lags and as-of joins.

A plain window brings each of its groups into one task. Here rows are dealt to ranges of (group, order), so that a
group, however large, lies in as many ranges as it needs. What a range gives on its own is worked out by a plain window
over (group, range); what earlier ranges of the group add is carried over from one row for each range that a group shares
with others. A range holds the middle, the start or the end of at most two such groups, so the table of carries
has two rows a range at most and is broadcast.

Edge cases: null groups are one group; rows with equal order are told apart by where they were read, once and for
all, as they are written with it; empty tables give empty results; columns that start with two underscores are this module's own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.functions.names import col
from tablemill.shared import written

#: Rows of a range on average at most, so that a task's memory doesn't grow with the table; Spark's own number of ranges does below that.
ROWS = 500_000


def ranges_of(df: DataFrame) -> int | None:
    """How many ranges ``df`` needs, or None if Spark's number of partitions is enough."""
    n = -(-df.count() // ROWS)
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "row-ranges", n: int | None = None) -> DataFrame:
    """``df`` dealt to ranges of (by, order), ``n`` of them if given, with ``__range`` and ``__place``, a row's own number; rows of one group, even equal ones, lie in many ranges."""
    keys = [*map(col, by), *order, F.col("__place").asc()]
    rows = df.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(*([n] if n else []), *keys)
    return written(rows.withColumn("__range", F.spark_partition_id()), name)


class Ranges:
    """Rows dealt to ranges, and for each range that a group shares with others figures of that group."""

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "row-ranges"):
        self.columns, self.by, self.order = df.columns, list(by), list(order)
        n = ranges_of(df)
        self.stored = dealt(df, by, order, name, n)
        # Rows for windows: where Spark's number of partitions isn't enough, each range is a task of its own.
        self.rows = self.stored.repartitionById(n, F.col("__range")) if n else self.stored
        self.own = Window.partitionBy(*map(col, by), "__range").orderBy(*order, "__place")
        self.whole = Window.partitionBy(*map(col, by), "__range")
        self.keys = [f"__b{i}" for i in range(len(self.by))]
        over = Window.partitionBy(*self.keys).orderBy("__r")
        self.before, self.after, self.all = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing), Window.partitionBy(*self.keys)
        self.next = over

    def carries(self, figures: Sequence[Column], of: Mapping[str, Column], rows: DataFrame | None = None) -> DataFrame:
        """``figures`` of each group in each range it shares with others, and from them ``of``; two rows a range at most. ``rows`` may have columns more."""
        cells = (self.stored if rows is None else rows).groupBy(*(col(b).alias(k) for b, k in zip(self.by, self.keys, strict=True)), F.col("__range").alias("__r")).agg(*figures)
        shared = written(cells.withColumn("__n", F.count("*").over(self.all)).filter("__n > 1"), "range-carries")
        return shared.select(*self.keys, "__r", *(c.alias(n) for n, c in of.items()))

    def with_carries(self, rows: DataFrame, carries: DataFrame) -> DataFrame:
        """``rows`` with the carries of their group and range; null where the group is in one range alone."""
        same = [col(b).eqNullSafe(F.col(k)) for b, k in zip(self.by, self.keys, strict=True)]
        return rows.join(F.broadcast(carries), reduce(and_, same, F.col("__range") == F.col("__r")), "left").drop(*self.keys, "__r")

    def numbered(self) -> DataFrame:
        """The rows with ``__own``, their number in group and range, ``__m``, the rows there, ``__base``, those before, and ``__total``, the group's."""
        carries = self.carries([F.count("*").alias("__c")], {"__base": F.sum("__c").over(self.before), "__total": F.sum("__c").over(self.all)})
        rows = self.with_carries(self.rows.withColumn("__own", F.row_number().over(self.own)).withColumn("__m", F.count("*").over(self.whole)), carries)
        return rows.withColumn("__base", F.coalesce("__base", F.lit(0))).withColumn("__total", F.coalesce("__total", F.col("__m"))).withColumn("__i", F.col("__base") + F.col("__own"))

    def out(self, rows: DataFrame, *added: str) -> DataFrame:
        return rows.select(*map(col, self.columns), *map(col, added))


def places(df: DataFrame, by: Sequence[str], order: Sequence[Column], as_: str = "place") -> DataFrame:
    """``df`` with each row's place in its group's order, from 1."""
    ranges = Ranges(df, by, order)
    return ranges.out(ranges.numbered().withColumn(as_, F.col("__i")), as_)


def ntile(df: DataFrame, by: Sequence[str], order: Sequence[Column], tiles: int, as_: str = "tile") -> DataFrame:
    """``df`` with a tile from 1 to ``tiles``; the first tiles have one row more where rows don't divide."""
    if tiles < 1:
        raise OpError("invalid_argument", "there is one tile at least")
    ranges = Ranges(df, by, order)
    q, rest, i = F.expr(f"__total div {tiles}"), F.expr(f"__total % {tiles}"), F.col("__i") - 1
    rows = ranges.numbered().withColumn("__q", q).withColumn("__rest", rest).withColumn("__i", i)
    tile = F.expr("IF(__i < __rest * (__q + 1), __i div (__q + 1), __rest + (__i - __rest * (__q + 1)) div greatest(__q, 1L)) + 1")
    return ranges.out(rows.withColumn(as_, tile.cast("int")), as_)


RANKS = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist")


def rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], fn: str, values: Sequence[Column], as_: str = "rank") -> DataFrame:
    """``df`` with a ranking function; ``values`` are the ordered values themselves, whose equality makes ties."""
    if fn not in RANKS:
        raise OpError("unsupported_window", f"no rank {fn!r}")
    if fn == "row_number":
        return places(df, by, order, as_)
    ranges = Ranges(df, by, order)
    ranges.rows = ranges.rows.withColumn("__v", F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values))))
    place = F.struct(*(F.col(c) for c in ("__own", "__place")))
    # Ranks in a range, and of its first and last values how many rows they have there.
    local = Window.partitionBy(*map(col, ranges.by), "__range").orderBy(*ranges.order)
    tied = Window.partitionBy(*map(col, ranges.by), "__range", "__v")
    ranges.rows = ranges.rows.withColumn("__own", F.row_number().over(ranges.own)).withColumn("__rank", F.rank().over(local)).withColumn("__dense", F.dense_rank().over(local)).withColumn("__same", F.count("*").over(tied))
    first, last = F.min_by(F.struct("__v", "__same"), place), F.max_by(F.struct("__v", "__same", "__rank"), place)
    figures = [F.count("*").alias("__c"), F.max("__dense").alias("__d"), first.alias("__first"), last.alias("__last")]
    cells = ranges.carries(figures, {c: F.col(c) for c in ("__c", "__d", "__first", "__last")}, ranges.rows)
    on = ranges.next
    goes_on = F.coalesce(F.col("__first.__v") == F.lag("__last.__v").over(on), F.lit(False))
    cells = cells.withColumn("__on", goes_on).withColumn("__base", F.coalesce(F.sum("__c").over(ranges.before), F.lit(0))).withColumn("__total", F.sum("__c").over(ranges.all))
    # Where the run of a range's last value starts, unless the whole range goes on with a run from before.
    start = F.when(~F.col("__on") | (F.col("__d") > 1), F.col("__base") + F.col("__last.__rank"))
    cells = cells.withColumn("__start", start).withColumn("__from", F.last("__start", ignorenulls=True).over(ranges.before))
    fewer = F.when(F.col("__on"), 1).otherwise(0)
    cells = cells.withColumn("__distinct", F.coalesce(F.sum(F.col("__d") - fewer).over(ranges.before), F.lit(0)) - fewer)
    # A run that goes on: rows of it in later ranges, up to the range it ends in.
    ends = F.when(F.col("__d") > 1, F.col("__first.__same")).otherwise(F.col("__c"))
    cells = cells.withColumn("__part", F.when(F.col("__on"), ends)).withColumn("__stop", ~F.col("__on") | (F.col("__d") > 1))
    cells = cells.withColumn("__sum", F.coalesce(F.sum("__part").over(ranges.next.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)))
    ended = F.min(F.when(F.col("__stop"), F.struct("__r", "__sum"))).over(ranges.after).getField("__sum")
    later = F.coalesce(ended, F.sum("__part").over(ranges.all), F.lit(0)) - F.col("__sum")
    carries = cells.select(*ranges.keys, "__r", "__base", "__total", "__on", "__from", "__distinct", F.col("__first.__v").alias("__fv"), F.col("__last.__v").alias("__lv"), later.alias("__later"))
    rows = ranges.with_carries(ranges.rows.withColumn("__m", F.count("*").over(ranges.whole)), written(carries, "rank-carries"))
    head = F.coalesce(F.col("__on") & (F.col("__v") == F.col("__fv")), F.lit(False))
    base = F.coalesce("__base", F.lit(0))
    rank_ = F.when(head, F.col("__from")).otherwise(base + F.col("__rank"))
    total = F.coalesce("__total", F.col("__m"))
    upto_here = base + F.col("__rank") + F.col("__same") - 1 + F.when(F.coalesce(F.col("__v") == F.col("__lv"), F.lit(False)), F.col("__later")).otherwise(0)
    value = {
        "rank": rank_,
        "dense_rank": F.col("__dense") + F.coalesce("__distinct", F.lit(0)),
        "percent_rank": F.when(total > 1, (rank_ - 1) / (total - 1)).otherwise(0.0),
        "cume_dist": upto_here / total,
    }[fn]
    return ranges.out(rows.withColumn(as_, value if fn in ("percent_rank", "cume_dist") else value.cast("long")), as_)


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], figures: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``df`` with running figures up to each row: {name: (sum | count | min | max | avg, column)}; nulls are left out."""
    ranges, carried, of, rows = Ranges(df, by, order), [], {}, None
    upto = ranges.own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranges.rows
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}
    for i, (fn, column) in enumerate(figures.values()):
        for kind in ("sum", "count") if fn == "avg" else (fn,):
            if kind not in both:
                raise OpError("unsupported_window", f"no running {fn!r}")
            make, name = getattr(F, kind), f"__{kind}{i}"
            rows = rows.withColumn(name, make(col(column)).over(upto))
            carried.append(make(col(column)).alias(f"{name}c"))
            of[f"{name}c"] = {"count": F.sum}.get(kind, make)(f"{name}c").over(ranges.before)
    rows = ranges.with_carries(rows, ranges.carries(carried, of))
    for i, (name, (fn, _)) in enumerate(figures.items()):
        got = {kind: both[kind](F.col(f"__{kind}{i}"), F.col(f"__{kind}{i}c")) for kind in (("sum", "count") if fn == "avg" else (fn,))}
        rows = rows.withColumn(name, F.when(got["count"] > 0, got["sum"].cast("double") / got["count"]) if fn == "avg" else got[fn])
    return ranges.out(rows, *figures)


def _by_position(ranges: Ranges, left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """``left`` (with ``__pos``) and ``right`` (__b…, __j, …), matched by group and position."""
    same = [col(b).eqNullSafe(F.col(k)) for b, k in zip(ranges.by, ranges.keys, strict=True)]
    return left.join(right, reduce(and_, same, F.col("__pos") == F.col("__j")), how).drop(*ranges.keys, "__j")


def shifted(df: DataFrame, by: Sequence[str], order: Sequence[Column], column: str, offset: int = 1, as_: str = "before", default: object = None) -> DataFrame:
    """``df`` with the column's value ``offset`` rows before in the group's order (after, if negative); ``default`` where there is no such row.

    Only the first rows of a range look further than it, for one of the last rows of the ranges before.
    """
    k, way = abs(offset), F.lag if offset >= 0 else F.lead
    ranges = Ranges(df, by, order)
    rows = written(ranges.numbered(), "numbered-rows")
    near_end = F.col("__own") <= k if offset >= 0 else F.col("__m") - F.col("__own") < k
    more = F.col("__base") > 0 if offset >= 0 else F.col("__base") + F.col("__m") < F.col("__total")
    value = F.struct(col(column).alias("v"))  # a struct, so that a null that is found differs from nothing found
    local = rows.withColumn("__v", way(value, k).over(ranges.own)).filter(~(near_end & more)) if k else rows.withColumn("__v", value)
    if k:
        other_end = F.col("__m") - F.col("__own") < k if offset >= 0 else F.col("__own") <= k
        targets = rows.filter(other_end).select(*(col(b).alias(x) for b, x in zip(ranges.by, ranges.keys, strict=True)), F.col("__i").alias("__j"), value.alias("__v"))
        heads = _by_position(ranges, rows.filter(near_end & more).withColumn("__pos", F.col("__i") - offset), targets, "left").drop("__pos")
        local = local.unionByName(heads)
    found = F.when(F.col("__v").isNotNull(), F.col("__v.v")).otherwise(F.lit(default).cast(df.schema[column].dataType))
    return ranges.out(local.withColumn(as_, found), as_)


FRAME = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max}


def framed(df: DataFrame, by: Sequence[str], order: Sequence[Column], figures: Mapping[str, tuple[str, str]], preceding: int, following: int = 0) -> DataFrame:
    """``df`` with figures over the rows from ``preceding`` before to ``following`` after each row: {name: (sum | count | avg | min | max, column)}.

    Rows whose frame lies in their range are done there; the few at a range's ends gather their frames' rows by position.
    """
    if preceding < 0 or following < 0 or (bad := [fn for fn, _ in figures.values() if fn not in FRAME]):
        raise OpError("unsupported_window", f"no frame {preceding}, {following}" if preceding < 0 or following < 0 else f"no figure {bad[0]!r}")
    ranges = Ranges(df, by, order)
    rows = written(ranges.numbered(), "numbered-rows")
    wide, from_end = preceding + following, F.col("__m") - F.col("__own")
    early = (F.col("__own") <= preceding) & (F.col("__base") > 0)
    late = (from_end < following) & (F.col("__base") + F.col("__m") < F.col("__total"))
    frame = ranges.own.rowsBetween(-preceding, following)
    inner = rows
    for name, (fn, column) in figures.items():
        inner = inner.withColumn(name, FRAME[fn](col(column)).over(frame))
    inner = inner.filter(~(early | late))
    near = rows.filter((F.col("__own") <= wide) | (from_end < wide))
    used = sorted({c for _, c in figures.values()})
    halo = near.select(*(col(b).alias(k) for b, k in zip(ranges.by, ranges.keys, strict=True)), F.col("__i").alias("__j"), *(col(c).alias(f"__x{i}") for i, c in enumerate(used)))
    edge = rows.filter(early | late)
    low, high = F.greatest(F.col("__i") - preceding, F.lit(1)), F.least(F.col("__i") + following, F.col("__total"))
    each = _by_position(ranges, edge.select(*map(col, by), "__place", F.explode(F.sequence(low, high)).alias("__pos")), halo, "inner")
    got = each.groupBy(F.col("__place").alias("__p")).agg(*(FRAME[fn](f"__x{used.index(c)}").alias(name) for name, (fn, c) in figures.items()))
    outer = edge.join(got, F.col("__place") == F.col("__p"))
    return ranges.out(inner, *figures).unionByName(ranges.out(outer, *figures))


def adjacent(df: DataFrame, by: Sequence[str], order: Sequence[Column], column: str, as_: str = "same") -> DataFrame:
    """``df`` with whether the column is as in the row before; false in a group's first row, or where either is null."""
    before = shifted(df, by, order, column, 1, "__before")
    return before.withColumn(as_, F.coalesce(col(column) == F.col("__before"), F.lit(False))).drop("__before")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, kept: Mapping[str, str], strict: bool = False, tie: str | None = None, forward: bool = False, tolerance: Column | None = None) -> DataFrame:
    """Each row of ``left`` with columns of the latest row of ``right`` of the same group that isn't after it.

    ``kept`` names them, {column of right: new name}. ``strict`` asks for an earlier row; ``forward`` for the first one that isn't before. Of rows
    of one time the one with the largest ``tie`` counts (forward: the smallest), else the one read last. ``tolerance`` is a
    condition on the new names and left's columns, without which a match is none. Rows without a match, with a null time or a null
    group have nulls. Both tables are dealt to ranges together; the last row of earlier ranges is carried over.
    """
    names, first = [f"__k{i}" for i in range(len(by))], 1 if strict else 0
    own = left.select(*(col(b).alias(n) for b, n in zip(by, names, strict=True)), col(left_time).alias("__t"), F.lit(None).alias("__tie"), F.struct(*map(col, left.columns)).alias("__row"), F.lit(None).alias("__match"), F.lit(1 - first).alias("__side"))
    match = F.struct(*(col(c).alias(n) for c, n in kept.items()))
    other = right.filter(col(right_time).isNotNull()).select(*(col(b).alias(n) for b, n in zip(by, names, strict=True)), col(right_time).alias("__t"), (col(tie) if tie else F.lit(None)).alias("__tie"), F.lit(None).alias("__row"), match.alias("__match"), F.lit(first).alias("__side"))
    for n in names:
        other = other.filter(F.col(n).isNotNull())
    both = own.unionByName(other)
    # Up, a match comes before what it is for; down, ways are turned round, and so is each side's place among equal times.
    order = [F.col("__t").desc(), F.col("__side").asc(), F.col("__tie").desc()] if forward else [F.col("__t").asc(), F.col("__side").asc(), F.col("__tie").asc()]
    ranges = Ranges(both, names, order, "asof-ranges")
    upto = ranges.own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max_by("__match", F.struct("__n")).alias("__last")
    ranges.rows = ranges.rows.withColumn("__n", F.when(F.col("__match").isNotNull(), F.row_number().over(ranges.own)))
    carries = ranges.carries([last], {"__carry": F.last("__last", ignorenulls=True).over(ranges.before)}, ranges.rows)
    rows = ranges.with_carries(ranges.rows.withColumn("__found", F.last("__match", ignorenulls=True).over(upto)), carries)
    found = F.when(F.col("__t").isNotNull(), F.coalesce("__found", "__carry"))
    out = rows.filter("__row IS NOT NULL").select("__row.*", found.alias("__found"))
    out = out.select(*map(col, left.columns), *(F.col("__found").getField(n).alias(n) for n in kept.values()))
    if tolerance is None:
        return out
    near = out.withColumn("__near", F.coalesce(tolerance, F.lit(False)))
    return near.select(*map(col, left.columns), *(F.when(F.col("__near"), col(n)).alias(n) for n in kept.values()))
