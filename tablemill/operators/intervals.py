"""Joins of points with intervals, and of intervals with intervals, as equality joins over bins of several widths.

A join on inequalities alone is a nested loop over all pairs. Here the line is cut into bins, twice as wide on each
level, and an interval is posted on the level whose bins are about as long as it is, so it is in two or three
bins at most, however long it is. A point is looked up in its one bin on each level that some interval is on; of two intervals the shorter one is also
posted on the levels of longer ones, and a pair counts on the longer one's level alone, in the bin where the overlap starts. The rest is a
sort-merge join on (group, level, bin) with the inequalities as its condition, which adaptive execution can split where a bin is hot.

The narrowest bins are as wide as the median interval unless given; this decides the cost and never the result.

Edge cases: null bounds and points, and intervals that end before they start, match nothing; a null group matches nothing;
touching ends match unless ``closed`` is false, and then intervals hold their start and not their end (an empty one holds nothing); repeated rows
each match; empty tables give empty results. Numbers, dates and timestamps can be bounds, both sides of one kind.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.functions.names import col
from tablemill.shared import written


def _number(df: DataFrame, name: str) -> Column:
    """The column on a line of numbers: days, microseconds or as it is."""
    kind = df.schema[name].dataType.typeName()
    if kind == "date":
        return F.unix_date(col(name)).cast("double")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(col(name).cast("timestamp")).cast("double")
    if kind in ("byte", "short", "integer", "long", "float", "double") or kind.startswith("decimal"):
        return col(name).cast("double")
    raise OpError("type_mismatch", f"{kind} can't be a bound of an interval")


def _bin(x: Column, level: Column, width: float) -> Column:
    return F.floor(x / (F.lit(width) * F.pow(F.lit(2.0), level))).cast("long")


def _intervals(df: DataFrame, by: Sequence[str], low: str, high: str, closed: bool, prefix: str) -> DataFrame:
    """(prefix + k0…, lo, hi, row) of the rows that can match, with the bounds themselves beside their numbers."""
    lo, hi = _number(df, low), _number(df, high)
    sound = lo.isNotNull() & hi.isNotNull() & ~F.isnan(lo) & ~F.isnan(hi) & ((col(low) <= col(high)) if closed else (col(low) < col(high)))
    own = df.filter(sound).select(*(col(b).alias(f"{prefix}k{i}") for i, b in enumerate(by)), lo.alias(f"{prefix}lo"), hi.alias(f"{prefix}hi"), col(low).alias(f"{prefix}from"), col(high).alias(f"{prefix}to"), F.struct(*map(col, df.columns)).alias(f"{prefix}row"))
    for i in range(len(by)):
        own = own.filter(F.col(f"{prefix}k{i}").isNotNull())
    return own


def _level(prefix: str, width: float) -> Column:
    length = (F.col(f"{prefix}hi") - F.col(f"{prefix}lo")) / F.lit(width)
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1.0))))).cast("int")


def _width(intervals: DataFrame, prefix: str, width: float | None) -> float:
    if width is not None:
        if width <= 0:
            raise OpError("invalid_argument", "bins have a width")
        return float(width)
    middle = intervals.agg(F.percentile_approx(F.col(f"{prefix}hi") - F.col(f"{prefix}lo"), 0.5)).first()[0]
    return float(middle) if middle and middle > 0 else 1.0


def _levels(*posted: DataFrame) -> list[int]:
    """The levels that are in use: a number for each doubling of lengths, so few."""
    found: set[int] = set()
    for df in posted:
        found |= {r[0] for r in df.select("level").distinct().collect()}
    return sorted(found)


def _results(pairs: DataFrame, left: DataFrame, kept: Mapping[str, str]) -> DataFrame:
    return pairs.select(*(F.col("l_row").getField(c).alias(c) for c in left.columns), *(F.col("r_row").getField(c).alias(n) for c, n in kept.items()))


def point_join(points: DataFrame, intervals: DataFrame, by: Sequence[str], point: str, low: str, high: str, kept: Mapping[str, str], closed: bool = True, how: str = "inner", width: float | None = None) -> DataFrame:
    """Rows of ``points`` with columns of the rows of ``intervals`` of the same group whose interval holds their point.

    ``kept`` names the columns, {column of intervals: new name}; with ``how`` "left" points that no interval holds stay, with nulls.
    """
    if how not in ("inner", "left"):
        raise OpError("unsupported_join", f"no {how!r} join of points with intervals")
    own = points.withColumn("__number", F.monotonically_increasing_id())
    if how == "left":
        own = written(own, "numbered-points")
    spans = _intervals(intervals, by, low, high, closed, "r_")
    width = _width(spans, "r_", width)
    posted = spans.withColumn("level", _level("r_", width))
    posted = posted.select("*", F.explode(F.sequence(_bin(F.col("r_lo"), F.col("level"), width), _bin(F.col("r_hi"), F.col("level"), width))).alias("bin"))
    x = _number(points, point)
    looked = own.filter(x.isNotNull() & ~F.isnan(x)).select(*(col(b).alias(f"l_k{i}") for i, b in enumerate(by)), x.alias("l_x"), col(point).alias("l_point"), F.struct(*map(col, points.columns)).alias("l_row"), "__number")
    levels = _levels(posted)
    looked = looked.select("*", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")).alias("l_level"))
    looked = looked.withColumn("l_bin", _bin(F.col("l_x"), F.col("l_level"), width))
    meets = (F.col("l_level") == F.col("level")) & (F.col("l_bin") == F.col("bin"))
    for i in range(len(by)):
        meets &= F.col(f"l_k{i}") == F.col(f"r_k{i}")
    inside = (F.col("r_from") <= F.col("l_point")) & ((F.col("l_point") <= F.col("r_to")) if closed else (F.col("l_point") < F.col("r_to")))
    pairs = looked.join(posted, meets & inside)
    if how == "inner":
        return _results(pairs, points, kept)
    pairs = written(pairs.select("__number", "l_row", "r_row"), "points-in-intervals")
    alone = own.join(pairs.select("__number").distinct(), "__number", "left_anti").select(*map(col, points.columns), *(F.lit(None).cast(intervals.schema[c].dataType).alias(n) for c, n in kept.items()))
    return _results(pairs, points, kept).unionByName(alone)


def overlap_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_bounds: tuple[str, str], right_bounds: tuple[str, str], kept: Mapping[str, str], closed: bool = True, width: float | None = None) -> DataFrame:
    """Rows of ``left`` with columns of the rows of ``right`` of the same group whose interval overlaps theirs."""
    a, b = _intervals(left, by, *left_bounds, closed, "l_"), _intervals(right, by, *right_bounds, closed, "r_")
    width = _width(b, "r_", width)
    a, b = a.withColumn("level", _level("l_", width)), b.withColumn("level", _level("r_", width))
    in_use = {"l_": _levels(b), "r_": _levels(a)}

    def posted(df: DataFrame, prefix: str) -> DataFrame:
        others = F.array(*map(F.lit, in_use[prefix])) if in_use[prefix] else F.array().cast("array<int>")
        higher = F.filter(others, lambda x: x > F.col("level"))
        each = df.withColumn(f"{prefix}home", F.col("level")).withColumn(f"{prefix}level", F.explode(F.concat(F.array("level"), higher))).drop("level")
        bins = F.sequence(_bin(F.col(f"{prefix}lo"), F.col(f"{prefix}level"), width), _bin(F.col(f"{prefix}hi"), F.col(f"{prefix}level"), width))
        return each.withColumn(f"{prefix}bin", F.explode(bins))

    one, two = posted(a, "l_"), posted(b, "r_")
    meets = (F.col("l_level") == F.col("r_level")) & (F.col("l_bin") == F.col("r_bin"))
    for i in range(len(by)):
        meets &= F.col(f"l_k{i}") == F.col(f"r_k{i}")
    longer = F.greatest("l_home", "r_home") == F.col("l_level")
    starts = _bin(F.greatest("l_lo", "r_lo"), F.col("l_level"), width) == F.col("l_bin")
    over = (F.col("l_from") <= F.col("r_to")) & (F.col("r_from") <= F.col("l_to")) if closed else (F.col("l_from") < F.col("r_to")) & (F.col("r_from") < F.col("l_to"))
    return _results(one.join(two, meets & longer & starts & over), left, kept)
