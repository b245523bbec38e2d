"""Comparing results: sets, bags and fingerprints of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.names import col, find

#: How texts start that Spark casts to numbers; it skips blanks and control characters before them.
NUMERIC = "^[\\x00-\\x20\\x7f]*[-+]?([0-9.]|[iI][nN][fF]|[nN][aA][nN])"


def positional(df: DataFrame) -> DataFrame:
    """Columns named c0, c1, …, so that results compare by position."""
    return df.select(*(col(c).alias(f"c{i}") for i, c in enumerate(df.columns)))


def same_set(left: DataFrame, right: DataFrame) -> DataFrame:
    """(equal): whether both have the same distinct rows, by position."""
    a, b = positional(left), positional(right)
    spark = left.sparkSession
    if len(a.columns) != len(b.columns):
        return spark.range(1).select(F.lit(False).alias("equal"))
    marked = a.distinct().withColumn("__side", F.lit(1)).union(b.distinct().withColumn("__side", F.lit(2)))
    odd = marked.groupBy(*a.columns).agg(F.count("*").alias("n")).filter("n = 1")
    return odd.agg((F.count("*") == 0).alias("equal"))


def _shown(own: Column, kind: str) -> Column:
    """A cell as text; columns whose type tells what their cells are take the short way to the same text."""
    if kind in ("boolean", "byte", "short", "integer"):
        return (own.cast("int") if kind == "boolean" else own).cast("string")
    text = F.trim(own.cast("string"))
    if kind == "date":
        return text
    # A text that doesn't start like a number is told by that, as a cast that fails costs an exception.
    number = own if kind == "double" else F.when(text.rlike(NUMERIC), text.try_cast("double"))
    size = F.abs(number)
    whole = F.abs(number - F.rint(number)) < 1e-6
    far = F.when(size < 1e37, F.when(size < 1e37, number).cast("decimal(38,0)").cast("string")).otherwise(F.lower(number.cast("string")))
    # Four decimals by way of a decimal, which has no negative zero. Cases aren't worked out where another one holds.
    near = F.when(size < 9e15, number)
    places = F.concat(F.when((number < 0) & (size < 0.00005), "-").otherwise(""), near.cast("decimal(38,4)").cast("string"))
    return F.when(number.isNull(), text).when(F.isnan(number), "nan").when(size >= 9e15, far).when(whole, F.rint(near).cast("long").cast("string")).otherwise(places)


def normalized(df: DataFrame) -> DataFrame:
    """Cells as text: null is empty; numbers, also those in text, are whole or have four decimals; truth values are 1 and 0."""
    return df.select(*(F.coalesce(_shown(col(f.name), f.dataType.typeName()), F.lit("")).alias(f"c{i}") for i, f in enumerate(df.schema.fields)))


def multiset(left: DataFrame, right: DataFrame) -> DataFrame:
    """(equal): whether both have the same normalised rows as often."""
    a, b = normalized(left), normalized(right)
    if len(a.columns) != len(b.columns):
        return left.sparkSession.range(1).select(F.lit(False).alias("equal"))
    both = a.withColumn("__n", F.lit(1)).union(b.withColumn("__n", F.lit(-1)))
    odd = both.groupBy(*a.columns).agg(F.sum("__n").alias("n")).filter("n != 0")
    return odd.agg((F.count("*") == 0).alias("equal"))


def similarity(left: DataFrame, right: DataFrame) -> DataFrame:
    """(similarity): 0.8 x Jaccard index of distinct rows + 0.1 for equal widths + 0.1 x ratio of the distinct rows' numbers."""
    one = lambda df, side: positional(df).select(F.to_json(F.array(*(F.col(f"c{i}").cast("string") for i in range(len(df.columns))))).alias("row")).distinct().withColumn(side, F.lit(1))
    rows = one(left, "l").join(one(right, "r"), "row", "full")
    sums = rows.agg(F.count("l").alias("n"), F.count("r").alias("m"), F.count(F.col("l") + F.col("r")).alias("both"), F.count("*").alias("any"))
    jaccard = F.when(F.col("any") == 0, 1.0).otherwise(F.try_divide("both", "any"))
    ratio = F.when(F.greatest("n", "m") == 0, 1.0).otherwise(F.try_divide(F.least("n", "m"), F.greatest("n", "m")))
    width = float(len(left.columns) == len(right.columns))
    return sums.select((0.8 * jaccard + 0.1 * F.lit(width) + 0.1 * ratio).alias("similarity"))


def projection(wider: DataFrame, target: DataFrame) -> DataFrame:
    """``wider`` cut to the columns of ``target``, in its order."""
    return wider.select(*(col(find(wider.columns, c)).alias(c) for c in target.columns))


def fingerprint_set(df: DataFrame) -> DataFrame:
    """(fingerprint): SHA-256 over the sum of the hashes of distinct rows, with their number.

    A sum needs no order and no place for all rows, so the table may have any size.
    """
    digest = F.sha2(F.to_json(F.struct(*map(col, df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring("d", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = df.distinct().select(digest.alias("d")).agg(F.count("*").cast("string").alias("n"), *(F.coalesce(part(i), F.lit("0")).alias(f"s{i}") for i in range(5)))
    return sums.select(F.sha2(F.concat_ws("/", "n", *(f"s{i}" for i in range(5))), 256).alias("fingerprint"))


def fingerprint_schema(tables: dict[str, DataFrame]) -> str:
    """SHA-256 of all tables' column names and types."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps({t: [(f.name, f.dataType.simpleString()) for f in df.schema] for t, df in sorted(tables.items())}).encode()).hexdigest()
