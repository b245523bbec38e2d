"""Mixing sources to target weights, by hash-threshold histograms.

Every source has a budget of words: its share by weight of the whole mix, at most ``MOST``
times its own size. A source whose budget exceeds its size is taken whole as often as it fits;
the rest is taken from the documents with the smallest hashes. The threshold is found without
sorting: words are summed by source and hash bucket, the bucket in which the budget is reached
is the only one refined by the hash's next digits, and so on until it holds one hash. All of it
is DataFrame code, and only one small row per source and bucket is ever gathered.

The hash is one of doc_id and text, so that only rows equal in both share it; if the budget is
reached among such rows, it takes as many of them as come nearest to it.

Edge cases: a null text has no words; documents without a source form the last source; a null
doc_id hashes like an empty one; of rows with equal doc_id and text any may be the ones taken; a
source without words has target 0; an empty table gives an empty result; other columns are ignored by ``mix``
and kept, whatever their names, by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.common import whole, word_count, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Hexadecimal digits of the hash, and how many of them a histogram splits by.
DIGITS, STEP = 15, 3


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` (source, …) with rank 0, 1, … by code point, null last.

    Ranks are counted by range, so that no task sees all sources.
    """
    ranges = written(
        sources.withColumn("__null", F.col("source").isNull()).repartitionByRange("__null", "source")
        .withColumn("__range", F.spark_partition_id()), "source-ranges",
    )
    own = Window.partitionBy("__range").orderBy("__null", "source")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = ranges.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    out = ranges.withColumn("__own", F.row_number().over(own)).join(base, "__range")
    return out.withColumn("rank", F.col("base") + F.col("__own") - 1).drop("__null", "__range", "__own", "base")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with rank, weight and target."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    table = written(ranked(sources).withColumn("weight", weight), "source-weights")
    total = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    limit = None  # what one unit of weight gets; sources that would get more than they may are full
    while True:
        full = F.lit(False) if limit is None else F.col("weight") * limit >= most * F.col("source_size")
        row = table.agg(F.sum(F.when(full, most * F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        taken, free = row[0] or 0, row[1] or 0
        now = (total - taken) / free if free else None
        if now is None or now == limit:
            break
        limit = now
    if limit is None:
        return table.withColumn("target", F.lit(0.0))
    return table.withColumn("target", F.least(F.col("weight") * F.lit(limit), (most * F.col("source_size")).cast("double")))


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(rank, prefix, more, ties): the hash below which a source's documents get one more repeat, and how many of the ``ties`` rows with that hash do, too.

    ``plan``: (rank, need), the words wanted of each source by hash order.
    """
    state = plan.filter("need > 0").select("rank", F.lit("").alias("prefix"), F.col("need").cast("double").alias("need"))
    for digits in range(STEP, DIGITS + 1, STEP):
        state = written(state, "mix-prefix")
        own = state.select(F.col("rank").alias("of"), F.col("prefix").alias("start"), "need")
        rows = sized.join(own, (F.col("rank") == F.col("of")) & (F.substring("hash", 1, digits - STEP) == F.col("start")))
        if digits > STEP:  # the boundary bucket's rows alone are read from here on
            sized = written(rows.select("rank", "hash", "size"), "mix-boundary")
        hist = rows.groupBy("rank", F.substring("hash", 1, digits).alias("prefix")).agg(F.sum("size").alias("words"), F.count("*").alias("ties"), F.first("need").alias("need"))
        upto = F.sum("words").over(Window.partitionBy("rank").orderBy("prefix"))
        edge = hist.withColumn("upto", upto).filter("upto >= need AND upto - words < need")
        state = edge.select("rank", "prefix", (F.col("need") - (F.col("upto") - F.col("words"))).alias("need"), "words", "ties")
    # The last bucket is one hash, so all its rows have the same size: as many are in as come nearest to the budget.
    return state.select("rank", "prefix", F.floor(F.col("need") * F.col("ties") / F.col("words") + 0.5).alias("more"), "ties")


def _digits():
    """The hash of a row's doc_id and text."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")))
    return F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), text)), 1, DIGITS)


def _with_repeats(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, hash, …) with the columns of ``plan`` and with repeats.

    Only rows that share the boundary's hash and of which some are taken are numbered, by
    partition and then within it, so that no task sees them all.
    """
    out = rows.join(plan, rows.source.eqNullSafe(plan.of))
    at = F.coalesce(F.col("hash") == F.col("prefix"), F.lit(False))
    split = at & (F.col("more") < F.col("ties")) & (F.col("more") > 0)
    below = (F.col("hash") < F.col("prefix")) | (at & (F.col("more") > 0))
    plain = out.filter(~split).withColumn("repeats", F.col("rounds") + F.coalesce(below, F.lit(False)).cast("long"))
    if not plan.filter("more > 0 AND more < ties").limit(1).count():
        return plain
    ties = written(out.filter(split).withColumn("__part", F.spark_partition_id()), "mix-ties")
    before = Window.partitionBy("rank").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = ties.groupBy("rank", "__part").agg(F.count("*").alias("n")).select(F.col("rank").alias("__r"), F.col("__part").alias("__p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    number = F.row_number().over(Window.partitionBy("rank", "__part").orderBy("hash")) + F.col("__base")
    numbered = ties.join(base, (F.col("rank") == F.col("__r")) & (F.col("__part") == F.col("__p"))).withColumn("__number", number)
    numbered = numbered.withColumn("repeats", F.col("rounds") + (F.col("__number") <= F.col("more")).cast("long"))
    return plain.unionByName(numbered.drop("__part", "__p", "__r", "__base", "__number"))


def decisions(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(sizes of all documents; one row a source with target, rounds and the hash threshold)."""
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _digits().alias("hash")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sources, weights, share, most).withColumn("rounds", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
    plan = written(plan.withColumn("need", F.col("target") - F.col("rounds") * F.col("source_size")), "mix-plan")
    named = written(sized.join(plan, sized.source.eqNullSafe(plan.source)).select("rank", "hash", "size"), "mix-sizes")
    plan = plan.join(thresholds(named, plan.select("rank", "need")), "rank", "left")
    return sized, written(plan.select(F.col("source").alias("of"), "rank", "source_size", "target", "rounds", "prefix", "more", "ties"), "mix-thresholds")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken and repeats for every row of ``docs``.

    ``docs`` has doc_id, text and source.
    """
    sized, plan = decisions(docs, weights, share, most)
    out = _with_repeats(sized, plan)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, with its own columns."""
    _, plan = decisions(docs, weights, share, most)
    out = _with_repeats(docs.select(whole(docs).alias("row"), "source", _digits().alias("hash")), plan)
    return out.select("row", F.explode(F.expr("array_repeat(0, CAST(repeats AS INT))"))).select("row.*")


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mix(docs).drop("repeats")


SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))), 1, 15) AS hash FROM documents),
w AS (
  SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source)),
r AS (  -- sources that fill up first come first
  SELECT *, sum(2 * source_size) OVER x - 2 * source_size AS full_before, sum(weight) OVER () - sum(weight) OVER x + weight AS free,
         1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM w WINDOW x AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST)),
l AS (SELECT max((total - full_before) / free) FILTER (weight * ((total - full_before) / free) < 2 * source_size) AS limit_
      FROM r),
t AS (SELECT source, source_size, least(weight * limit_, 2.0::DOUBLE * source_size) AS target FROM r, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS rounds FROM t),
h AS (SELECT source, hash, sum(size) AS words, count(*) AS ties FROM s GROUP BY source, hash),
c AS (SELECT h.*, sum(words) OVER (PARTITION BY source ORDER BY hash) AS upto FROM h),
k AS (SELECT c.source, c.hash, CASE WHEN upto < need THEN ties WHEN upto - words < need THEN floor((need - (upto - words)) * ties / words + 0.5) ELSE 0 END AS more
      FROM c JOIN (SELECT *, target - rounds * source_size AS need FROM p) p ON c.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * (rounds + CAST(place <= more AS INT)) AS BIGINT) AS taken
FROM (SELECT *, row_number() OVER (PARTITION BY source, hash) AS place FROM s) s JOIN p ON s.source IS NOT DISTINCT FROM p.source
JOIN k ON s.source IS NOT DISTINCT FROM k.source AND s.hash = k.hash"""
