"""Cover selection: rows that together cover features by weight, with caps, in rounds of lazily updated gains.

A row's gain is the sum over its features of weight / (1 + times the feature is covered), over the square root of its number of
features, and BONUS / (1 + rows chosen of its group). A feature's weight is 1 + ln(1 + rows / rows with it). Gains only fall as rows are chosen, so
a gain from an earlier round is a bound: each round takes up the rows with the largest bounds, ``POOL`` at most, works their gains out anew, and chooses
among those within ``NEAR`` of the best that any row can have, the best first: those whose gain stays within ``NEAR`` even if all better ones among them were chosen before.
So what a row adds when it is chosen is never less than that share of the best (the test holds the whole against plain greedy's value). Of a cap's key no more are chosen than it has left.

All tables stay in Spark: bounds by row, features by row, and counts of what is chosen, which are as small as the choice. Only single numbers reach the driver.

Edge cases: a row without features has the group's bonus alone; null features are left out, repeated ones count once; a null group or key of a cap is one of its own; equal gains go by the hash of
seed and id; if caps leave fewer rows than asked for, all that they leave are chosen; an empty table gives none. Ids are unique.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.functions.names import col
from tablemill.shared import discard, written

#: Rows whose gains a round works out anew, at most; by how much of the best gain a row may stay behind it.
POOL, NEAR = 2000, 0.3
BONUS = 2.0


def greedy_cover(df: DataFrame, id_: str, features: str, quota: int, group: str, caps: Mapping[str, tuple[Sequence[str], int]] | None = None, seed: str = "", pool: int = POOL, near: float = NEAR) -> DataFrame:
    """(id, gain, round): ``quota`` rows of ``df`` chosen by what their features (an array) add; ``caps`` are {name: (columns, most)}."""
    if quota < 0 or any(most < 1 for _, most in (caps or {}).values()):
        raise OpError("invalid_argument", "a quota isn't negative, and caps let one row through")
    caps = {"__id": ([id_], 1), **(caps or {})}
    key = lambda columns: F.to_json(F.array(*(F.coalesce(col(c).cast("string"), F.lit("\\0null")) for c in columns)))
    names = [f"c{i}" for i in range(len(caps))]
    base = df.select(col(id_).alias("id"), key([group]).alias("g"), F.sha2(F.concat(F.lit(seed + "\0"), col(id_).cast("string")), 256).alias("tie"), F.array_distinct(F.array_compact(col(features))).alias("fs"), *(key(c).alias(n) for n, (c, _) in zip(names, caps.values(), strict=True)))
    base = written(base, "cover-rows")
    rows = base.count()
    weights = base.select(F.explode("fs").alias("f")).groupBy("f").agg((1 + F.log1p(F.lit(rows) / F.count("*"))).alias("w"))
    posts = base.select("id", F.sqrt(F.greatest(F.size("fs"), F.lit(1))).alias("root"), F.explode("fs").alias("f")).join(weights, "f").select("id", "f", (F.col("w") / F.col("root")).alias("w"))
    posts = written(posts, "cover-features")
    first = posts.groupBy("id").agg(F.sum("w").alias("w"))
    bounds = written(base.drop("fs").join(first, "id", "left").withColumn("gain", F.coalesce("w", F.lit(0.0)) + BONUS).drop("w"), "cover-bounds")
    spark, chosen, count, round_ = df.sparkSession, None, 0, 0
    empty = spark.createDataFrame([], "k string, n long")
    by_feature, by_group, by_cap = empty, empty, {n: empty for n in names}
    best = [F.desc("gain"), F.asc("tie")]
    while count < quota:
        round_ += 1
        some = written(bounds.orderBy(*best).limit(pool), "cover-pool")
        held = some.agg(F.count("*").alias("n"), F.min("gain").alias("least")).first()
        if not held.n:
            break
        beyond = held.least if held.n == pool else 0.0  # no other row can have a larger gain
        own = posts.join(some.select("id"), "id", "left_semi")
        counted = own.join(by_feature.select(F.col("k").alias("f"), "n"), "f", "left").select("id", "f", (F.col("w") / (1 + F.coalesce("n", F.lit(0)))).alias("w"), F.coalesce("n", F.lit(0)).alias("n"))
        counted = written(counted, "cover-counts")
        fresh = some.drop("gain").join(counted.groupBy("id").agg(F.sum("w").alias("w")), "id", "left").join(by_group.select(F.col("k").alias("g"), F.col("n").alias("gn")), "g", "left")
        fresh = fresh.withColumn("gn", F.coalesce("gn", F.lit(0))).withColumn("gain", F.coalesce("w", F.lit(0.0)) + BONUS / (1 + F.col("gn"))).drop("w")
        fresh = written(fresh, "cover-gains")
        top = max(fresh.agg(F.max("gain")).first()[0], beyond)
        good = fresh.filter(F.col("gain") >= (1 - near) * top)
        # How many of a feature, group or cap come before a row among the good ones: all of it over the pool, which is bounded.
        met = counted.join(good.select("id", "gain", "tie"), "id").withColumn("place", F.row_number().over(Window.partitionBy("f").orderBy(*best)))
        after = met.groupBy("id").agg(F.sum(F.col("w") * (1 + F.col("n")) / (F.col("n") + F.col("place"))).alias("after"))
        good = good.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(*best))).join(after, "id", "left")
        good = good.filter(F.coalesce("after", F.lit(0.0)) + BONUS / (F.col("gn") + F.col("place")) >= (1 - near) * top).drop("place", "after")
        for n, (_, most) in zip(names, caps.values(), strict=True):
            used = by_cap[n].select(F.col("k").alias(n), F.col("n").alias("used"))
            good = good.join(used, n, "left").withColumn("place", F.row_number().over(Window.partitionBy(n).orderBy(*best))).filter(F.col("place") + F.coalesce("used", F.lit(0)) <= most).drop("place", "used")
        taken = written(good.orderBy(*best).limit(quota - count).withColumn("round", F.lit(round_)), "cover-choice")
        count += taken.count()
        chosen = taken if chosen is None else chosen.unionByName(taken)
        more = counted.join(taken.select("id"), "id", "left_semi").select(F.col("f").alias("k"), F.lit(1).cast("long").alias("n"))
        by_feature = written(by_feature.unionByName(more).groupBy("k").agg(F.sum("n").alias("n")), "cover-features-chosen")
        by_group = chosen.groupBy(F.col("g").alias("k")).agg(F.count("*").alias("n"))
        left = bounds.join(taken.select("id"), "id", "left_anti")
        for n, (_, most) in zip(names, caps.values(), strict=True):
            by_cap[n] = chosen.groupBy(F.col(n).alias("k")).agg(F.count("*").alias("n"))
            left = left.join(by_cap[n].filter(F.col("n") >= most).select(F.col("k").alias(n)), n, "left_anti")
        newer = fresh.select("id", F.col("gain").alias("newer"))
        before, bounds = bounds, written(left.join(newer, "id", "left").withColumn("gain", F.coalesce("newer", "gain")).drop("newer").select(bounds.columns), "cover-bounds")
        discard(before, some, counted, fresh)
    discard(posts, base, bounds)
    if chosen is None:
        return df.limit(0).select(col(id_).alias("id"), F.lit(0.0).alias("gain"), F.lit(0).alias("round"))
    return chosen.select("id", "gain", "round")
