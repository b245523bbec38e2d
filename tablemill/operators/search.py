"""Lexical value search over distinct values.

Texts are compared after NFKC, case folding and turning runs of other characters than letters and
digits into blanks ("folded"). Tiers: 0 the same text, 1 the same folded, 2 prefix, 3 all words of the
query, 4 substring, 5 alike (the larger of difflib's ratio and the Jaccard index of letter triples). Hits come by
tier, score, frequency, column and value.

Spark decides all tiers and the bounds that rule likeness out, as expressions over columns; only texts beyond ASCII
go to Python to be folded, and only values that the bounds leave go there for difflib's ratio.

A ``ValueIndex`` is written once: the distinct values of all columns, folded and ordered by length, and postings of their triples and
words, ordered by piece, so that a query reads its own pieces' lists and the values that these name, and no table. The first
tiers, and texts that are alike by triples, share all or most pieces with the query; texts that are alike by
difflib's ratio lie within a range of lengths, and only that range of values is read for them. So no hit is missed.

The bounded search scores those values of a column that share the most pieces with the query, at most ``CANDIDATES``, the same text
without regard to case first and of equal ones the shortest. That cap is the
feature's own, ``capped`` tells whether it took hold, and ``search_values`` has none.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.functions.names import col, find
from tablemill.shared import shared_dir, shuffles_removed, written

CANDIDATES = 4096
#: Characters of the shortest query that is compared for likeness, and of a triple.
SHORTEST = 3
#: Values whose numbers one posting row holds at most.
LIST = 1 << 16
#: Longest folded value that is compared for likeness, and the least score by whether the query has so many characters.
LONGEST, LONG_QUERY, LEAST, LEAST_SHORT = 256, 5, 0.72, 0.80
ALIKE = 5
#: Columns that a search reads of a value.
VALUES = ("table", "column", "value", "frequency", "folded")
ORDER = ("tier", "-score", "-frequency", "column", "value")


def folded(text: str) -> str:
    """A text as it is compared."""
    plain = unicodedata.normalize("NFKC", text).casefold()
    return " ".join("".join(c if c.isalnum() else " " for c in plain).split())


def _with_folded(values: DataFrame) -> DataFrame:
    """``values`` with folded; Spark folds ASCII texts itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(folded=pdf.value.map(folded))

    plain = F.col("value").rlike("^[\\x00-\\x7F]*$")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema) + ", folded string"
    own = values.filter(plain).withColumn("folded", F.trim(F.regexp_replace(F.lower("value"), "[^a-z0-9]+", " ")))
    return own.unionByName(values.filter(~plain).mapInPandas(run, schema))


def _text(value: str) -> str:
    """A text as a literal of Spark SQL, whatever its characters and however the session escapes them."""
    return f"CAST(X'{value.encode('utf-8', 'replace').hex()}' AS STRING)"


def _texts(values: Iterable[str]) -> str:
    return f"array({', '.join(map(_text, values))})"


def _triples(text: str) -> str:
    solid = f"replace({text}, ' ', '')"
    return f"array_distinct(transform(sequence(1, greatest(length({solid}) - 2, 1)), i -> substring({solid}, i, 3)))"


def _scored(values: DataFrame, query: str) -> DataFrame:
    """The rows of ``values`` (column, value, frequency, folded, …) that match, with tier and score.

    Expressions are SQL text: a query's plan is made of few calls to the JVM, which else take longer than its jobs.
    """
    q, keep = folded(query), [c for c in values.columns if c not in ("slot", "folded", "length", "id", "block")]
    if not q:
        return values.limit(0).select(*keep, F.lit(0).alias("tier"), F.lit(0.0).alias("score"))
    words, names = q.split(), [f"`{c}`" for c in keep]
    ways = [
        f"value = {_text(query)}",
        f"folded = {_text(q)}",
        f"startswith(folded, {_text(q)})",
        f"size(array_except({_texts(words)}, split(folded, ' '))) = 0",
        f"contains(folded, {_text(q)})",
    ]
    tier = f"CASE {' '.join(f'WHEN {fits} THEN {i}' for i, fits in enumerate(ways))} ELSE {ALIKE} END AS tier"
    score = f"CASE WHEN tier < 2 THEN 1D WHEN tier = 3 THEN {len(words)}D / size(split(folded, ' ')) WHEN tier < {ALIKE} THEN {len(q)}D / length(folded) END AS score"
    rows = values.filter("folded != ''").selectExpr(*names, "folded", tier)
    if len(q) < SHORTEST:
        return rows.filter(f"tier < {ALIKE}").selectExpr(*names, "tier", score)
    least = LEAST if len(q) >= LONG_QUERY else LEAST_SHORT
    mine, own = _texts(x[1:] for x in pieces(query)[0]), _triples("folded")
    shared = f"CASE WHEN tier = {ALIKE} AND length(folded) <= {LONGEST} THEN size(array_intersect({mine}, {own})) / size(array_union({mine}, {own})) END AS shared"
    # The ratio is at most twice the characters in common, however placed, over both lengths.
    common = " + ".join(f"least({k}, length(folded) - length(replace(folded, {_text(c)}, '')))" for c, k in Counter(q).items())
    maybe = rows.selectExpr(*names, "tier", score, "folded", shared)
    maybe = maybe.filter(f"tier < {ALIKE} OR shared >= {least}D OR (shared IS NOT NULL AND 2D * ({common}) / (length(folded) + {len(q)}) >= {least}D)")

    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = [s if t < ALIKE else max(x, SequenceMatcher(None, q, text, autojunk=False).ratio()) for t, s, x, text in zip(pdf.tier, pdf.score, pdf.shared, pdf.folded, strict=True)]
            yield pdf.assign(score=pd.Series(score, pdf.index, dtype=float)).drop(columns=["folded", "shared"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in maybe.schema if f.name not in ("folded", "shared"))
    return maybe.mapInPandas(ratios, schema).filter(f"tier < {ALIKE} OR score >= {least}D")


def _ranked(hits: DataFrame, limit: int, offset: int, more: tuple[str, ...] = ()) -> DataFrame:
    keys = (*ORDER, *more)
    out = hits.orderBy([k.lstrip("-") for k in keys], ascending=[k[0] != "-" for k in keys]).limit(offset + limit)
    return out.offset(offset) if offset else out


def _pieces(text: str) -> str:
    """A folded text's triples and words, told apart by their first character."""
    return f"array_distinct(concat(transform({_triples(text)}, x -> concat('3', x)), transform(filter(split({text}, ' '), w -> w != ''), x -> concat('w', x))))"


def pieces(query: str) -> tuple[list[str], list[str]]:
    """The triples and the words of a query, as they are posted."""
    q = folded(query)
    solid = q.replace(" ", "")
    return sorted({"3" + solid[i : i + 3] for i in range(max(1, len(solid) - 2))}), sorted({"w" + w for w in q.split()})


def _same(value: str) -> str:
    """What a text is posted under to be found regardless of case."""
    return f"concat('=', hex(xxhash64(lower({value}))))"


def _lengths(n: int) -> tuple[int, int]:
    """The lengths of folded texts that a folded query of ``n`` characters may be alike to by difflib's ratio, which is 2 * min / (n + m) at most."""
    least = LEAST if n >= LONG_QUERY else LEAST_SHORT
    return int(n * least / (2 - least)), min(LONGEST, int(n * (2 - least) / least) + 1)


class ValueIndex:
    """The distinct values of text columns: (slot, table, column, value, frequency, folded, length, id, block), and postings of their pieces."""

    def __init__(self, values: DataFrame, postings: DataFrame | None, slots: list[tuple[str, str]]):
        self.values, self.postings, self.slots = values, postings, slots

    @classmethod
    def build(cls, tables: Mapping[str, DataFrame], column: str | None = None, postings: bool = True) -> ValueIndex:
        """Of one column of the tables, or of all text columns; each table is read once. Without ``postings`` queries read all values."""
        found, slots = None, []
        for name, df in tables.items():
            columns = [find(df.columns, column)] if column else [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
            if not columns:
                continue
            each = F.explode(F.array(*(F.struct(F.lit(len(slots) + i).alias("slot"), F.lit(c).alias("column"), col(c).cast("string").alias("value")) for i, c in enumerate(columns))))
            slots += [(name, c) for c in columns]
            own = df.select(each.alias("x")).select("x.*").filter("value IS NOT NULL").groupBy("slot", "column", "value").agg(F.count("*").alias("frequency")).withColumn("table", F.lit(name))
            found = own if found is None else found.unionByName(own)
        if found is None:
            raise OpError("type_mismatch", "there is no text column")
        values = _with_folded(written(found, "distinct-values")).withColumn("length", F.length("folded"))
        if not postings:
            return cls(written(values, "folded-values"), None, slots)
        spark = values.sparkSession
        ordered = values.repartitionByRange("length", "slot", "value").sortWithinPartitions("length", "slot", "value").withColumn("id", F.monotonically_increasing_id())
        numbered = ordered.withColumn("block", F.shiftright("id", 33).cast("int"))  # the partition's part of the number
        path = shared_dir(spark, "value-index")
        with shuffles_removed(spark):
            numbered.write.partitionBy("block").parquet(f"{path}/values")
            values = spark.read.schema(numbered.schema).parquet(f"{path}/values")
            keys = f"explode(concat({_pieces('folded')}, array({_same('value')}))) AS piece"
            lists = values.selectExpr("slot", "id", f"id div {LIST} AS part", keys).groupBy("piece", "slot", "part").agg(F.sort_array(F.collect_list("id")).alias("ids"))
            lists.drop("part").repartitionByRange("piece").sortWithinPartitions("piece").write.option("parquet.block.size", str(4 << 20)).parquet(f"{path}/postings")
        return cls(values, spark.read.parquet(f"{path}/postings"), slots)

    def _hits(self, query: str) -> DataFrame:
        """(slot, id, triples, words, same) of the values with some piece of the query: how many triples and words they share, and whether they are the same without case."""
        triples, words = pieces(query)
        own = self.postings.filter(f"piece IN ({', '.join(map(_text, (*triples, *words)))}) OR piece = {_same(_text(query))}").selectExpr("slot", "piece", "explode(ids) AS id")
        counts = F.expr("count_if(startswith(piece, '3')) AS triples"), F.expr("count_if(startswith(piece, 'w')) AS words"), F.expr("count_if(startswith(piece, '=')) > 0 AS same")
        return own.groupBy("slot", "id").agg(*counts)

    def _named(self, ids: DataFrame, *more: str) -> DataFrame:
        """The values with these numbers, with the columns ``more`` of ``ids``; only the blocks they are in are read."""
        return self.values.join(ids.selectExpr("id", "CAST(shiftright(id, 33) AS INT) AS block", *more), ["block", "id"])

    def search(self, query: str, limit: int = 20, offset: int = 0) -> DataFrame:
        """The best matches among all values: (table, column, value, frequency, tier, score)."""
        q = folded(query)
        rows = self.values
        if self.postings is not None and len(q.replace(" ", "")) >= SHORTEST:
            triples, words = pieces(query)
            near = "length BETWEEN {} AND {}".format(*_lengths(len(q)))
            most = (LEAST if len(q) >= LONG_QUERY else LEAST_SHORT) * len(triples)
            hits = self._hits(query).filter(f"words = {len(words)} OR triples >= {most}D OR same")
            rows = rows.filter(near).unionByName(self._named(hits).filter(f"NOT ({near})"))
        return _ranked(_scored(rows, query), limit, offset, ("table",))

    def search_bounded(self, query: str, limit: int = 20, offset: int = 0, candidates: int = CANDIDATES) -> DataFrame:
        """As ``search`` over the values of each column that share the most with the query, with capped; a text that is the same but for case keeps alike ones out."""
        q = folded(query)
        indexed = self.postings is not None and len(q.replace(" ", "")) >= SHORTEST
        if indexed:
            found, last = self._hits(query), "id"
        else:
            own, (triples, words) = _pieces("folded"), pieces(query)
            counts = [f"size(array_intersect({own}, CAST({_texts(x)} AS ARRAY<STRING>))) AS {name}" for name, x in (("triples", triples), ("words", words))]
            found, last = self.values.selectExpr("*", f"lower(value) = lower({_text(query)}) AS same", *counts), "length, value"
            short = f" OR contains(folded, {_text(q)})" if q and len(q) < SHORTEST else ""
            found = found.filter(f"same OR triples + words > 0{short}")
        # Spark keeps the first rows of each column's window before the shuffle, so no task sorts all values.
        found = found.selectExpr("*", f"row_number() OVER (PARTITION BY slot ORDER BY same DESC, triples + words DESC, {last}) AS place").filter(f"place <= {candidates + 1}")
        if indexed:
            found = self._named(found, "same", "place")
        # The windows are over the recalled candidates, whose number is bounded.
        capped = f"max(place) OVER () > {candidates} AND NOT max(same) OVER () AS capped"
        found = found.selectExpr(*(f"`{c}`" for c in VALUES), "place", "max(same) OVER () AS found_same", capped)
        kept = _scored(found.filter(f"place <= {candidates}").drop("place"), query).filter(f"NOT found_same OR tier < {ALIKE}")
        return _ranked(kept, limit, offset, ("table",)).select("table", "column", "value", "frequency", "tier", "score", "capped")


INDEXES: dict[tuple, ValueIndex] = {}


def kept_index(key: tuple, build: Callable[[], ValueIndex], spark: SparkSession) -> ValueIndex:
    """The index under this key, built when it is first asked for in this application."""
    own = (spark.sparkContext.applicationId, *key)
    if own not in INDEXES:
        INDEXES[own] = build()
    return INDEXES[own]


def search_values(df: DataFrame, query: str, column: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """The best matches among all distinct values: (column, value, frequency, tier, score)."""
    return ValueIndex.build({"": df}, column, postings=False).search(query, limit, offset).drop("table")


def search_values_bounded(df: DataFrame, query: str, column: str | None = None, limit: int = 20, offset: int = 0, candidates: int = CANDIDATES) -> DataFrame:
    """As ``search_values`` over the values that share the most with the query, with capped."""
    return ValueIndex.build({"": df}, column, postings=False).search_bounded(query, limit, offset, candidates).drop("table")


def search_database(tables: Mapping[str, DataFrame], query: str, limit: int = 20) -> DataFrame:
    """The bounded search over the text columns of all tables, with the table's name."""
    return ValueIndex.build(tables, postings=False).search_bounded(query, limit)
