"""Ranked lexical search: whole documents for each query item, by MaxScore in index shards.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. Documents
are dealt to shards by bytes as they are read; a shard keeps, for each term that some item
asks for, its postings (documents and occurrences) and its documents' lengths. Corpus counts (documents with terms, terms in all,
documents a term) are sums over all shards, so no document is shuffled.

In a shard, each posting's share of a score is worked out once, and its largest share is the term's upper bound.
For an item, terms are taken from the largest bound down. As long as what is left could by itself lift a document
among the k best, a term is essential: its whole list is added up. From then on the rest are non-essential: their lists are
probed only for documents that are still able to reach the k-th best score, and those that no longer are leave at once. The k-th
best score that a task has found in its earlier shards holds in the next one. Each task gives k rows an item, which are
merged at the end.

Items are broadcast, up to ``MAX_TERMS`` terms at once; beyond that they are dealt to several sets, and documents are read once for each.

Edge cases: null and empty texts have no terms, aren't counted and are never found; an item without terms
finds nothing; repeated rows are documents, or items, of their own, and rows of one item_id each rank on their own; equal scores go by doc_id, a null one
last; a null item_id is an item; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.common import discard, worker_released, written

K = 10
#: A term's weight, a posting's share and a document's length norm are whole numbers of these parts; SLOPE of LENGTHS is by length.
WEIGHT, SHARE, TIMES, LENGTHS, SLOPE, NORM = 1000, 1_000_000_000, 1000, 100, 75, 8
#: Bytes of texts and documents of a shard, about (more only for one longer text).
SHARD_BYTES, SHARD_DOCS = 8 << 20, 20_000
#: Terms of items that are broadcast at once, about 150 bytes each (more only if a single item has more).
MAX_TERMS = 1_000_000
#: Bytes to what they count as: digits, letters and bytes beyond ASCII stand, A-Z are lower-cased, the rest part terms.
BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
LONG = (1 << 63) - 1


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(BYTES).split()


class Shard:
    """Postings of the asked terms over some documents, term by term."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, ends: np.ndarray, docs: np.ndarray, times: np.ndarray):
        self.lengths, self.terms, self.ends, self.docs, self.times = lengths, terms, ends, docs, times

    @classmethod
    def build(cls, texts: list[np.ndarray], lengths: list[int]) -> Shard:
        """``texts`` holds each document's asked terms, by number."""
        n = np.int64(max(1, len(texts)))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.concatenate([*texts, np.zeros(0, np.int64)]) * n + np.repeat(np.arange(len(texts)), sizes)
        both, times = np.unique(flat, return_counts=True)
        of = both // n
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        return cls(np.array(lengths, np.int64), of[starts], np.append(starts[1:], len(of))[: len(starts)], both % n, times)


SHARDS = "doc_ids array<long>, lengths array<long>, terms array<int>, ends array<int>, docs array<int>, times array<int>, some long, total long"


def _shard_row(ids: list, shard: Shard) -> pa.RecordBatch:
    lists = [pa.array([x], pa.list_(k)) for x, k in zip((ids, shard.lengths, shard.terms, shard.ends, shard.docs, shard.times), (pa.int64(), pa.int64(), *[pa.int32()] * 4), strict=True)]
    counts = [pa.array([int(x)]) for x in ((shard.lengths > 0).sum(), shard.lengths.sum())]
    return pa.RecordBatch.from_arrays([*lists, *counts], names=["doc_ids", "lengths", "terms", "ends", "docs", "times", "some", "total"])


def _numbers(words: list[bytes], number: dict[bytes, int]) -> np.ndarray:
    found = np.fromiter(map(number.get, words, [-1] * len(words)), np.int64, len(words))
    return found[found >= 0]


def index(docs: DataFrame, vocabulary: list[bytes], shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A row for each shard of ``docs`` with the postings of the ``vocabulary``'s terms, numbered by place; written to the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # MAX_TERMS terms at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_released()
        number = {w: i for i, w in enumerate(shared.value)}
        ids, texts, lengths, held = [], [], [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                text = batch.column(1)[at].as_py()
                words = terms_of(text)
                ids.append(batch.column(0)[at].as_py())
                texts.append(_numbers(words, number))
                lengths.append(len(words))
                held += len(text or "")
                if held >= shard_bytes or len(ids) >= shard_docs:
                    yield _shard_row(ids, Shard.build(texts, lengths))
                    ids, texts, lengths, held = [], [], [], 0
        if ids:
            yield _shard_row(ids, Shard.build(texts, lengths))

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SHARDS), "search-shards")


def norms(lengths: np.ndarray, docs: int, total: int) -> np.ndarray:
    """The length norm m of documents of these lengths."""
    if not total:
        return np.full(len(lengths), LENGTHS - SLOPE, np.int64)
    if SLOPE * int(lengths.max(initial=0)) * docs <= LONG:
        return LENGTHS - SLOPE + SLOPE * lengths * docs // total
    return np.array([LENGTHS - SLOPE + SLOPE * n * docs // total for n in lengths.tolist()], np.int64)


def weight(docs: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * docs + 2) / (2 * df + 1)))


class Search:
    """MaxScore over one shard after the other."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, docs: int, total: int, k: int):
        """``items``: (number, its terms, their times); ``weights`` by term."""
        self.items, self.weights, self.docs, self.total, self.k = items, weights, docs, total, k
        self.best: dict[int, list[tuple[int, bool, int]]] = {}

    def shard(self, ids: list, shard: Shard) -> None:
        m = norms(shard.lengths, self.docs, self.total)
        shares = SHARE * shard.times // (TIMES * shard.times + NORM * m[shard.docs])
        starts = np.concatenate(([0], shard.ends)).astype(np.int64)[: len(shard.ends)]
        most = np.maximum.reduceat(shares, starts) if len(starts) else np.zeros(0, np.int64)
        place = np.full(len(self.weights), -1, np.int64)
        place[shard.terms] = np.arange(len(shard.terms))
        score = np.zeros(len(ids), np.int64)
        for number, terms, times in self.items:
            at = place[terms]
            factor = (times * self.weights[terms])[at >= 0]
            at = at[at >= 0]
            bound = factor * most[at]
            order = np.argsort(-bound, kind="stable")
            order = order[bound[order] > 0]
            rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)
            own = self.best.setdefault(number, [])
            floor = -own[-1][0] if len(own) >= self.k else 0
            if rest[0] < max(floor, 1):
                continue
            touched, left = [], len(order)
            for i, t in enumerate(order.tolist()):
                low, high = starts[at[t]], shard.ends[at[t]]
                docs = shard.docs[low:high]
                score[docs] += factor[t] * shares[low:high]
                touched.append(docs)
                if len(docs) >= self.k:
                    floor = max(floor, int(np.partition(score[docs], -self.k)[-self.k]))
                if rest[i + 1] < floor:  # what is left is non-essential: no document has it alone and is among the best
                    left = i + 1
                    break
            docs = np.unique(np.concatenate(touched))
            own_score = score[docs]
            score[docs] = 0
            for i, t in enumerate(order.tolist()[left:], left):
                if len(docs) >= self.k:
                    floor = max(floor, int(np.partition(own_score, -self.k)[-self.k]))
                able = own_score + rest[i] >= floor
                docs, own_score = docs[able], own_score[able]
                if not len(docs):
                    break
                low, high = starts[at[t]], shard.ends[at[t]]
                listed = shard.docs[low:high]
                found = np.minimum(np.searchsorted(listed, docs), len(listed) - 1)
                there = listed[found] == docs
                own_score = own_score + np.where(there, factor[t] * shares[low:high][found], 0)
            last = own_score >= max(1, floor)
            own += [(-s, ids[d] is None, ids[d] or 0) for s, d in zip(own_score[last].tolist(), docs[last].tolist(), strict=True)]
            own.sort()
            del own[self.k :]

    def rows(self) -> pa.RecordBatch:
        out = [(n, None if none else d, -s) for n, own in self.best.items() for s, none, d in own]
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["number", "doc_id", "score"])


def _of_row(row: pa.RecordBatch, at: int) -> tuple[list, Shard]:
    lists = [row.column(i)[at].values for i in range(6)]
    return lists[0].to_pylist(), Shard(*(x.to_numpy().astype(np.int64) for x in lists[1:]))


def _ranked_once(docs: DataFrame, items: list[tuple[int, str | None]], k: int, **limits: int) -> DataFrame:
    """(number, doc_id, score): the k best of each item in each task's shards."""
    spark = docs.sparkSession
    counts = [(number, Counter(terms_of(text))) for number, text in items]
    vocabulary = sorted(set().union(*(c for _, c in counts)))
    place = {w: i for i, w in enumerate(vocabulary)}
    shards = index(docs, vocabulary, **limits)
    size = shards.agg(F.coalesce(F.sum("some"), F.lit(0)).alias("docs"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    each = shards.select(F.explode(F.arrays_zip("terms", F.expr("transform(ends, (e, i) -> e - IF(i = 0, 0, ends[i - 1]))").alias("df"))).alias("x"))
    df = np.zeros(len(vocabulary), np.int64)
    for r in each.groupBy("x.terms").agg(F.sum("x.df").alias("df")).collect():  # a row a term asked for
        df[r.terms] = r.df
    weights = np.array([weight(size.docs, int(x)) for x in df], np.int64)
    asked = [(number, np.array([place[w] for w in c], np.int64), np.array(list(c.values()), np.int64)) for number, c in counts if c]
    shared = spark.sparkContext.broadcast((asked, weights, size.docs, size.total, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_released()
        search = Search(*shared.value)
        for batch in batches:
            for at in range(batch.num_rows):
                search.shard(*_of_row(batch, at))
        yield search.rows()

    out = written(shards.mapInArrow(run, "number long, doc_id long, score long"), "best-of-tasks")
    discard(shards)
    return out


def rank(docs: DataFrame, items: DataFrame, k: int = K, max_terms: int = MAX_TERMS, **limits: int) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` (item_id, text) its k best documents of ``docs`` (doc_id, text)."""
    own = written(items.select("item_id", "text").withColumn("number", F.monotonically_increasing_id()), "search-items")
    # No item has more terms than half its bytes and one, so this bounds what a broadcast holds.
    size = own.agg(F.sum(F.octet_length("text") / 2 + 1).alias("terms"), F.count("*").alias("items")).first()
    sets = max(1, min(size.items, math.ceil((size.terms or 0) / max(1, max_terms))))
    found = None
    for i in range(sets):
        asked = own.filter(F.pmod(F.xxhash64("number"), F.lit(sets)) == i).select("number", "text").collect()  # about MAX_TERMS terms
        if asked or found is None:
            some = _ranked_once(docs, [tuple(r) for r in asked], k, **limits)
            found = some if found is None else found.unionByName(some)
    over = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k)
    return best.join(own.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")


def op13(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the ten best documents for each benchmark item."""
    return rank(docs, benchmark)


SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
m AS (SELECT doc_id, 100 - 75 + (75 * n * docs) // total AS m FROM n, a),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, a GROUP BY term),
s AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM s WHERE score > 0)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM r WHERE n <= 10"""
