"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z
lower-cased. A window is ten consecutive words of a benchmark item, or the whole of a shorter
item. Every window of every document is hashed from its word numbers, looked up in the
broadcast set of window hashes, and verified word by word, with no shuffle of documents. The
benchmark's size is checked first: beyond ``MAX_WORDS`` words its items are dealt to several sets of
about that size, documents are scanned once for each, and what hits is put together by text.

Edge cases: a null text has no words; an item with no words or a null text has no windows; an item with
a null id marks words but is neither counted nor listed; equal ids count once; repeated rows
each get a row; empty tables give empty results or no hits; other columns are kept by
``scan`` (a column named like one it adds is replaced) and, whatever their names, by ``remove_documents``.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.names import col
from tablemill.llm.common import filtered, positional, written

WINDOW = 10
#: Words of benchmark items that one broadcast set holds (more only if a single item has more). A word takes 16 bytes in the arrays, and a
#: distinct one about 170 more in the table of words: 190 MB in each worker if all words differ, and at most 330 MB on the driver while it's made.
MAX_WORDS = 1_000_000
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Bytes to what they count as: digits, a-z and bytes beyond ASCII stand, A-Z are lower-cased, the rest part words.
BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
ADDED = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(BYTES).split()


def mix(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` word numbers."""
    out = np.zeros(len(ids) - width + 1, np.uint64)
    for k in range(width):
        out = out * PRIME + ids[k : len(ids) - width + 1 + k]
    return out


class Windows:
    """The windows of a bounded set of items: words by number in one array, and for each width the windows' sorted hashes and places in it."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.words: dict[bytes, int] = {}
        numbers, ends, self.names = array("I"), array("Q", [0]), []
        for item, text in items:
            if not (words := words_of(text)):
                continue
            for w in words:
                numbers.append(self.words.setdefault(w, len(self.words) + 1))
            ends.append(len(numbers))
            self.names.append(None if item is None else str(item))
        self.ids, self.ends = np.frombuffer(numbers, np.uint32), np.frombuffer(ends, np.uint64).astype(np.int64)
        sizes = np.diff(self.ends)
        self.widths: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in sorted({min(window, n) for n in sizes.tolist()}):
            own = np.flatnonzero(np.minimum(sizes, window) == width)
            at = np.concatenate([np.arange(self.ends[i], self.ends[i + 1] - width + 1, dtype=np.uint32) for i in own.tolist()])
            hashes = np.zeros(len(at), np.uint64)
            for k in range(width):
                hashes = hashes * PRIME + self.ids[at + np.uint32(k)]
            order = np.argsort(hashes, kind="stable")
            self.widths[width] = hashes[order], at[order]

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are in an occurrence of a window, and the items of those windows."""
        hit, items, n = np.zeros(len(words), bool), set(), len(words)
        ids = np.fromiter(map(self.words.get, words, [0] * n), np.uint64, n)
        for width, (hashes, places) in self.widths.items():
            if n < width:
                continue
            full = np.convolve(ids > 0, np.ones(width, np.int64), "valid") == width  # all words are known
            at = np.flatnonzero(full)
            if not len(at):
                continue
            own = mix(ids, width)[at]
            low, high = np.searchsorted(hashes, own), np.searchsorted(hashes, own, "right")
            for p, i, j in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                found = places[i:j].astype(np.int64)  # of one hash: windows that may differ, as hashes collide, or be in several items
                found = found[(self.ids[found[:, None] + np.arange(width)] == ids[p : p + width]).all(1)]
                if len(found):
                    hit[p : p + width] = True
                    items.update(self.names[x] for x in np.unique(np.searchsorted(self.ends, found, "right") - 1).tolist())
        items.discard(None)
        return hit, items


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _spans(hit: np.ndarray) -> list[int]:
    """First and last word of each run of hit words, one after the other."""
    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    return edges.tolist()


def _columns(rows: list[tuple[int, int, set]]) -> list[pa.Array]:
    """The added columns from (number of words, hit words, items)."""
    out = [(n, k, len(found), digest(found), k > 0) for n, k, found in rows]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return [pa.array(x, k) for x, k in zip(list(zip(*out, strict=True)) or [[]] * 5, kinds, strict=True)]


def _scan_once(docs: DataFrame, items: list[tuple[object, str | None]], window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Windows(items, window))
    kept, schema = _schema(docs)
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            rows = []
            for text in batch.column(at).to_pylist():
                words = words_of(text)
                hit, found = windows.scan(words)
                rows.append((len(words), int(hit.sum()), found))
            yield pa.RecordBatch.from_arrays([*batch.columns, *_columns(rows)], names=[f.name for f in schema])

    return positional(docs, kept).mapInArrow(run, schema)


def _schema(docs: DataFrame) -> tuple[list[str], T.StructType]:
    added = T._parse_datatype_string(ADDED)
    kept = [c for c in docs.columns if c.lower() not in {f.name for f in added}]
    return kept, T.StructType([*docs.select(*map(col, kept)).schema.fields, *added])


def _hits(docs: DataFrame, items: list[tuple[object, str | None]], window: int) -> DataFrame:
    """(key, spans, items) of the texts in which windows of these items occur."""
    shared = docs.sparkSession.sparkContext.broadcast(Windows(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hit, found = windows.scan(words_of(text))
                if hit.any():
                    rows.append((key, _spans(hit), sorted(found)))
            if rows:
                kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "spans", "items"])

    return docs.select(F.md5("text").alias("key"), "text").filter("text IS NOT NULL").mapInArrow(run, "key string, spans array<long>, items array<string>")


def _scan_parts(docs: DataFrame, benchmark: DataFrame, window: int, parts: int) -> DataFrame:
    """The same columns from one scan for each part of the benchmark; what hits is small and meets by the text's digest."""
    cut = written(benchmark.withColumn("part", F.pmod(F.xxhash64("text", F.col("item_id").cast("string")), F.lit(parts))), "benchmark-parts")
    hits = None
    for part in range(parts):
        items = [tuple(r) for r in cut.filter(F.col("part") == part).select("item_id", "text").collect()]  # a part: about MAX_WORDS words
        if any(words_of(t) for _, t in items):
            own = written(_hits(docs, items, window).dropDuplicates(["key"]), "benchmark-hits")
            hits = own if hits is None else hits.unionByName(own)
    if hits is None:
        return _scan_once(docs, [], window)
    found = hits.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    found = written(found, "benchmark-hits").select(F.col("key").alias("__key"), F.struct("spans", "items").alias("__hits"))
    kept, schema = _schema(docs)
    at = kept.index("text")
    each = docs.select(F.struct(*map(col, kept)).alias("row"), F.md5("text").alias("__k")).join(found, F.col("__k") == F.col("__key"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rows = batch.column(0).flatten(), []
            for text, got in zip(own[at].to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(words_of(text))
                hit, spans = np.zeros(n, bool), (got or {}).get("spans") or []
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    hit[a:b] = True
                rows.append((n, int(hit.sum()), set((got or {}).get("items") or [])))
            yield pa.RecordBatch.from_arrays([*own, *_columns(rows)], names=[f.name for f in schema])

    return each.select("row", "__hits").mapInArrow(run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated."""
    own = benchmark.select("item_id", "text")
    # No item has more words than half its bytes and one, so this bounds what a broadcast holds.
    size = own.agg(F.sum(F.octet_length("text") / 2 + 1).alias("words"), F.count("*").alias("items")).first()
    parts = min(size.items, math.ceil((size.words or 0) / max(1, max_words)))
    if parts <= 1:
        return _scan_once(docs, [tuple(r) for r in own.collect()], window)
    return _scan_parts(docs, own, window, parts)


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with their own columns."""
    return filtered(docs, lambda df: scan(df, benchmark, window), [f.name for f in T._parse_datatype_string(ADDED)], ~F.col("contaminated"))


def op5(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return scan(docs.select("doc_id", "text"), benchmark).drop("text")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
h AS (SELECT doc_id, i, k, item_id FROM s JOIN g USING (k, gram)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""
