"""Alignment of two tokenizers' tokens over the same bytes, and counts of what they pair.

A space and the text are cut into tokens by a byte-level vocabulary (A) and by one of pieces with byte fallback (B).
Two tokens are linked if their byte ranges overlap; between two neighbouring ends of either kind there is just
one token of each, so these stretches are the links. The connected components of this bipartite graph, by union-find
over all tokens of a batch of texts at once, are the smallest groups that both tokenizers cut alike: a link lies in one group, and
the groups follow each other. A component's members in their order are written out as text and hashed.

A pair's count is the number of documents that hold it linked. Each document's distinct pairs are written once
with how often they are met; counts are sums over that table, added up before they are shuffled, so a pair
that every document has costs no more than others. The most frequent pairs, ``PAIRS`` at most, are broadcast with their counts and looked up
in each document's row; whatever pairs there are beyond come back by a join, in which each has few rows.

Edge cases: null and empty texts, and those whose tokens' joined bytes differ from space and text, have no tokens: all
figures are 0 and the hash is an empty string; special tokens' names in texts are plain text; repeated rows are documents of their own
each; a null doc_id is kept; an empty table gives an empty result; other columns are ignored. Memory grows with the longest single text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import discard, worker_held, written
from tablemill.llm.tokens import Encoder

#: Pairs that are broadcast with their counts at most, 17 bytes each.
PAIRS = 2_000_000
#: Segments whose pieces a worker keeps at most, and their characters.
CACHE, LONGEST = 150_000, 200
#: Characters of texts that are aligned at once (more only for one longer text).
AT_ONCE = 1 << 19
#: Words that are encoded in one row when they are new.
ROW = 1000
#: A piece's spaces stand at its start alone, so that no merge crosses from another character to a space.
SEGMENT = re.compile(" +[^ ]*")
SPACE = "▁"


class Pieces:
    """Ids of whole texts by a vocabulary of pieces, which adds a space before a text.

    Texts are cut into segments, spaces and what follows up to the next one, whose ids are kept by the segment without its first
    space; ``unsound`` are those whose ids' bytes aren't theirs.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_proto=model)
        size = self.processor.get_piece_size()
        pieces = [self.processor.id_to_piece(i) for i in range(size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.processor.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.by_segment = not any(SPACE in p.lstrip(SPACE) for p in pieces) and SPACE in pieces
        self.starts = np.array([p.startswith(SPACE) for p in pieces])
        self.sizes = np.fromiter(map(len, self.bytes), np.int64, size)
        self.known: dict[str, bytes] = {"": np.array([self.processor.piece_to_id(SPACE)], "<i4").tobytes()}
        self.unsound: set[str] = set()

    def joined(self, coded: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(coded, "<i4").tolist()))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, "<i4").tobytes() for x in self.processor.encode(texts, num_threads=1)]

    def _segments(self, segments: list[str]) -> tuple[dict[str, bytes], set[str]]:
        """Ids of distinct segments, and the unsound ones. Words are encoded in rows and told apart by the pieces that start with a space."""
        words = [s for s in segments if s and " " not in s and SPACE not in s and len(s) <= LONGEST]
        rows = [words[i : i + ROW] for i in range(0, len(words), ROW)]
        out: dict[str, bytes] = {}
        for row, got in zip(rows, self.processor.encode([" ".join(r) for r in rows], num_threads=1), strict=True):
            ids = np.array(got, "<i4")
            at = np.flatnonzero(self.starts[ids])
            if len(at) != len(row):
                continue
            whole = [(" " + w).encode("utf-8", "surrogatepass") for w in row]
            # A row is sound if its bytes are, and each word's ids have as many as the word.
            if (np.add.reduceat(self.sizes[ids], at) == np.fromiter(map(len, whole), np.int64, len(row))).all() and b"".join(map(self.bytes.__getitem__, got)) == b"".join(whole):
                data, ends = ids.tobytes(), np.append(at[1:], len(ids)) * 4
                out.update(zip(row, [data[a:b] for a, b in zip((at * 4).tolist(), ends.tolist(), strict=True)], strict=True))
        rest = [s for s in segments if s not in out]
        alone = dict(zip(rest, self._whole(rest), strict=True))
        return out | alone, {s for s, x in alone.items() if self.joined(x) != (" " + s).encode("utf-8", "surrogatepass")}

    def __call__(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids as bytes of int32, and for each text whether its ids' bytes are a space and the text."""
        if not self.by_segment:
            out = self._whole(texts)
            return out, [self.joined(x) == (" " + t).encode("utf-8", "surrogatepass") for x, t in zip(out, texts, strict=True)]
        cut = []
        for text in texts:
            words = text.split(" ")
            cut.append([s[1:] for s in SEGMENT.findall(" " + text)] if "" in words[:-1] else words)
        fresh, unsound = self._segments(list(set().union(*cut).difference(self.known)))
        self.known.update(fresh)
        self.unsound |= unsound
        out = [b"".join(map(self.known.__getitem__, own)) for own in cut]
        # Segments that are their own bytes make up the text; if one isn't, the whole is compared.
        sound = [not self.unsound or self.unsound.isdisjoint(own) or self.joined(x) == (" " + t).encode("utf-8", "surrogatepass") for own, x, t in zip(cut, out, texts, strict=True)]
        for segment in fresh:
            if len(segment) > LONGEST or len(self.known) > CACHE:
                del self.known[segment]
                self.unsound.discard(segment)
        return out, sound


class Bytes:
    """Ids of texts by a byte-level vocabulary, and each token's bytes."""

    def __init__(self, definition: str):
        self.encoder = Encoder(definition)
        self.encoder.tokenizer.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        rest = [b for b in range(256) if b not in set(plain)]
        of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocabulary = self.encoder.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        #: With every byte in its vocabulary, and texts neither normalised nor changed, its tokens make up the text always.
        self.lossless = self.encoder.by_piece and all(c in vocabulary for c in of)

    def __call__(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        ids = [np.frombuffer(x, self.encoder.kind).astype(np.int32) for x in self.encoder(texts)]
        return ids, [self.lossless or b"".join(map(self.bytes.__getitem__, x.tolist())) == t.encode("utf-8", "surrogatepass") for x, t in zip(ids, texts, strict=True)]


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node that each of ``n`` nodes is connected with by the links (u, v)."""
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))  # a root joins the least root it is linked with
        while True:
            higher = parent[parent]
            if (higher == parent).all():
                break
            parent = higher
    return parent


class Alignment:
    """Links and groups of the tokens of some texts, one after the other; texts end where both kinds end."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray):
        self.a, self.b = a, b
        self.a_ends, self.b_ends = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
        # Bytes after which a token ends; of both kinds as many have ended before a stretch as are left of its tokens.
        ended = np.zeros((2, int(self.a_ends[-1]) + 1 if len(a) else 1), np.int32)
        ended[0, self.a_ends] = ended[1, self.b_ends] = 1
        ends = np.flatnonzero(ended[0] | ended[1])
        self.link_a, self.link_b = (np.cumsum(e)[ends - 1].astype(np.int64) for e in ended)
        root = union_find(len(a) + len(b), self.link_a, len(a) + self.link_b)
        first = root == np.arange(len(root))
        number = np.cumsum(first) - 1
        self.group_a, self.group_b = number[root[: len(a)]], number[root[len(a) :]]
        self.groups = int(first.sum())

    def written_out(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Parts to be joined, in order: each token with what follows it; and where A's and B's tokens are among them.

        ``texts`` has for each id its digits with a comma, a bar and a semicolon behind.
        """
        ga, gb = self.group_a, self.group_b
        in_a, in_b = np.bincount(ga, minlength=self.groups), np.bincount(gb, minlength=self.groups)
        at_a = np.arange(len(ga)) + (np.cumsum(in_b) - in_b)[ga]
        at_b = np.arange(len(gb)) + np.cumsum(in_a)[gb]
        order = np.empty(len(ga) + len(gb), np.int64)
        order[at_a] = 3 * self.a.astype(np.int64) + np.append(ga[1:] != ga[:-1], True)
        order[at_b] = 3 * self.b.astype(np.int64) + 2 * np.append(gb[1:] != gb[:-1], True)
        return list(map(texts.__getitem__, order.tolist())), at_a, at_b


class Aligner:
    """What a worker needs to align texts."""

    def __init__(self, definition: str, model: bytes):
        self.first, self.second = Bytes(definition), Pieces(model)
        self.sizes = [np.fromiter(map(len, x.bytes), np.int64, len(x.bytes)) for x in (self.first, self.second)]
        most = max(map(len, self.sizes))
        self.texts = [b"%d%c" % (i, c) for i in range(most) for c in b",|;"]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Both tokenizers' ids of each text; none if it has no tokens."""
        none = np.zeros(0, np.int32)
        (first, fits), (second, matches) = self.first([" " + t for t in texts]), self.second(texts)
        return [(a, np.frombuffer(b, "<i4")) if t and x and y else (none, none) for t, a, b, x, y in zip(texts, first, second, fits, matches, strict=True)]

    def rows(self, texts: list[str], spans: bool) -> list[pa.Array]:
        """Columns of ``ALIGNED`` (and ``SPANS``) for each text."""
        both, kinds = self.tokens(texts), (pa.list_(pa.int32()), pa.list_(pa.int64()))
        n_a, n_b = (np.fromiter((len(x[i]) for x in both), np.int64, len(both)) for i in (0, 1))
        start_a, start_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
        a, b = (np.concatenate([*(x[i] for x in both), np.zeros(0, np.int32)]) for i in (0, 1))
        of = Alignment(a, b, *self.sizes)
        parts, _, _ = of.written_out(self.texts)
        digests = [hashlib.sha256(b"".join(parts[x:y])[:-1]).hexdigest() if y > x else "" for x, y in zip((start_a + start_b)[:-1].tolist(), (start_a + start_b)[1:].tolist(), strict=True)]
        doc = np.repeat(np.arange(len(both)), n_a)[of.link_a]
        n_links = np.bincount(doc, minlength=len(both))
        group_at = np.append(np.unique(of.group_a, return_index=True)[1], len(a))
        n_groups = np.diff(np.searchsorted(group_at[:-1], start_a))
        width = np.int64(len(self.sizes[1]))
        pairs = a[of.link_a].astype(np.int64) * width + b[of.link_b]
        most = np.int64(len(self.sizes[0])) * width
        distinct, times = np.unique(doc * most + pairs, return_counts=True)
        ends = np.append(0, np.cumsum(np.bincount(distinct // most, minlength=len(both))))
        pair = distinct % most
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (pair // width, pair % width, times)]
        out = [*(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)), pa.array(digests, pa.string()), *lists]
        if spans:
            group_ends = of.a_ends[group_at[1:] - 1] if len(a) else np.zeros(0, np.int64)
            sizes = [0, *accumulate(len(b"".join(map(self.first.bytes.__getitem__, x[0].tolist()))) for x in both)]
            cuts = np.append(0, np.cumsum(n_groups)).tolist()
            out += [pa.array([x[i].tolist() for x in both], kinds[0]) for i in (0, 1)]
            out.append(pa.array([(group_ends[x:y] - before).tolist() for x, y, before in zip(cuts[:-1], cuts[1:], sizes, strict=False)], kinds[1]))
        return out


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"
SPANS = "a_ids array<int>, b_ids array<int>, group_ends array<long>"


def aligned(docs: DataFrame, first: str, second: str, spans: bool = False) -> DataFrame:
    """(doc_id, number, ALIGNED) of every row of ``docs`` (doc_id, text), written to the shared folder.

    ``a``, ``b`` and ``times`` are its distinct linked pairs and how often each is met. With ``spans`` also both tokenizers'
    ids and the bytes of space and text up to the end of each group. ``first`` and ``second`` are files of the driver.
    """
    spark = docs.sparkSession
    files = Path(first).read_text(), Path(second).read_bytes()
    key = hashlib.sha256(files[0].encode() + files[1]).hexdigest()
    shared = spark.sparkContext.broadcast(files)  # a tokenizer's definition and another's model: about 3 MB
    schema = ALIGNED + (f", {SPANS}" if spans else "")
    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            if aligner is None:
                aligner = worker_held("aligner", key, lambda: Aligner(*shared.value))
            at, n = 0, batch.num_rows
            while at < n:
                texts, size = [], 0
                while at + len(texts) < n and (not texts or size < AT_ONCE):
                    texts.append(batch.column(1)[at + len(texts)].as_py() or "")
                    size += len(texts[-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *aligner.rows(texts, spans)], names=names)
                at += len(texts)

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {schema}")
    return written(rows.withColumn("number", F.monotonically_increasing_id()), "aligned-tokens")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, n, best) of ``aligned`` rows: documents that hold the pair, and whether none of a's pairs has more."""
    each = rows.select(F.inline(F.arrays_zip("a", "b"))).groupBy("a", "b").agg(F.count("*").alias("n"))
    each = written(each, "pair-counts")
    most = each.groupBy("a").agg(F.max("n").alias("most"))
    return each.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _cut(counts: DataFrame, most: int) -> int:
    """A count that at most ``most`` pairs reach."""
    power = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    sizes = {r.p: r.n for r in counts.groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row a power of two
    least, held = 1 << (max(sizes, default=0) + 1), 0
    for p in sorted(sizes, reverse=True):
        held += sizes[p]
        if held > most:
            break
        least = 1 << p
    return least


def link_figures(rows: DataFrame, counts: DataFrame, most: int = PAIRS) -> DataFrame:
    """``rows`` with n_best and count_sum for a, b and times."""
    spark = rows.sparkSession
    least = _cut(counts, most)
    found = counts.filter(F.col("n") >= least).toArrow()  # ``most`` pairs at most
    keys = found.column("a").to_numpy().astype(np.int64) << 32 | found.column("b").to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], found.column("n").to_numpy()[order], found.column("best").to_numpy()[order]))
    kept = [c for c in rows.columns if c not in ("a", "b", "times")]
    own_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    added = "n_best long, count_sum long, rest array<struct<a: int, b: int, times: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            lists = [batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "times")]
            a, b, times = (x.flatten().to_numpy() for x in lists)
            ends = lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()
            key = a.astype(np.int64) << 32 | b
            at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
            there = known[at] == key if len(known) else np.zeros(len(key), bool)
            at = at[there]
            sums = []
            for value in (best[at], n[at]):
                each = np.zeros(len(key), np.int64)
                each[there] = times[there].astype(np.int64) * value
                total = np.append(0, np.cumsum(each))
                sums.append(pa.array(total[ends[1:]] - total[ends[:-1]]))
            missing = np.append(0, np.cumsum(~there))[ends]
            rest = pa.StructArray.from_arrays([pa.array(x[~there], pa.int32()) for x in (a, b, times)], names=["a", "b", "times"])
            own = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, *sums, pa.ListArray.from_arrays(pa.array(missing, pa.int32()), rest)], names=[*kept, "n_best", "count_sum", "rest"])

    out = rows.mapInArrow(run, f"{own_schema}, {added}")
    if least == 1:
        return out.drop("rest")
    out = written(out, "looked-up-pairs")
    few = counts.filter(F.col("n") < least)
    each = out.select("number", F.inline("rest")).join(few, ["a", "b"])
    more = each.groupBy("number").agg(F.sum(F.col("times") * F.col("best").cast("int")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    both = out.drop("rest").join(more, "number", "left")
    return both.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).drop("more_best", "more_sum")


def align(docs: DataFrame, first: str, second: str, most: int = PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``."""
    rows = aligned(docs, first, second)
    counts = written(pair_counts(rows), "counted-pairs")
    out = link_figures(rows, counts, most).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    out = written(out, "alignments")
    discard(rows, counts)
    return out


def op12(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    from public_tokenizers import path

    return align(docs, first or path("byte_bpe_50k.json"), second or path("piece_bpe_32k.model"))
