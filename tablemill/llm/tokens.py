"""Token-id shards with a minimal perfect hash index.

Texts are dealt to shards by ranges of doc_id, sorted, encoded, and written as raw ids with an
end id after each document. Beside each shard lies its index: a minimal perfect hash (after
Limasset et al., 2017) gives every document key of the shard a slot of its own in arrays of offsets, lengths and
stored fingerprints, so that a document's ids are found in constant time and a key that is
not there is told apart by its fingerprint.

File format, all little-endian: ``*.bin`` is 16 bytes of header (b"TMIDS1\\0\\0", bytes per id as
uint32, 0 as uint32) and then the ids; ``*.idx`` is a numpy archive: ``sizes`` (bits of each
level), ``bits``, ``ranks`` (ones before each 64-byte block), ``starts``, ``counts``, ``prints``.

The encoder splits a text by the tokenizer's own pattern and keeps the ids that the library
gave for the pieces it has met, since the library encodes pieces one by one anyway; texts with
characters beyond Latin or with special tokens in them go to the library whole, and so do all texts
where a tokenizer splits by another pattern or normalises.

Edge cases: null and empty texts have the end id alone; null doc_ids come first; rows with
equal doc_id are ordered by their text's hash and keyed by their number among them in their shard; an empty
table writes no shard; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablemill.llm.common import open_fs, shared_dir, spread, tasks_for, worker_held, written

MAGIC, HEADER = b"TMIDS1\0\0", 16
END_ID = 2
#: Pieces whose ids a worker keeps at most; further ones are encoded anew.
CACHE = 250_000
#: Rows and bytes of texts that a shard has at most, about; ids that one task reads back.
SHARD_ROWS, SHARD_BYTES, READ_IDS = 250_000, 64 << 20, 16 << 20
#: What a definition has if its texts can be encoded piece by piece.
BY_PIECE = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
#: The tokenizer's pattern for texts whose characters are all below U+0250 and not U+001C to U+001F, letters first as they are most.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
PIECE = re.compile(rf" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
OTHER = re.compile("[^\x00-\x1b\x20-ɏ]")
#: Pieces that can be encoded side by side: those that start with their space, and with a line end before each, those without white space.
SPACED, SOLID = re.compile(r" \S+"), re.compile(r"\S+")
ROW = 1000


class Encoder:
    """Ids of whole texts as bytes of ``width`` bytes an id."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        self.by_piece = all(parts.get(k) == v for k, v in BY_PIECE.items())
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        if not self.by_piece:
            return
        # Ids that start a piece in such rows; further on in a piece there is neither a space nor a line end.
        self.space, self.line = np.zeros(self.tokenizer.get_vocab_size(), bool), self._whole(["\n"])[0]
        self.space[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("Ġ")]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of distinct pieces; most are encoded in rows and told apart by the ids that only a piece's start has."""
        spaced = list(filter(SPACED.fullmatch, pieces))
        solid = list(filter(SOLID.fullmatch, pieces))
        out: dict[str, bytes] = {}
        for own, before in ((spaced, ""), (solid, "\n")):
            rows = [own[i : i + ROW] for i in range(0, len(own), ROW)]
            coded = self.tokenizer.encode_batch_fast([before + before.join(r) for r in rows], add_special_tokens=False)
            for row, got in zip(rows, coded, strict=True):
                ids = np.array(got.ids, self.kind)
                starts = np.flatnonzero(ids == np.frombuffer(self.line, self.kind)[0] if before else self.space[ids])
                if len(starts) != len(row):
                    continue  # a tokenizer of another kind: piece by piece, below
                data, ends = ids.tobytes(), np.append(starts[1:], len(ids)) * self.width
                starts = (starts + len(before)) * self.width
                out.update(zip(row, [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], strict=True))
        rest = list(pieces.difference(out))
        return out | dict(zip(rest, self._whole(rest), strict=True))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_piece:
            return self._whole([x or "" for x in texts])
        pieces = [None if OTHER.search(t) or any(s in t for s in self.special) else PIECE.findall(t) for t in (x or "" for x in texts)]
        fresh = self._pieces(set().union(*filter(None, pieces)).difference(self.known))
        self.known.update(fresh)
        out = [self._whole([text])[0] if own is None else b"".join(map(self.known.__getitem__, own)) for text, own in zip(texts, pieces, strict=True)]
        if (over := len(self.known) - CACHE) > 0:
            for piece in list(fresh)[-over:]:
                del self.known[piece]
        return out


def key_of(doc_id, number: int) -> int:
    """The 64-bit key of the ``number``-th row with this doc_id."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(f"{doc_id}#{number}".encode())


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys with a 32-bit fingerprint for each."""

    GAMMA = 2

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray, prints: np.ndarray):
        self.sizes, self.bits, self.ranks, self.prints = sizes, bits, ranks, prints

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, flags, left = [], [], np.unique(keys)
        while len(left):
            size = max(64, cls.GAMMA * len(left))
            at = spread(left, len(sizes)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            flags.append(alone)
            sizes.append(size)
            left = left[~alone[at.astype(np.int64)]]
        flat = np.concatenate(flags) if flags else np.zeros(0, bool)
        flat = np.pad(flat, (0, -len(flat) % 512))
        ranks = np.concatenate(([0], np.cumsum(flat.reshape(-1, 512).sum(1))))[:-1]
        out = cls(np.array(sizes, np.int64), np.packbits(flat, bitorder="little"), ranks.astype(np.int64), np.zeros(0, np.uint32))
        distinct = np.unique(keys)
        prints = np.zeros(len(distinct), np.uint32)
        prints[out.slots(distinct)] = cls.prints_of(distinct)
        out.prints = prints
        return out

    @staticmethod
    def prints_of(keys: np.ndarray) -> np.ndarray:
        return (spread(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; for keys that were not in the set -1 or any slot."""
        out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = (spread(keys[todo], level) % np.uint64(size)).astype(np.int64) + base
            here = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            hit = at[here]
            block = hit >> 9
            before = np.zeros(len(hit), np.int64)
            for k in range(64):  # ones in the bytes of the block before the key's own
                byte = (block << 6) + k
                before += np.where(byte < hit >> 3, np.bitwise_count(self.bits[byte]), 0)
            low = np.bitwise_count(self.bits[hit >> 3] & ((1 << (hit & 7)) - 1).astype(np.uint8))
            out[todo[here]] = self.ranks[block] + before + low
            todo, base = todo[~here], base + int(size)
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, or -1 where the stored fingerprint is another."""
        slots = self.slots(keys)
        if len(self.prints):
            slots[self.prints[slots] != self.prints_of(keys)] = -1
        return slots


def _encode_partition(folder: str, key: str, definition, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name, encoder, out, fs = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}", None, None, None
        keys, counts, last, number = array("Q"), array("I"), object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                # Spark runs many tasks in one worker, and what an encoder knows serves them all.
                encoder = worker_held("encoder", key, lambda: Encoder(definition.value))
                fs, path = open_fs(f"{name}.bin")
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
                out.write(MAGIC + np.array([encoder.width, 0], "<u4").tobytes())
            end = np.array([end_id], encoder.kind).tobytes()
            ids, sizes, numbers = batch.column(0).to_pylist(), [], []
            texts = (encoder(batch.column(1).slice(i, 256).to_pylist()) for i in range(0, len(ids), 256))
            for doc_id, coded in zip(ids, chain.from_iterable(texts), strict=True):
                number = number + 1 if doc_id == last else 0
                last = doc_id
                out.write(coded + end)
                numbers.append(number)
                keys.append(key_of(doc_id, number))
                sizes.append(len(coded) // encoder.width + 1)
            counts.extend(sizes)
            rows = [batch.column(0), pa.array(numbers, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*rows, pa.array([name] * len(ids)), pa.array([task.partitionId()] * len(ids), pa.int32())],
                names=["doc_id", "number", "n_ids", "shard", "place"],
            )
        if out is not None:
            out.close()
            each = np.frombuffer(keys, np.uint64)
            if len(np.unique(each)) < len(each):
                raise ValueError("two document keys of a shard share a 64-bit hash")
            index, n = PerfectHash.build(each), np.frombuffer(counts, np.uint32)
            slots = index.find(each)
            starts, lengths = np.zeros(len(each), np.int64), np.zeros(len(each), np.uint32)
            starts[slots], lengths[slots] = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))[:-1], n
            buffer = io.BytesIO()
            np.savez(buffer, sizes=index.sizes, bits=index.bits, ranks=index.ranks, prints=index.prints, starts=starts, counts=lengths)
            with fs.open_output_stream(open_fs(f"{name}.idx")[1]) as f:
                f.write(buffer.getvalue())

    return run


def write_shards(docs: DataFrame, tokenizer: str, shards: int | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the shards with the tokenizer in the driver's file ``tokenizer``; (doc_id, number, n_ids, shard, place, base): base is the ids of all shards before."""
    spark = docs.sparkSession
    folder, kind = shared_dir(spark, "token-shards"), docs.schema["doc_id"].dataType.simpleString()
    if shards is None:
        size = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
        shards = max(tasks_for(spark, size.rows, SHARD_ROWS), tasks_for(spark, size.bytes, SHARD_BYTES))
    text = Path(tokenizer).read_text()
    definition, key = spark.sparkContext.broadcast(text), hashlib.sha256(text.encode()).hexdigest()  # a tokenizer's definition: about 2 MB
    # Rows that share a doc_id, however many, are dealt out by text and then by place, so no shard need hold them all.
    keys = docs.select("doc_id", "text", F.xxhash64("text").alias("__text"), F.monotonically_increasing_id().alias("__place"))
    ordered = keys.repartitionByRange(shards, "doc_id", "__text", "__place").sortWithinPartitions("doc_id", "__text", "__place")
    rows = ordered.select("doc_id", "text").mapInArrow(_encode_partition(folder, key, definition, end_id), f"doc_id {kind}, number long, n_ids long, shard string, place int")
    rows = written(rows, "token-rows")
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    each = rows.groupBy("shard", "place").agg(F.sum("n_ids").alias("n"))
    bases = written(each.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "token-bases")
    return rows.join(bases, "shard")


class ShardReader:
    """Looks documents up in one shard."""

    def __init__(self, shard: str):
        fs, path = open_fs(f"{shard}.idx")
        with fs.open_input_stream(path, compression=None) as f:
            data = np.load(io.BytesIO(f.read()))
        self.index = PerfectHash(data["sizes"], data["bits"], data["ranks"], data["prints"])
        self.starts, self.counts = data["starts"], data["counts"]
        self.file = fs.open_input_file(open_fs(f"{shard}.bin")[1])
        head = self.file.read(HEADER)
        if head[:8] != MAGIC:
            raise ValueError(f"{shard}.bin is no token shard")
        self.width = int(np.frombuffer(head[8:12], "<u4")[0])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, number of ids) of each key; (-1, 0) for keys that are not there."""
        slots = self.index.find(keys)
        there = slots >= 0
        return np.where(there, self.starts[slots], -1), np.where(there, self.counts[slots], 0).astype(np.int64)

    def ids(self, start: int, count: int) -> np.ndarray:
        self.file.seek(HEADER + start * self.width)
        return np.frombuffer(self.file.read(count * self.width), f"<u{self.width}")

    def close(self) -> None:
        self.file.close()


def read_documents(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): each row of ``write_shards`` looked up in its files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name = None, None
        for batch in batches:
            ids, numbers, shards, bases = (batch.column(i).to_pylist() for i in range(4))
            starts, counts, crcs = [], [], []
            at = 0
            while at < len(ids):
                end = next((i for i in range(at, len(ids)) if shards[i] != shards[at]), len(ids))
                if shards[at] != name:
                    if reader:
                        reader.close()
                    reader, name = ShardReader(shards[at]), shards[at]
                keys = np.fromiter((key_of(d, n) for d, n in zip(ids[at:end], numbers[at:end], strict=True)), np.uint64, end - at)
                for start, count in zip(*(x.tolist() for x in reader.find(keys)), strict=True):
                    if start < 0:
                        raise ValueError(f"a document is missing from {name}")
                    crcs.append(zlib.crc32(reader.ids(start, count).astype("<u4").tobytes()))
                    starts.append(start + bases[at])
                    counts.append(count)
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (starts, counts, crcs))], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        if reader:
            reader.close()

    kind = rows.schema["doc_id"].dataType.simpleString()
    # As many tasks as the ids ask for: their rows alone are small and would be merged into few.
    tasks = tasks_for(rows.sparkSession, rows.agg(F.sum("n_ids")).first()[0], READ_IDS)
    dealt = rows.select("doc_id", "number", "shard", "base").repartitionByRange(tasks, "shard", "doc_id", "number").sortWithinPartitions("shard", "doc_id", "number")
    return dealt.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, shard: str, doc_id, number: int = 0) -> np.ndarray | None:
    """The ids of one document of a shard, or None if it has no such document."""
    reader = ShardReader(shard)
    start, count = (int(x[0]) for x in reader.find(np.array([key_of(doc_id, number)], np.uint64)))
    out = reader.ids(start, count) if start >= 0 else None
    reader.close()
    return out


def default_tokenizer() -> str:
    from public_tokenizers import path

    return path("byte_bpe_50k.json")


def op10(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files."""
    return read_documents(write_shards(docs, tokenizer or default_tokenizer()))
