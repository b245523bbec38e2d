"""Media columns: content-addressed payloads in tar shards.

Payloads are bytes of any kind. ``write_media`` stores each as an 8-bit grey PNG, named by the
SHA-256 of the payload, in one tar file per task; the rows carry digest, shard, offset and
length of the stored form and no bytes. Within a shard a payload is stored once. Rows are
written in one pass and without a shuffle of payloads. ``header_columns`` fills metadata
columns from the first bytes of each member by range reads; ``read_media`` reads members whole.

Edge cases: null and empty payloads are padded to one row of samples; equal payloads get equal
values; repeated rows point at the same member; an empty table writes no shard; all columns
but the payload are kept (columns named like added ones are replaced).
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.names import col
from tablemill.llm.common import open_fs, positional, shared_dir, tasks_for, written

#: Samples in a row of an image, and what payloads are padded to a multiple of.
ROW = 576
PAD = b"\xff"
PNG = b"\x89PNG\r\n\x1a\n"
#: Bytes that hold all of a PNG's header: signature, chunk length and name, and IHDR.
HEAD = 33
LEVEL = 6
#: Bytes of members that one task reads.
READ_BYTES = 64 << 20
ADDRESS = "n_bytes long, digest string, shard string, offset long, length long"
HEADER = "width int, height int, bit_depth int, color_type int"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(payload: bytes) -> bytes:
    return payload.ljust(max(1, -(-len(payload) // ROW)) * ROW, PAD)


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def png_of(payload: bytes) -> bytes:
    """A grey PNG with one row of samples for every ``ROW`` bytes, by rows without filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    plain = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(plain, LEVEL)) + _chunk(b"IEND", b"")


def header_of(data: bytes) -> tuple[int, int, int, int]:
    """(width, height, bit depth, colour type) from a PNG's first bytes."""
    if data[:8] != PNG or data[12:16] != b"IHDR":
        raise ValueError("the member is no PNG")
    return struct.unpack(">IIBB", data[16:26])


def samples_of(data: bytes) -> bytes:
    """The samples of a PNG that ``png_of`` wrote; checksums are verified."""
    width, height, _, _ = header_of(data)
    at, packed = 8, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        name, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(name + body):
            raise ValueError("a chunk of the member is damaged")
        if name == b"IDAT":
            packed.append(body)
        at += 12 + size
    plain = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if plain[:, 0].any():
        raise ValueError("a row of the member has a filter")
    return plain[:, 1:].tobytes()


class TarShard:
    """A tar file written member by member; each member's data offset is known at once."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.at, self.members = fs.open_output_stream(path, compression=None), 0, {}

    def add(self, digest: str, data: Callable[[], bytes]) -> tuple[int, int]:
        """(offset, length) of the member with this digest, which is stored unless it is there."""
        if digest not in self.members:
            body = data()
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(body)
            head = info.tobuf(tarfile.PAX_FORMAT)
            self.out.write(head + body + b"\0" * (-len(body) % 512))
            self.members[digest] = self.at + len(head), len(body)
            self.at += len(head) + len(body) + -len(body) % 512
        return self.members[digest]

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def _schema(df: DataFrame, added: str, without: str | None = None) -> tuple[list[str], T.StructType]:
    fields = T._parse_datatype_string(added)
    names = {f.name for f in fields}
    kept = [c for c in df.columns if c.lower() not in names and c != without]
    return kept, T.StructType([*df.select(*map(col, kept)).schema.fields, *fields])


def write_media(df: DataFrame, payload: str = "text") -> DataFrame:
    """``df`` without its payload column and with n_bytes, digest, shard, offset and length.

    A string payload is taken as UTF-8.
    """
    kept, schema = _schema(df, ADDRESS, payload)
    folder = shared_dir(df.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, shard = TaskContext.get(), None
        name = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}.tar"
        for batch in batches:
            if shard is None and batch.num_rows:
                shard = TarShard(name)
            rows = []
            for value in batch.column(0):
                raw = value.as_py() or b""
                raw = raw.encode("utf-8", "surrogatepass") if isinstance(raw, str) else raw
                body = padded(raw)
                digest = hashlib.sha256(body).hexdigest()
                rows.append((len(raw), digest, name, *shard.add(digest, lambda b=body: png_of(b))))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            extra = [pa.array(x, k) for x, k in zip(list(zip(*rows, strict=True)) or [[]] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *extra], names=[f.name for f in schema])
        if shard:
            shard.close()

    return written(positional(df, [payload, *kept]).mapInArrow(run, schema), "media-rows")


def _reading(df: DataFrame, added: str, length: Callable[[int], int], of: Callable[[bytes], tuple]) -> DataFrame:
    """``df`` with what ``of`` makes of the first ``length(size)`` bytes of each member.

    Rows are dealt by (shard, offset), so a task reads few shards, forwards, each member once.
    """
    kept, schema = _schema(df, added)
    at = [kept.index(c) for c in ("shard", "offset", "length")]
    types = [f.dataType for f in T._parse_datatype_string(added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds, name, file, spot, got = [to_arrow_type(t) for t in types], None, None, None, None
        for batch in batches:
            rows = []
            for shard, offset, size in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                if shard != name:
                    if file:
                        file.close()
                    fs, path = open_fs(shard)
                    name, file, spot = shard, fs.open_input_file(path), None
                if spot != offset:
                    spot, got = offset, of(file.read_at(length(size), offset))
                rows.append(got)
            extra = [pa.array(x, k) for x, k in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[f.name for f in schema])
        if file:
            file.close()

    # As many tasks as the members' bytes ask for: the rows alone are small and would be merged into few.
    tasks = tasks_for(df.sparkSession, df.agg(F.sum("length")).first()[0], READ_BYTES)
    spread = df.select(*map(col, kept)).repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")
    return positional(spread, kept).mapInArrow(run, schema)


def header_columns(media: DataFrame) -> DataFrame:
    """``media`` with width, height, bit_depth and color_type, from range reads of the headers alone."""
    return _reading(media, HEADER, lambda size: min(size, HEAD), header_of)


def features_of(data: bytes) -> tuple:
    """What ``read_media`` adds, from a stored member."""
    width, height, depth, _ = header_of(data[:HEAD])
    payload = samples_of(data)
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    mean, bits = float((counts * np.arange(256)).sum()) / len(payload), float(-(share * np.log2(share)).sum())
    feature = f"png {width}x{height} depth {depth} mean {mean:.3f} entropy {bits + 0.0:.3f}"
    digest = hashlib.sha256(payload).hexdigest()
    return len(payload), digest, zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature


def read_media(media: DataFrame) -> DataFrame:
    """``media`` with sizes, digests and a feature, from the stored members read whole."""
    return _reading(media, FEATURES, lambda size: size, features_of)


def op1(docs: DataFrame) -> DataFrame:
    """The contract's columns, read back from the shards, and the size of the image from its header."""
    names = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature width height"
    return read_media(header_columns(write_media(docs.select("doc_id", "text")))).select(*names.split())
