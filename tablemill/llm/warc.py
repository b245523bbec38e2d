"""WARC archives: writing, normalising monolithic gzip, and reading by a sidecar index.

``write_monolithic`` writes one archive a task as a single gzip stream, the form in which many
crawls arrive and that can't be read from the middle. ``normalise`` inflates each such stream
once, in bounded memory, rewrites every record as a gzip member of its own, and writes beside
it a sidecar index of offsets (``*.idx``, a JSON object a line). Records whose payload another
record holds become revisits on the way. ``read_records`` reads members by offset.

Payloads never pass through a shuffle: which records are revisits is decided on digests, and
dealt out to the archives as small rows.

Edge cases: a null payload is empty; null urls and ids leave their header out; control
characters in urls are escaped; of equal payloads of at least ``LEAST`` bytes the rows with the
largest page_id are responses (all of them, if rows repeat it; all, if every id is null) and
the others revisits of it; an empty table writes no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import open_fs, shared_dir, tasks_for, written

LEAST = 1000
#: Bytes of members that one task reads back.
READ_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 20
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def record_of(page_id, url: str | None, payload: bytes, digest: str) -> bytes:
    """A response record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.0", "WARC-Type: response", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{_base32(digest)}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-ID: {quote(str(page_id), safe='')}")
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + END + http + payload + END


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def revisit_of(record: bytes, refers_to) -> bytes:
    """The record without its payload, as a revisit of the page ``refers_to`` with the same payload."""
    head, _, block = record[: -len(END)].partition(END)
    http = block.partition(END)[0] + END
    fields = fields_of(head)
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    lines = [line for line in head.split(b"\r\n") if not line.lower().startswith((b"warc-type:", b"content-length:"))]
    more = ["WARC-Type: revisit", f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {quote(str(refers_to), safe='')}", f"Content-Length: {len(http)}"]
    return b"\r\n".join([*lines, *(x.encode() for x in more)]) + END + http + END


def write_monolithic(pages: DataFrame) -> DataFrame:
    """Writes the archives; (page_id, archive, seq, payload_bytes, digest) for every row of ``pages``."""
    folder, kind = shared_dir(pages.sparkSession, "warc"), pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, out, seq, packer = TaskContext.get(), None, 0, zlib.compressobj(6, zlib.DEFLATED, 31)
        name = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        for batch in batches:
            if out is None and batch.num_rows:
                fs, path = open_fs(name)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
            sizes, digests = [], []
            ids = batch.column(0).to_pylist()
            for page_id, url, html in zip(ids, batch.column(1).to_pylist(), batch.column(2), strict=True):
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                sizes.append(len(payload))
                digests.append(hashlib.sha1(payload).hexdigest())
                out.write(packer.compress(record_of(page_id, url, payload, digests[-1])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([name] * len(ids)), pa.array(range(seq, seq + len(ids)), pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests)],
                names=["page_id", "archive", "seq", "payload_bytes", "digest"],
            )
            seq += len(ids)
        if out is not None:
            out.write(packer.flush())
            out.close()

    rows = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, archive string, seq long, payload_bytes long, digest string")
    return written(rows, "warc-rows")


def revisits(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """``rows`` of ``write_monolithic`` as (archive, seq, refers_to): the response's page, or null for responses."""
    groups = rows.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    groups = written(groups.filter("n > 1 AND last IS NOT NULL").select("digest", "last"), "warc-groups")
    found = rows.join(groups, "digest", "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("last"))
    return found.select("archive", "seq", F.when(other & (F.col("payload_bytes") >= least), F.col("last")).alias("refers_to"))


def inflated(uri: str) -> Iterator[bytes]:
    """The bytes of a gzip file, one member or many, a chunk at a time."""
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as f:
        unpacker = None
        while data := f.read(CHUNK):
            while data or unpacker:
                unpacker = unpacker or zlib.decompressobj(31)
                out = unpacker.decompress(data, CHUNK)
                if out:
                    yield out
                if unpacker.eof:  # another member may follow
                    data, unpacker = unpacker.unused_data, None
                elif unpacker.unconsumed_tail or len(out) == CHUNK:
                    data = unpacker.unconsumed_tail
                else:
                    break
        if unpacker:
            raise ValueError(f"{uri} ends within a gzip member")


def records_of(uri: str) -> Iterator[bytes]:
    """The records of an archive, from a single pass over its inflated bytes."""
    held, need = bytearray(), None
    for data in inflated(uri):
        held += data
        while True:
            if need is None:
                end = held.find(END)
                if end < 0:
                    break
                need = end + 2 * len(END) + int(fields_of(bytes(held[:end]))["content-length"])
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError(f"{uri} ends within a record")


def normalise(decided: DataFrame) -> DataFrame:
    """Rewrites archives member by member; (archive, offset, length) for every record.

    ``decided`` has a row (archive, seq, refers_to) for every record of every archive.
    """
    folder = shared_dir(decided.sparkSession, "warc-members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, records, out, index, at = None, iter(()), None, None, 0

        def close() -> None:
            if out is not None:
                if next(records, None) is not None:
                    raise ValueError(f"{name} has more records than rows")
                out.close()
                index.close()

        for batch in batches:
            rows = []
            for archive, seq, refers_to in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if archive != name:
                    close()
                    stem = archive.rpartition("/")[2].removesuffix(".warc.gz")
                    target = f"{folder}/{stem}-{TaskContext.get().taskAttemptId()}.warc.gz"
                    fs, path = open_fs(target)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    name, records, at = archive, records_of(archive), 0
                    out, index = fs.open_output_stream(path, compression=None), fs.open_output_stream(path.removesuffix(".warc.gz") + ".idx", compression=None)
                record = next(records)
                if refers_to is not None:
                    record = revisit_of(record, refers_to)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record) + packer.flush()
                out.write(member)
                index.write((json.dumps({"seq": seq, "offset": at, "length": len(member)}) + "\n").encode())
                rows.append((target, at, len(member)))
                at += len(member)
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["archive", "offset", "length"])
        close()

    # A stream is one task's work; twice as many ranges as archives give each archive a task of its own.
    archives = decided.select("archive").distinct().count()
    dealt = decided.select("archive", "seq", "refers_to").repartitionByRange(max(1, 2 * archives), "archive").sortWithinPartitions("archive", "seq")
    return written(dealt.mapInArrow(run, "archive string, offset long, length long"), "warc-index")


def parsed(record: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id) of a record; digests are verified."""
    head, _, block = record[: -len(END)].partition(END)
    fields = fields_of(head)
    http, _, payload = block.partition(END)
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "response":
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    else:
        size = int(fields_of(http)["content-length"])
    page_id, refers_to = (None if x is None else unquote(x) for x in (fields.get("x-page-id"), fields.get("x-refers-to-page-id")))
    return page_id, size, digest, fields["warc-type"], refers_to, fields.get("warc-target-uri"), fields["warc-record-id"]


def read_records(index: DataFrame) -> DataFrame:
    """Every record of ``index`` (archive, offset, length), read from its own member alone."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if archive != name:
                    if file:
                        file.close()
                    fs, path = open_fs(archive)
                    name, file = archive, fs.open_input_file(path)
                rows.append(parsed(zlib.decompress(file.read_at(length, offset), 31)))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        if file:
            file.close()

    # As many tasks as the members' bytes ask for: the rows of the index alone are small and would be merged into few.
    tasks = tasks_for(index.sparkSession, index.agg(F.sum("length")).first()[0], READ_BYTES)
    spread = index.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return spread.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, record_id string")


def op3(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back."""
    found = read_records(normalise(revisits(write_monolithic(pages))))
    kind = pages.schema["page_id"].dataType
    found = found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
    return found.drop("url", "record_id")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM r"""
