import gzip
import hashlib
import json
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import functions as F

from tablemill.llm import warc

BIG = "<p>Größe</p>" * 100
ROWS = [(1, "http://a.org/x", BIG), (2, "http://b.org/", BIG), (3, None, "small"), (4, "http://c\r\nX: 1", "small"), (5, "u", None), (6, "u", ""),
        (None, "n", BIG), (7, "v", "\r\n\r\n" * 300), (8, "w", "x" * 3_000_000), (9, "w", "\r\n\r\n" * 300), (9, "w", "\r\n\r\n" * 300)]


def expected():
    out = []
    for page_id, _, html in ROWS:
        body = (html or "").encode()
        same = [p for p, _, h in ROWS if (h or "") == (html or "") and p is not None]
        last = max(same, default=None)
        revisit = len(body) >= 1000 and page_id != last
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3).withColumn("seq", F.lit("clash"))
    assert sorted(map(tuple, warc.op3(pages).collect()), key=str) == expected()


def test_members_and_sidecar(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    rows = warc.write_monolithic(pages)
    source = Path(urlparse(rows.first().archive).path).read_bytes()
    whole = gzip.decompress(source)
    index = warc.normalise(warc.revisits(rows)).orderBy("offset").collect()
    path = Path(urlparse(index[0].archive).path)
    data = path.read_bytes()
    members = [gzip.decompress(data[r.offset : r.offset + r.length]) for r in index]
    assert len(members) == len(ROWS) and gzip.decompress(data) == b"".join(members)
    assert all(m.startswith(b"WARC/1.0\r\n") for m in members)
    assert sum(b"WARC-Type: revisit" in m for m in members) == 3
    assert all(m in whole for m in members if b"WARC-Type: response" in m)
    side = [json.loads(x) for x in path.with_name(path.name.replace(".warc.gz", ".idx")).read_text().splitlines()]
    assert [(x["offset"], x["length"]) for x in side] == [(r.offset, r.length) for r in index]


def test_stream_of_many_members_reads_alike(tmp_path):
    record = warc.record_of(1, "u", b"body", hashlib.sha1(b"body").hexdigest())
    path = tmp_path / "x.warc.gz"
    path.write_bytes(gzip.compress(record) + gzip.compress(record + record))
    assert list(warc.records_of(f"file://{path}")) == [record] * 3


def test_empty_table(spark):
    assert warc.op3(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_text_ids_of_any_characters(spark):
    ids = [" outer ", "line\r\nX-Other: 1", "", "ü%41", "a:b", None, "last"]
    rows = [(i, "u", BIG) for i in ids]
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.op3(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    top = max(i for i in ids if i is not None)
    assert got == {i: ("response", None) if i == top else ("revisit", top) for i in ids}
