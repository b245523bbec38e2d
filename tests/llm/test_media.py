import hashlib
import tarfile
import zlib
from urllib.parse import urlparse

from pyspark.sql import functions as F

from tablemill.llm import media

ROWS = [(1, "a" * 576), (2, "a" * 577), (3, ""), (4, None), (None, "ünïcode"), (5, "ünïcode"), (5, "ünïcode"), (6, "long " * 60_000)]


def test_round_trip(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    found = media.op1(docs).collect()
    expected = []
    for doc_id, text in ROWS:
        raw = (text or "").encode()
        body = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        expected.append((doc_id, len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:])))
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(expected, key=str)
    for key in ("media_sha256", "media_bytes", "feature"):
        assert len({(r.payload_sha256, r[key]) for r in found}) == len({r.payload_sha256 for r in found})


def test_shards_are_tars_named_by_content(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1).withColumn("length", F.lit("clash"))
    kept = media.write_media(docs)
    assert kept.columns == ["doc_id", "n_bytes", "digest", "shard", "offset", "length"]
    rows = kept.collect()
    with tarfile.open(urlparse(rows[0].shard).path) as tar:
        members = {m.name: tar.extractfile(m).read() for m in tar}
    assert len(members) == len({r.digest for r in rows}) == 5
    for r in rows:
        data = members[f"{r.digest}.png"]
        assert len(data) == r.length and hashlib.sha256(media.samples_of(data)).hexdigest() == r.digest


def test_headers_need_no_whole_members(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = {r.n_bytes: (r.width, r.height, r.bit_depth, r.color_type) for r in media.header_columns(media.write_media(docs)).collect()}
    assert got[577] == (576, 2, 8, 0) and got[0] == (576, 1, 8, 0)


def test_empty_table(spark):
    assert media.op1(spark.createDataFrame([], "doc_id long, text string")).count() == 0
