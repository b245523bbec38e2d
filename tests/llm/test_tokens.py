import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablemill.llm import tokens

SPECIAL = "a <|endoftext|> b"
TEXTS = ["Hello  world's\n\n end \n", "", None, "Ünïcode 한국어 ١٢٣ 　x", SPECIAL, "x" * 5000, "It's 12345 o'clock!!  \t\n", "same", "same"]


def rows():
    return [(i * 7 % 50 - 3, t) for i, t in enumerate(TEXTS * 6)] + [(None, "no id"), (4, "tie b"), (4, "tie a"), (4, "tie a")]


def test_files_hold_what_the_library_gives(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    kept = tokens.write_shards(docs, tokens.default_tokenizer(), shards=4)
    found = {}
    for r in tokens.read_documents(kept).collect():
        found.setdefault(r.start, tuple(r))
    library, start, expected = Tokenizer.from_file(tokens.default_tokenizer()), 0, []
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    for doc_id, text in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]])):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [found[s] for s in sorted(found)] == expected


def test_encoder_matches_the_library_on_odd_texts():
    import random

    rng = random.Random(4)
    chars = " \n\t\x0b\r'sStlrevmd09²½aZéßɏªº_-!.\x85\xa0\x1c\x00ɐ中"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(30))) for _ in range(3000)]
    encoder, library = tokens.Encoder(Path(tokens.default_tokenizer()).read_text()), Tokenizer.from_file(tokens.default_tokenizer())
    for at in range(0, 3000, 500):
        for text, data in zip(texts[at : at + 500], encoder(texts[at : at + 500]), strict=True):
            assert np.frombuffer(data, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_hot_id_is_spread_over_shards(spark):
    docs = spark.createDataFrame([(7, f"text {i % 3}") for i in range(300)] + [(1, "a"), (9, "b")], "doc_id long, text string").repartition(4)
    kept = tokens.write_shards(docs, tokens.default_tokenizer(), shards=6)
    assert kept.groupBy("shard").count().agg(F.max("count")).first()[0] < 150
    found = sorted((r.start, r.doc_id, r.n_tokens) for r in tokens.read_documents(kept).collect())
    assert [r[1] for r in found] == [1, *[7] * 300, 9]
    assert all(a[0] + a[2] == b[0] for a, b in zip(found, found[1:], strict=False))


def test_lookup_by_key(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    shard = tokens.write_shards(docs, tokens.default_tokenizer(), shards=1).first().shard
    assert tokens.lookup(spark, shard, 2).tolist()[-1] == 2
    assert tokens.lookup(spark, shard, 3) is None
    assert tokens.lookup(spark, shard, 2, number=1) is None


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 20_000).astype(np.uint64)
    index = tokens.PerfectHash.build(keys)
    assert sorted(index.find(keys)) == list(range(len(np.unique(keys))))
    other = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert (index.find(other) == -1).mean() > 0.999


def test_empty_table(spark):
    assert tokens.op10(spark.createDataFrame([], "doc_id long, text string")).count() == 0
