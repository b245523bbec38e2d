"""The pipeline against plain Python, stage by stage, on a small corpus with planted cases."""

import random
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
import pytest
from test_decontam import plain as plain_hits
from test_similar import plain_representatives
from tokenizers import Tokenizer

from tablemill.llm import mixing, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(rng.randrange(12, 30)))) for i in range(6)]
    docs = []
    for i in range(160):
        own = text(rng.randrange(20, 200))
        if i % 5 == 0:
            own[rng.randrange(len(own))] = own[0] = "grobble"
        if i % 16 == 3:
            own[5:5] = items[i % 6][1].split()
        docs.append([i, " ".join(own), "en", f"s{i % 3}"])
    for i in range(20):
        docs.append([200 + i, docs[2 * i + 1][1] + (" tail" if i % 2 and i > 9 else ""), "en", f"s{i % 3}"])
    docs += [[300, None, None, None], [301, "", "en", "s0"], [None, "a text without any id at all", "en", None]]
    docs = [(*d, len(d[1]) if d[1] is not None else None) for d in docs]
    root = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 160, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), docs, items


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_every_stage(spark, corpus):
    root, docs, items = corpus
    frame = spark.read.parquet(f"{root}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near-duplicates", "decontamination", "mixing", "token ids"]

    model = toxicity.train(frame, spark.read.parquet(f"{root}/labels.parquet"))
    clean = [d for d in docs if model.chances(d[1])[0] < 0.5]
    got = stages["toxicity"](spark, frame, root)
    assert rows(got) == sorted(clean, key=str)
    assert not any("grobble" in (d[1] or "") for d in clean) and len(clean) >= len(docs) - 32 - 5

    # The stage's rule is a similarity of 0.8 over five words, not the three bits of op2's contract.
    last = 1 << 40  # null ids are the largest
    keep = plain_representatives([(last if d[0] is None else d[0], d[1]) for d in clean])
    first = [d for d in clean if (last if d[0] is None else d[0]) in keep]
    got = stages["near-duplicates"](spark, got, root)
    assert rows(got) == sorted(first, key=str) and len(first) < len(clean)

    hit = {d for d, *_, bad in plain_hits([d[:2] for d in first], items) if bad}
    kept = [d for d in first if d[0] not in hit]
    got = stages["decontamination"](spark, got, root)
    assert rows(got) == sorted(kept, key=str) and hit

    documents = pd.DataFrame([(d[0], d[1], d[3]) for d in kept], columns=["doc_id", "text", "source"])
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    plan = {r[0]: r for r in duckdb.sql(f"SELECT doc_id, size, taken FROM ({mixing.SQL})").fetchall()}
    took = {d: taken for d, _, taken in plan.values()}
    got = stages["mixing"](spark, got, root)
    mixed = rows(got)
    assert {d: sum(len((x[1] or "").split()) for x in mixed if x[0] == d) for d in took} == took
    assert all(mixed.count(x) <= 2 for x in mixed) and got.columns == frame.columns

    library, start, expected = Tokenizer.from_file(tokens.default_tokenizer()), 0, []
    for doc_id, text, *_ in sorted(mixed, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(stages["token ids"](spark, got, root)) == sorted(expected, key=str)


def test_run_gives_what_the_stages_give(spark, corpus):
    root, *_ = corpus
    found = rows(corpus_pipeline.run(spark, root))
    total = sum(r[2] for r in found)
    starts = sorted((r[1], r[2]) for r in found)
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(len(starts))] and starts[-1][0] + starts[-1][1] == total


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
