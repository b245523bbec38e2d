import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemill.llm import toxicity

BAD = ["grobble", "snarfed", "vile", "wretch"]


def rows(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        text, toxic = [rng.choice(words) for _ in range(rng.randrange(5, 300))], int(i % 5 == 0)
        if toxic:
            for _ in range(max(1, len(text) // rng.choice([8, 20, 60]))):
                text[rng.randrange(len(text))] = rng.choice(BAD)
        out.append((i, " ".join(text), toxic))
    return out


@pytest.fixture(scope="module")
def model():
    return toxicity.fit([(t, y) for _, t, y in rows(600, 1)])


def test_held_out_accuracy(spark, model):
    held = rows(1000, 1)[600:]  # the first 600 are what the model was fitted on
    found = toxicity.score(spark.createDataFrame(held, "doc_id long, text string, toxic_label int"), model).collect()
    assert np.mean([r.toxic == bool(r.toxic_label) for r in found]) > 0.97
    assert model.cuts == sorted(model.cuts) and len(model.cuts) == 3
    assert all(0 <= r.severity <= 3 and (r.grade > 0) == r.toxic for r in found)


def test_more_is_worse(model):
    clean = "some plain words in a row here now"
    s = [model.chances(clean + " " + " ".join(BAD[:k] * 3)).sum() for k in range(4)]
    assert s == sorted(s) and s[0] < 0.5 < s[3]


def test_edges(spark, model):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "vile wretch vile grobble"), (3, "ok " * 50_000), (3, "ok " * 50_000)], "doc_id long, text string")
    found = toxicity.score(docs.withColumn("grade", F.lit("clash")), model)
    assert found.columns == ["doc_id", "text", "severity", "grade", "toxic"]
    assert [r.toxic for r in found.collect()] == [False, False, True, False, False]
    assert toxicity.remove_toxic(docs, model).columns == ["doc_id", "text"]
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.op8(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.filter("toxic OR severity > 0").count() == 0


def test_training_is_bounded_and_repeatable(spark):
    data = rows(200, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    a, b = toxicity.train(docs, labels), toxicity.train(docs.repartition(5), labels.repartition(3))
    assert a.weights == b.weights and a.cuts == b.cuts
    assert toxicity.train(docs, labels, sample=0).cuts == []
