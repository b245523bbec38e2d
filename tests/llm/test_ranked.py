import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemill.llm import ranked


def plain(docs, items, k=10):
    """The definition, with one score for each document and item."""

    def terms(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    own = [(d, terms(t)) for d, t in docs]
    own = [(d, t) for d, t in own if t]
    n_docs, total = len(own), sum(len(t) for _, t in own)
    df = {}
    for _, t in own:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        found = []
        for d, t in own:
            m, score = 100 - 75 + 75 * len(t) * n_docs // total, 0
            for w in terms(text):
                if tf := t.count(w):
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def tables(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "über", "Ä9", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]

    def text(n):
        return "".join(w + rng.choice([" ", ", ", "_", "\n"]) for w in rng.choices(words, weights, k=n))

    docs = [(i, text(rng.choice([0, 1, 3, 20, 60, 300]))) for i in range(250)]
    docs += [(300, None), (301, ""), (None, docs[5][1]), (5, docs[5][1]), (6, docs[7][1]), (302, "the " * 3000 + docs[3][1])]
    docs += [(400 + i, docs[9][1]) for i in range(60)]
    items = [(i, text(rng.choice([1, 2, 5, 30]))) for i in range(20)] + [(30, ""), (31, None), (32, "nowhere to be met"), (33, "w0 w0 w0 w1"), (33, "w3"), (None, "w2 the"), (34, docs[9][1])]
    return docs, items


@pytest.mark.parametrize(("shard_docs", "max_terms", "k"), [(20_000, 1_000_000, 10), (7, 1_000_000, 10), (40, 60, 3)])
def test_matches_brute_force(spark, shard_docs, max_terms, k):
    docs, items = tables(shard_docs)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"number": F.lit("clash"), "terms": F.lit(1)}).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    found = ranked.rank(d, b, k, max_terms, shard_docs=shard_docs)
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(docs, items, k)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.op13(d.limit(0), b).count() == 0
    assert ranked.op13(d, b.limit(0)).count() == 0
    assert [r.doc_id for r in ranked.op13(d, b).collect()] == [1]
    assert ranked.op13(spark.createDataFrame([(1, None), (2, " .")], d.schema), b).count() == 0


def test_non_essential_lists_are_only_probed():
    """A rare term decides; the common one's whole list isn't added up once the best are known."""
    common, rare = np.arange(1000), np.arange(20)
    shard = ranked.Shard(np.full(1000, 50), np.array([0, 1]), np.array([1000, 1020]), np.concatenate([common, rare]), np.ones(1020, np.int64))
    search = ranked.Search([(0, np.array([0, 1]), np.array([1, 1]))], np.array([1, 5000]), 1000, 50_000, 10)
    search.shard(list(range(1000)), shard)
    assert [d for _, _, d in search.best[0]] == list(range(10))
    floor = search.best[0][-1][0]
    search.shard(list(range(1000, 2000)), shard)  # a later shard can't better what is known, but for ties with smaller ids
    assert search.best[0][-1][0] == floor and [d for _, _, d in search.best[0]] == list(range(10))


def test_norms_of_very_long_texts():
    assert ranked.norms(np.array([10**12, 5]), 10**10, 10**13).tolist() == [100 - 75 + 75 * n * 10**10 // 10**13 for n in (10**12, 5)]
