import random
from functools import cache

from pyspark.sql import functions as F

from tablemill.llm import unigram

SCORES = {"▁": -1.0, "a": -2.0, "b": -2.5, "ab": -2.2, "▁a": -1.5, "ba": -3.0, "abab": -9.0, "c": -2.0, "▁ab": -3.5, "cc": -4.0}


def plain(word):
    """Every way to cut the word."""

    @cache
    def best(rest):
        if not rest:
            return (0.0, 0)
        ways = [(best(rest[:-1])[0] + unigram.UNKNOWN, best(rest[:-1])[1] - len(rest[-1].encode()))]
        ways += [(best(rest[: -len(p)])[0] + s, best(rest[: -len(p)])[1] - 1) for p, s in SCORES.items() if rest.endswith(p)]
        return max(ways)

    return -best(word)[1]


def test_matches_every_way_to_cut(spark):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(12))) for _ in range(150)]
    texts += [None, "", " \n\t", "ab " * 20_000, texts[0]]
    docs = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    for nodes in (unigram.NODES, 3):
        found = unigram.token_counts(docs, SCORES, nodes)
        assert found.columns == ["doc_id", "text", "n_words", "n_tokens"]
        for r in found.collect():
            words = (r.text or "").split()
            assert (r.n_words, r.n_tokens) == (len(words), sum(plain("▁" + w) for w in words))


def test_prefixes_are_shared():
    trie = unigram.Trie(SCORES)
    trie.insert("▁abab")
    before = len(trie.next)
    trie.insert("▁aba")
    trie.insert("▁abac")
    assert len(trie.next) == before + 1


def test_public_vocabulary(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None)], "doc_id long, text string")
    (a, b) = sorted(map(tuple, unigram.op6(docs).collect()))
    assert a[:2] == (1, 6) and 6 <= a[2] <= 9 and b == (2, 0, 0)
    assert unigram.op6(docs.limit(0)).count() == 0
