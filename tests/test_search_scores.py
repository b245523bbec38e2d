"""The search against the definition of its tiers and scores, value by value."""

import random
import re
import unicodedata
from difflib import SequenceMatcher

import pytest

from tablemill.operators import search


def plain(text):
    return " ".join(re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", text).casefold()).split())


def grams(text):
    solid = text.replace(" ", "")
    return {solid[i : i + 3] for i in range(len(solid) - 2)} or {solid}


def expected(query, value):
    q, v = plain(query), plain(value)
    if not q or not v:
        return None
    if query == value:
        return 0, 1.0
    if q == v:
        return 1, 1.0
    if v.startswith(q):
        return 2, len(q) / len(v)
    if set(q.split()) <= set(v.split()):
        return 3, len(q.split()) / len(v.split())
    if q in v:
        return 4, len(q) / len(v)
    score = max(SequenceMatcher(None, q, v, autojunk=False).ratio(), len(grams(q) & grams(v)) / len(grams(q) | grams(v)))
    return (5, score) if len(q) >= 3 and len(v) <= 256 and score >= (0.72 if len(q) >= 5 else 0.80) else None


@pytest.mark.parametrize("query", ["ab", "abc d", "Ab-cd e", "ÉCOLE ab", "aabbccdd", "e", "?!"])
def test_every_value_gets_its_tier_and_score(spark, query):
    rng = random.Random(7)
    values = {"".join(rng.choice("abcdeÉ _-ﬁ") for _ in range(rng.randrange(1, 12))) for _ in range(700)} | {query, query.upper(), "ecole  AB", "a" * 300, "x\ny", ""}
    df = spark.createDataFrame([(v,) for v in sorted(values)], "v string")
    got = {r.value: (r.tier, r.score) for r in search.search_values(df, query, "v", limit=10_000).collect()}
    want = {v: e for v in values if (e := expected(query, v))}
    assert got.keys() == want.keys()
    assert all(got[v][0] == t and got[v][1] == pytest.approx(s) for v, (t, s) in want.items())


def test_bounded_search_finds_typos_and_keeps_alike_ones_from_the_same_text(spark):
    df = spark.createDataFrame([("Avangard Omsk",), ("Avangard Omsk II",), ("Dynamo Moscow",)], "v string")
    assert [r.value for r in search.search_values_bounded(df, "Avangrd Omsk", "v").collect()][0] == "Avangard Omsk"
    assert [r.value for r in search.search_values_bounded(df, "Xvangard", "v").collect()] == ["Avangard Omsk"][: 0 if not expected("Xvangard", "Avangard Omsk") else 1]
    assert [(r.value, r.tier) for r in search.search_values_bounded(df, "avangard omsk", "v").collect()] == [("Avangard Omsk", 1), ("Avangard Omsk II", 2)]
    many = spark.createDataFrame([(f"Alpha Team {i:05d}",) for i in range(500)], "v string")
    first = search.search_values_bounded(many, "Alpha Team", "v", candidates=100).collect()
    assert len(first) == 20 and all(r.capped for r in first)
    assert {r.value for r in search.search_values_bounded(many, "Alpha Team", "v", offset=20, candidates=100).collect()}.isdisjoint({r.value for r in first})


def test_pieces():
    assert search.pieces("Ab-cd") == (["3abc", "3bcd"], ["wab", "wcd"])
    assert search.pieces("ab") == (["3ab"], ["wab"])


@pytest.mark.parametrize("query", ["abc d", "Ab-cd e", "ÉCOLE ab", "aabbccdd", "abc", "ab", "?!"])
def test_the_index_finds_what_a_search_of_all_values_finds(spark, query):
    rng = random.Random(9)
    values = ["".join(rng.choice("abcdeÉ _-ﬁ") for _ in range(rng.randrange(1, 14))) for _ in range(600)] + [query, query.upper(), "a" * 300, "aaaa", "aaaaaaaaaaaa", None, ""]
    df = spark.createDataFrame([(v, v[::-1] if v else v) for v in values], "v string, w string")
    index = search.ValueIndex.build({"t": df})
    everything = search.search_values(df, query, limit=10_000)
    assert sorted(map(str, index.search(query, limit=10_000).drop("table").collect())) == sorted(map(str, everything.collect()))
    for n in (4096, 30, 1):
        own = index.search_bounded(query, 10_000, candidates=n).drop("table").collect()
        assert sorted(map(str, own)) == sorted(map(str, search.search_values_bounded(df, query, limit=10_000, candidates=n).collect()))


def test_a_query_reads_its_own_postings_alone(spark):
    df = spark.createDataFrame([(f"value number {i}",) for i in range(3000)], "v string")
    index = search.ValueIndex.build({"t": df})
    assert [r.value for r in index.search("valeu number 77", 3).collect()][0] == "value number 77"
    plan = index.search_bounded("valeu number 77")._jdf.queryExecution().executedPlan().toString()
    assert "In(piece" in plan and "postings" in plan.replace("value-index", "postings")
    assert index._hits("number 77").count() == 3000 and index._hits("zzz").count() == 0
