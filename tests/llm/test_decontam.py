import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tablemill.llm import decontam


def plain(docs, items):
    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    out = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for item, body in items:
            x = words(body)
            k = min(10, len(x))
            for i in range(len(x) - k + 1 if k else 0):
                for p in range(len(own) - k + 1):
                    if own[p : p + k] == x[i : i + k]:
                        hit.update(range(p, p + k))
                        found |= {str(item)} - {"None"}
        out.append((doc, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture
def tables(spark):
    rng = random.Random(3)
    words = ["The", "cat", "sät", "on", "a", "mat", "9", "x_y", "dog's", "Über"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(2, 30))) for i in range(12)] + [(20, "cat dog"), (21, ""), (22, None), (None, text(14)), (3, text(12))]
    docs = [(i, text(rng.randrange(60)) + (" " + (items[i % 17][1] or "") if i % 3 == 0 else "")) for i in range(60)]
    docs += [(100, None), (101, ""), (None, items[0][1].upper()), (5, docs[5][1]), (102, ("word " * 5000) + items[1][1])]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return docs, items, *frames


@pytest.mark.parametrize("most", [decontam.MAX_WORDS, 0])
def test_both_ways_match_brute_force(tables, most):
    docs, items, d, b = tables
    found = decontam.scan(d.withColumn("n_hit", F.lit("clash")), b, max_words=most)
    assert found.columns == ["doc_id", "text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r) for r in found.drop("text").collect()), key=str) == plain(docs, items)


def test_empty_tables(spark, tables):
    _, _, d, b = tables
    assert decontam.op5(d.limit(0), b).count() == 0
    assert decontam.op5(d, b.limit(0)).filter("contaminated").count() == 0
    assert decontam.remove_documents(d, b).columns == ["doc_id", "text"]


def test_a_set_takes_what_is_said_of_it():
    """A tenth of the words that a set may hold, all of them distinct: bytes a word when it is made, and when it is kept."""
    import tracemalloc

    n = decontam.MAX_WORDS // 10
    items = [(i, " ".join(f"word{j:07d}" for j in range(100 * i, 100 * i + 100))) for i in range(n // 100)]
    tracemalloc.start()
    windows = decontam.Windows(items)
    kept, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(windows.words) == n and kept <= 190 * n and most <= 330 * n
    assert len(windows.widths[10][0]) == n // 100 * 91


def test_a_window_of_many_items_names_them_all(spark):
    same = " ".join(f"w{i}" for i in range(10))
    bench = spark.createDataFrame([(i, f"{same} own{i}") for i in range(300)], "item_id long, text string")
    row = decontam.op5(spark.createDataFrame([(1, f"before {same} after")], "doc_id long, text string"), bench).first()
    assert (row.n_words, row.n_hit, row.n_items) == (12, 10, 300)
