import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tablemill.llm import simhash


def plain_fingerprint(text):
    """The definition, word by word."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    ids, fps = [r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return sorted(((d, f"{fps[i]:016x}", least[find(i)]) for i, d in enumerate(ids)), key=str)


def test_fingerprint_matches_spark_hash(spark):
    text = "Ärger Über alles  IN the world\x0bof\tTHE words"
    assert simhash.fingerprint(text) == plain_fingerprint(text)
    one = spark.createDataFrame([("a b c",)], "s string").select(F.xxhash64("s")).first()[0] % (1 << 64)
    assert simhash.fingerprint("A b\nC") == one
    assert simhash.fingerprint("") == simhash.fingerprint(None) == 0


@pytest.mark.parametrize("block", [2, 4096])
def test_groups_match_brute_force(spark, block):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows, base = [], [rng.choice(words) for _ in range(300)]
    for i in range(120):
        text = list(base) if i % 2 else [rng.choice(words) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            if text:
                text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    rows += [(500, None), (501, ""), (None, "left alone here now"), (7, rows[7][1]), (502, rows[3][1].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    found = simhash.near_duplicates(docs, block=block).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert sorted(map(tuple, found.collect()), key=str) == plain_components(rows)


def test_dense_cell_spans_without_all_pairs():
    import numpy as np

    fps = np.arange(512, dtype=np.uint64)  # nine bits, each next to its neighbours
    links = simhash.spanning(fps, 3)
    assert len(links) == 511
    assert all((a ^ b).bit_count() <= 3 for a, b in links)


def test_empty_table(spark):
    assert simhash.op2(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_row_of_each_group_stays(spark):
    a, b = "the quick brown fox jumps over the lazy dog", "pack my box with five dozen liquor jugs now"
    rows = [(3, a, "x"), (2, a, "y"), (2, a, "b"), (None, a, "z"), (7, b, "q"), (None, "all alone with no id at all", "n"), (None, "all alone with no id at all", "m"), (8, None, "e"), (9, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(2, a, "b"), (7, b, "q"), (None, "all alone with no id at all", "m"), (8, None, "e")], key=str)
