import random

import pytest

import corpus_pipeline
from tablemill.llm import similar

SCHEMA = "doc_id long, text string"


def plain_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_representatives(rows):
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def corpus():
    """Texts with copies in which some words differ, common lines, and short, equal and empty texts."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    line = [rng.choice(words) for _ in range(25)]
    rows = []
    for i in range(60):
        own = [rng.choice(words) for _ in range(rng.randrange(40, 300))]
        if i % 2:
            own[3:3] = line
        rows.append((1000 + i, " ".join(own)))
        for k in range(3):
            copy = list(own)
            for _ in range(rng.randrange(1, 2 + len(own) // 40)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(1000)}"
            rows.append((10 * i + k, " ".join(copy)))
    rows += [(2000, ""), (2001, None), (2002, "one two"), (2003, "One  two"), (2004, "a b c d e f g h"), (2005, "a b c d e f g h i"), (2006, "a b c d e f g")]
    return rows


def test_pipeline_stage_finds_similar_texts(spark):
    rows = corpus()
    sets = [plain_set(t) for _, t in rows]
    edge = [s for i, x in enumerate(sets) for y in sets[:i] if 0.8 <= (s := jaccard(x, y)) < 0.95]
    assert len(edge) > 20 and min(edge) < 0.82
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in got.collect()) == plain_representatives(rows)


@pytest.mark.parametrize("block", [2, 40])
def test_blocks_and_sample_change_nothing(spark, block):
    rows = corpus()
    got = similar.representatives(spark.createDataFrame(rows, SCHEMA).repartition(3), sample=40, block=block)
    assert sorted(r.doc_id for r in got.collect()) == plain_representatives(rows)


@pytest.mark.parametrize("block", [9, 4096])
def test_one_list_of_many_groups(spark, block):
    """Variants of one text, of which some are just alike and most just not, so that one list has many groups and tries many pairs in vain."""
    rng = random.Random(block)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        own = list(base)
        for at in rng.sample(range(0, 120, 6), rng.choice([1, 2, 3, 4])):
            own[at] = f"v{i}-{at}"
        rows.append((i, " ".join(own)))
    sets = [plain_set(t) for _, t in rows]
    alike = [jaccard(x, y) >= 0.8 for i, x in enumerate(sets) for y in sets[:i]]
    assert 100 < sum(alike) < len(alike) / 2 and len(plain_representatives(rows)) > 10
    got = similar.representatives(spark.createDataFrame(rows, SCHEMA).repartition(3), sample=40, block=block)
    assert sorted(r.doc_id for r in got.collect()) == plain_representatives(rows)


def test_a_list_goes_on_from_where_it_stopped():
    """Pairs come by distance, none twice, and all of them in the end, whatever the lists beside."""
    rng = random.Random(3)
    rows = [(key, 100 * key + i) for key in range(5) for i in range(rng.randrange(1, 14))]
    key, fp = ([r[i] for r in rows] for i in (0, 1))
    shape = [10 << 32] * len(rows)
    seen, step, times = [], {k: 1 for k in key}, 1
    while step:
        own = [i for i, k in enumerate(key) if k in step]
        columns = [[x[i] for i in own] for x in (key, fp, shape, fp)] + [[b"\0" * 8] * len(own), [step[key[i]] for i in own]]
        batch = similar.pa.RecordBatch.from_arrays([similar.pa.array(x) for x in columns], names=["key", "fp", "shape", "root", "bits", "step"])
        out = [r for b in similar._next_pairs(times)(iter([batch.slice(0, 7), batch.slice(7)])) for r in b.to_pylist()]
        seen += [(r["a"], r["b"]) for r in out if r["a"] is not None]
        step, times = {r["key"]: r["step"] for r in out if r["key"] is not None}, 2 * times
    assert sorted(seen) == sorted((a, b) for a in fp for b in fp if a < b and a // 100 == b // 100)


def test_multi_index_hashing_links_close_copies(spark):
    """Sets whose SimHashes differ in three bits or fewer are tried, however they share elements; prefix filtering has no part in it."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(30):
        own = [rng.choice(words) for _ in range(600)]
        rows.append((10 * i, " ".join(own)))
        own[300] = "other"
        rows.append((10 * i + 1, " ".join(own)))
    sketched = similar.sketches(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    sims = {r.fp: r.sim & (1 << 64) - 1 for r in sketched}
    doc = {r.fp: r.doc_id for r in sketched}
    expected = {tuple(sorted((a, b))) for a in sims for b in sims if a < b and (sims[a] ^ sims[b]).bit_count() <= 3}
    sets = spark.createDataFrame([(r.fp, r.sim) for r in sketched] + [(7, sketched[0].sim)], "fp long, sim long")
    got = {(r.a, r.b) for r in similar.by_fingerprint(sets).collect()}
    assert len(expected) > 15 and all(doc[a] // 10 == doc[b] // 10 for a, b in expected)
    assert {p for p in got if 7 not in p} <= expected and any(7 in p for p in got)
    root = {x: x for x in [*sims, 7]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in expected) and find(7) == find(sketched[0].fp)
