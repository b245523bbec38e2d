"""Odd columns, shared ids, long words and many tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablemill.llm import align, chat, common, decontam, media, mixing, ranked, similar, simhash, tokens, topk, toxicity, unigram, urlrules, warc

#: Names with dots, and names that operators use for themselves.
ODD = ["a.b", "__of", "__time", "__f", "__n", "__d", "row", "toxic", "severity", "n_hit", "repeats", "hash", "fp", "d", "h", "n", "rank", "size"]


def odd(docs):
    return docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in ODD}).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))


def whole(df):
    return sorted((str(r) for r in df.collect()), key=str)


def test_filtering_operators_keep_odd_columns(spark):
    texts = ["one two three four five six seven", "one two three four five six seven", "vile wretch grobble here", "alpha beta gamma delta", None, "", "x y z"]
    docs = odd(spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(texts)] + [(None, "x y z", None)], "doc_id long, text string, source string"))
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    model = toxicity.Model({b"<vile>": 9.0}, [2.0])
    rows = {r.doc_id: str(r) for r in docs.collect()}
    for got, ids in (
        (toxicity.remove_toxic(docs, model), {0, 1, 3, 4, 5, 6, None}),
        (simhash.representatives(docs), {0, 2, 3, 4, 6}),
        (similar.representatives(docs), {0, 2, 3, 4, 6}),
        (decontam.remove_documents(docs, bench), {0, 1, 2, 4, 5, 6, None}),
    ):
        assert got.columns == docs.columns
        assert whole(got) == sorted(rows[i] for i in ids)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and set(whole(mixed)) <= set(rows.values())
    assert tokens.op10(docs).count() == 8 and mixing.op4(docs).count() == 8


def test_added_columns_stand_beside_dotted_ones(spark):
    docs = spark.createDataFrame([(1, "vile words here", 5)], "doc_id long, text string, `a.b` int")
    bench = spark.createDataFrame([(1, "words here")], "item_id long, text string")
    for df in (toxicity.score(docs, toxicity.Model({b"<vile>": 9.0}, [2.0])), toxicity.remove_toxic(docs, toxicity.Model()), decontam.scan(docs, bench), unigram.token_counts(docs, {"▁": -1.0}), media.header_columns(media.write_media(docs))):
        assert df.first()["a.b"] == 5


def test_a_target_is_met_among_rows_without_id(spark):
    rows = [(None, f"{'w ' * 50}{i}", "hot") for i in range(60)] + [(None, "same " * 50, "hot")] * 40 + [(i, "x " * 50, f"s{i % 3}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    found = mixing.op4(docs).collect()
    for key in {(r.source_size, r.target) for r in found}:
        own = [r for r in found if (r.source_size, r.target) == key]
        sources = round(sum(r.size for r in own) / key[0])  # sources alike in size and target
        assert abs(sum(r.taken for r in own) - sources * key[1]) <= 51 * sources
    assert whole(mixing.op4(docs)) == whole(mixing.op4(docs.repartition(3)))
    assert mixing.mixed(docs).count() * 50 == pytest.approx(sum(r.taken for r in found), rel=0.02)


def test_a_word_of_a_million_characters_needs_no_trie():
    scores = {"▁": -1.0, "a": -2.0, "ab": -2.2, "▁a": -1.5}
    trie = unigram.Trie(scores)
    rng = random.Random(3)
    for _ in range(200):
        word = "▁" + "".join(rng.choice("abé") for _ in range(rng.randrange(1, 400)))
        assert trie.long(word) == unigram.Trie(scores).insert(word)
    assert trie.long("▁" + "ab" * 500_000) == 500_001 - 1 + 1 and len(trie.next) == 1


def test_archives_are_rewritten_by_more_than_one_task(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 200) for i in range(160)], "page_id long, url string, html string").repartition(16)
    rows = warc.write_monolithic(pages)
    index = warc.normalise(warc.revisits(rows))
    assert rows.select("archive").distinct().count() > 8
    assert sum(1 for f in index.inputFiles() if spark.read.parquet(f).count()) > 4
    assert warc.read_records(index).groupBy(F.spark_partition_id()).count().count() >= 4


def test_other_tokenizers_encode_whole_texts():
    from public_tokenizers import path

    file = path("word_bpe_49k.json")
    encoder, library = tokens.Encoder(open(file).read()), Tokenizer.from_file(file)
    texts = ["Hello World's  12", "", None, "ünï\n"]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_benchmarks_of_many_sets_hit_alike(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i % 9, text(rng.randrange(1, 25))) for i in range(14)]
    docs = spark.createDataFrame([(i, text(40) + " " + items[i % 14][1]) for i in range(40)] + [(3, None), (3, None)], "doc_id long, text string").withColumn("a.b", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert whole(decontam.scan(docs, bench, max_words=60)) == whole(decontam.scan(docs, bench))


@pytest.mark.parametrize("n", [12, 24])
def test_many_segments_in_the_same_urls_are_mined(spark, n):
    steps = "/".join(f"seg{chr(97 + i)}" for i in range(n))
    rows = [(f"http://h{i}.org/{steps if i % 2 else 'x'}/{i}", i % 4 == 1 or i % 5 == 0) for i in range(120)]
    rules = urlrules.mine(spark.createDataFrame(rows, "url string, blocked boolean"), 0.05, 0.5, 1.1)
    assert sorted(r.antecedent for r in rules.collect()) == sorted([f"path:seg{chr(97 + i)}"] for i in range(n))


def test_a_mined_rule_decides(spark):
    pages = spark.createDataFrame([(i, f"http://{'casino' if i % 3 == 0 else 'h'}{i}.org/{'win' if i % 3 == 0 else 'news'}/{i}") for i in range(90)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    found = {r.page_id: r for r in urlrules.op9(pages, labels).collect()}
    assert all((r.verdict == "block") == (i % 3 == 0) and r.rule is None for i, r in found.items())


def test_toxicity_scores_match_plain_arithmetic(spark):
    model = toxicity.Model({b"<vile>": 1.25, b"<vil": 0.5, b"vile>": -0.25, b"<grob": 0.75, b"<ok>": -0.5}, [0.5, 1.0, 2.0])
    texts = ["Vile vile ok", "grobble", "", None, "vilest OK-ok é"]

    def plain(text):
        words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split()
        total = 0.0
        for w in set(words):
            marked = f"<{w}>"
            runs = [marked] + [marked[i : i + 5] for i in range(len(marked) - 4) if len(marked) > 5]
            total += np.log1p(words.count(w)) * sum(model.weights.get(r.encode(), 0.0) for r in runs)
        x = total / max(1, len(words)) ** 0.1
        return sum(1 / (1 + np.exp(-(x - c))) for c in model.cuts)

    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert [r.severity for r in sorted(got, key=lambda r: r.doc_id)] == pytest.approx([plain(t) for t in texts])


def test_chunks_of_a_hot_conversation_stay_small(spark, monkeypatch):
    monkeypatch.setattr(chat, "SPAN", 16)
    rows = spark.createDataFrame([(None, None, "user", "hi")] * 300 + [(1, 5, "user", f"x {i}") for i in range(100)], "conv_id long, turn long, role string, text string")
    places = chat.numbered(rows.select("conv_id", "turn", F.xxhash64("text").alias("tie")))
    assert places.groupBy("conv_id", F.floor(F.col("at") / 16)).count().agg(F.max("count")).first()[0] == 16
    assert chat.op7(rows).count() == 400


def test_words_hash_alike_whatever_parts_them(monkeypatch):
    text = "  Some words\tand\nmore   words " * 50 + "z" * 300
    whole_, plain = similar.shingles(text), similar.shingles(" ".join(text.split()).upper())
    assert (whole_ == plain).all() and len(whole_) == len({tuple(text.lower().split()[i : i + 5]) for i in range(len(text.split()) - 4)})
    monkeypatch.setattr(similar, "SEGMENT", 64)
    similar.POWERS.clear()
    cut = similar.shingles(text)
    assert len(cut) == len(whole_) and len(np.intersect1d(cut, whole_)) >= len(whole_) - 5
    similar.POWERS.clear()


def test_a_worker_holds_one_thing():
    made = []
    for kind, key in (("a", "1"), ("a", "1"), ("b", "1"), ("a", "1")):
        common.worker_held(kind, key, lambda: made.append(1) or len(made))
    common.worker_released()
    assert len(made) == 3


def test_pair_operators_ignore_odd_columns(spark):
    docs = odd(spark.createDataFrame([(1, "alpha beta beta", "s"), (2, None, None), (None, "alpha", "s"), (1, "alpha beta beta", "s")], "doc_id long, text string, source string"))
    bench = spark.createDataFrame([(1, "beta alpha", 3)], "item_id long, text string, `a.b` int")
    found = ranked.op13(docs, bench).collect()
    assert [(r.rank, r.doc_id) for r in sorted(found)] == [(1, 1), (2, 1), (3, None)]
    rows = align.op12(docs)
    assert rows.count() == 4 and rows.filter("n_a = 0 AND groups_sha256 = ''").count() == 1
    vectors = odd(spark.createDataFrame([(i, i, [1.0, float(i % 3)]) for i in range(0, 120, 10)], "doc_id long, vec_id long, embedding array<double>"))
    assert topk.op11(vectors).count() == 3 * 5


def test_pair_operators_over_nulls_alone(spark):
    none = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    assert ranked.op13(none, none.toDF("item_id", "text")).count() == 0
    assert [tuple(r)[1:] for r in align.op12(none).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert topk.op11(spark.createDataFrame([(None, None), (50, None), (0, [])], "vec_id long, embedding array<float>")).count() == 0
