import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablemill.llm import align

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_chars():
    own = {}
    extra = 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            own[chr(b)] = b
        else:
            own[chr(extra)] = b
            extra += 1
    return own


def plain(docs):
    """The definition by loops, with the libraries' own encoders."""
    first, second, of = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND), byte_chars()
    first.encode_special_tokens = True
    rows, counts = [], Counter()
    for doc, text in docs:
        whole = (" " + (text or "")).encode()
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        ab = [bytes(of[c] for c in first.id_to_token(i)) for i in a]
        bb = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(ab) != whole or b"".join(bb) != whole:
            rows.append((doc, [], [], [], ""))
            continue
        links, groups, i, j, x, y, one, two = [], [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if x <= y and i < len(a) or j >= len(b):
                one.append(a[i])
                start, x, i = x, x + len(ab[i]), i + 1
            else:
                two.append(b[j])
                start, y, j = y, y + len(bb[j]), j + 1
            if x == y and one and two:
                groups.append((one, two))
                one, two = [], []
        spans = []
        for ids, parts in ((a, ab), (b, bb)):
            at, own = 0, []
            for t, p in zip(ids, parts, strict=True):
                own.append((at, at + len(p), t))
                at += len(p)
            spans.append(own)
        for s, e, t in spans[0]:
            links += [(t, u) for s2, e2, u in spans[1] if s < e2 and s2 < e]
        text_of = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        rows.append((doc, a, b, links, hashlib.sha256(text_of.encode()).hexdigest(), len(groups)))
        counts.update(set(links))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for doc, a, b, links, digest, *groups in rows:
        out.append((doc, len(a), len(b), groups[0] if groups else 0, len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=str)


def documents():
    rng = random.Random(11)
    words = ["hello", "world", "tokenization", "Über", "straße", "日本語", "émigré", "don't", "x_y", "1234", "\n", "\t", "  ", "🙂", "ﬁ", "<s>", "<|endoftext|>", "<0x41>", "antidisestablishmentarianism"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " "), (103, "   "), (104, "\n"), (105, "a"), (106, " lead"), (107, "trail "), (108, "two  spaces   three"), (109, "▁lower"), (110, "é Å  x"), (111, "\x00nul")]
    docs += [(None, docs[3][1]), (3, docs[3][1]), (200, "word " * 3000), (201, "x" * 5000)]
    return docs


@pytest.mark.parametrize("most", [align.PAIRS, 20, 0])
def test_matches_brute_force(spark, most):
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"number": F.lit("clash"), "a": F.lit(1), "n_a": F.lit(2)}).repartition(3)
    found = align.align(df, FIRST, SECOND, most)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted((tuple(r) for r in found.collect()), key=str)
    want = plain(docs)
    assert [g for g, w in zip(got, want, strict=True) if g != w] == []


def test_empty_table(spark):
    assert align.op12(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_union_find_matches_plain():
    rng = np.random.default_rng(2)
    for n, m in ((1, 0), (50, 20), (200, 180), (500, 900)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        label = list(range(n))
        for a, b in zip(u.tolist() * n, v.tolist() * n, strict=True):
            low = min(label[a], label[b])
            if label[a] == label[b]:
                continue
            label = [low if x in (label[a], label[b]) else x for x in label]
        assert align.union_find(n, u, v).tolist() == label


def test_spans_cut_the_text(spark):
    text = "tokenization of Über 日本語 words"
    row = align.aligned(spark.createDataFrame([(0, "x"), (1, text), (2, None), (3, text)], "doc_id long, text string"), FIRST, SECOND, spans=True).filter("doc_id = 3").first()
    assert row.group_ends[-1] == len((" " + text).encode()) and len(row.group_ends) == row.n_groups
    assert len(row.a_ids) == row.n_a and row.group_ends == sorted(set(row.group_ends))
    assert (" " + text).encode()[: row.group_ends[-1]].decode().endswith("words")
