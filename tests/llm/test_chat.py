import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemill.llm import chat


def conversations(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        roles = ["system"] * (rng.random() < 0.3) + ["user", "assistant"] * rng.randrange(1, 9)
        for t, role in enumerate(roles):
            words = rng.randrange(2, 12 if role == "user" else 60)
            text = "\n".join(" ".join("word" for _ in range(words)) + rng.choice([".", "?" if role == "user" else ".", ""]) for _ in range(rng.randrange(1, 4)))
            rows.append((c, t, role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def blocks(spark):
    return chat.as_transcript(spark.createDataFrame(conversations(60, 1), SCHEMA))


@pytest.fixture(scope="module")
def model(blocks):
    return chat.fit(blocks)


def plain(model, texts):
    """Viterbi over all lines of one conversation at once; the roles of each block's lines."""
    sizes = [len(chat.lines_of(t)) for t in texts]
    e = np.concatenate([model.emissions(t) for t in texts])
    steps = [model.step[0 if i == 0 else 1] for n in sizes for i in range(n)]  # to a block's first line, and within it
    scores, back = model.start, []
    for row, step in zip(e, steps, strict=True):
        whole = scores[:, None] + step + row[None, :]
        back.append(whole.argmax(0))
        scores = whole.max(0)
    states = [int(scores.argmax())]
    for b in reversed(back[1:]):
        states.append(int(b[states[-1]]))
    states, out = [chat.ROLES[i] for i in states[::-1]], []
    for n in sizes:
        out.append(states[:n])
        states = states[n:]
    return out


@pytest.mark.parametrize("span", [3, 256])
def test_cut_chains_match_plain_viterbi(spark, blocks, model, monkeypatch, span):
    monkeypatch.setattr(chat, "SPAN", span)
    extra = [(None, 0, "User: hi\nthere"), (None, 1, None), (70, None, "A: no turn"), (70, -3, "x"), (70, 0, "y?"), (70, 0, "y?")]
    rows = blocks.select("conv_id", "turn", "text").union(spark.createDataFrame(extra, "conv_id long, turn long, text string"))
    found = {}
    for r in chat.parse(rows.repartition(5), model).collect():
        found.setdefault(r.conv_id, []).append((r.turn, r.text, r.roles))
    given = {}
    for r in rows.collect():
        given.setdefault(r.conv_id, []).append((r.turn, r.text))
    assert set(found) == set(given)
    for conv, own in given.items():
        own.sort(key=lambda x: (-1 if x[0] is None else x[0], x[0] is not None, x[1] or ""))
        expected = [(t, x, roles) for (t, x), roles in zip(own, plain(model, [x for _, x in own]), strict=True)]
        assert sorted(found[conv], key=str) == sorted(expected, key=str)


def test_held_out_accuracy(spark, model):
    held = spark.createDataFrame(conversations(80, 9), SCHEMA)
    blocks = chat.as_transcript(held)
    got = chat.rendered(chat.parse(blocks.select("conv_id", "turn", "text"), model))
    truth = {(c, t): (r, x) for c, t, r, x in conversations(80, 9)}
    rows = got.collect()
    assert len(rows) == len(truth)
    assert np.mean([truth[r.conv_id, r.turn][0] == r.role for r in rows]) > 0.97
    alike = [r for r in rows if truth[r.conv_id, r.turn][0] == r.role and r.canonical.count("<|end|>") == 1]
    same = [r.canonical == f"<|{r.role}|>\n{truth[r.conv_id, r.turn][1]}\n<|end|>\n" for r in alike]
    assert np.mean(same) > 0.99


def test_markers():
    assert chat.marker_of("User: hi") == ("user", "hi")
    assert chat.marker_of("### AI: hi") == ("assistant", "hi")
    assert chat.marker_of("<system> be good") == ("system", "be good")
    assert chat.marker_of("Note: hi") == ("other", "Note: hi")
    assert chat.marker_of("plain text") == ("none", "plain text")


def test_empty_and_null_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.op7(empty).count() == 0
    rows = spark.createDataFrame([(None, None, None, None), (1, 0, "user", "hi"), (1, 0, "user", "hi")], SCHEMA).withColumn("at", F.lit("clash"))
    assert chat.op7(rows).count() == 3
