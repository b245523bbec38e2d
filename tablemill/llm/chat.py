"""Chat formatting: roles of transcript lines by a hidden Markov model, and canonical turns.

A transcript is a conversation's lines in order, some of which start with a speaker marker
(``User:``, ``A:``, ``<assistant>`` …). States are the roles; each line is seen through
discrete features (its marker, whether it starts a block of text, how it ends, how long it is).
Start, transition (from block to block and from line to line within one) and feature probabilities are
counted on labelled conversations, over all of them and with one added to each count. Viterbi's most
likely roles are then rendered as turns.

The chain is cut for Spark: the rows of each conversation are numbered by range; a block (a row's lines)
is a matrix of best scores from the role before it to its last role; ``SPAN`` blocks make a chunk,
whose matrix is their product in the (max, +) sense, and so on up, until a conversation is one chunk. On
the way down each chunk gets the role it starts from and ends in, and at last each block its lines'
roles. So a task holds ``SPAN`` blocks at once at most, however long a conversation is and whatever its turn numbers.

Edge cases: null texts are one empty line; null conv_ids form one conversation; null turns come before turn 0;
rows with the same turn number are ordered by their text's hash; with no labels all roles are alike and
the first wins; repeated rows each keep their row; an empty table gives an empty result;
columns other than conv_id, turn, role and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.common import written

ROLES = ("user", "assistant", "system")
SPAN = 256
#: States are the roles and the one before a conversation; what can't be has this logarithm.
SIZE, BEGIN, NEVER = len(ROLES) + 1, len(ROLES), -1e9
#: Speaker markers at a line's start, in the spellings that transcripts use.
MARKERS = {
    "user": ("user", "human", "q", "customer", "me", "prompter"),
    "assistant": ("assistant", "ai", "a", "bot", "agent", "gpt", "model"),
    "system": ("system", "instructions", "context"),
}
KIND = {name: role for role, names in MARKERS.items() for name in names}
#: A marker is a name in brackets, or a name and a colon, with hashes or stars around it at will.
MARKER = re.compile(r"^\s*(?:[<\[|#*]+\s*([a-z]+)\s*[|>\]:*]+|([a-z]+)\s*:)\s*", re.I)
FEATURES = {"marker": ("user", "assistant", "system", "other", "none"), "first": ("yes", "no"), "end": ("question", "stop", "open"), "size": ("0", "1", "2", "3", "4")}


def marker_of(line: str) -> tuple[str, str]:
    """(kind of marker, the line without it); lines whose name is no known speaker keep it."""
    m = MARKER.match(line)
    if not m:
        return "none", line
    kind = KIND.get((m[1] or m[2]).lower())
    return (kind, line[m.end() :]) if kind else ("other", line)


def features_of(line: str, first: bool) -> tuple[str, str, str, str]:
    marker, rest = marker_of(line)
    rest = rest.rstrip()
    end = "question" if rest.endswith("?") else "stop" if rest.endswith((".", "!")) else "open"
    size = len(rest)
    return marker, "yes" if first else "no", end, str(sum(size >= x for x in (1, 40, 120, 400)))


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


@dataclass
class Model:
    """Log-probabilities; a few dozen numbers."""

    #: Chances of a state before the first line (it is ``BEGIN``), and of moves: step[0] to a block's first line, step[1] within it.
    start: np.ndarray
    step: np.ndarray
    seen: dict[tuple[str, str], np.ndarray]

    def emissions(self, text: str | None) -> np.ndarray:
        """lines x states"""
        rows = [features_of(line, i == 0) for i, line in enumerate(lines_of(text))]
        return np.array([[*sum(self.seen[k, v] for k, v in zip(FEATURES, row, strict=True)), NEVER] for row in rows])


def _line_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [(role, *features_of(line, i == 0), i == 0) for role, text in zip(pdf.role, pdf.text, strict=True) for i, line in enumerate(lines_of(text))]
        yield pd.DataFrame(out, columns=["role", *FEATURES, "head"])


def fit(blocks: DataFrame) -> Model:
    """Counts on labelled blocks (conv_id, turn, role, text); blocks with other roles are left out.

    Only sums by role and feature value come to the driver.
    """
    known = blocks.filter(F.col("role").isin(*ROLES)).select("conv_id", "turn", "role", "text")
    places = written(numbered(known.select("conv_id", F.col("turn").cast("long").alias("turn"), F.xxhash64("text").alias("tie"), "role")), "chat-places").select("conv_id", "at", "role")
    counted = known.select("role", "text").mapInPandas(_line_rows, "role string, marker string, first string, end string, size string, head boolean")
    lines = counted.groupBy("role", *FEATURES).agg(F.count("*").alias("n")).collect()
    seen = {(k, v): np.ones(len(ROLES)) for k, values in FEATURES.items() for v in values}
    total, heads = np.ones(len(ROLES)), np.zeros(len(ROLES))
    for r in lines:
        i = ROLES.index(r.role)
        total[i] += r.n
        heads[i] += r.n * (r["first"] == "yes")
        for k in FEATURES:
            seen[k, r[k]][i] += r.n
    seen = {(k, v): np.log(x / (total + len(FEATURES[k]) - 1)) for (k, v), x in seen.items()}
    # From one block's role to the next one's: each place meets the one after it, so no conversation is gathered.
    after = places.select(F.col("conv_id").alias("c"), (F.col("at") - 1).alias("a"), F.col("role").alias("then"))
    moves = places.join(after, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("a"))).groupBy("role", "then").agg(F.count("*").alias("n")).collect()
    k = len(ROLES)
    between, within, first = np.ones((k, k)), np.ones((k, k)), np.ones(k)
    for r in moves:
        between[ROLES.index(r.role), ROLES.index(r.then)] += r.n
    within[np.diag_indices(k)] += np.maximum(total - 1 - heads, 0)  # lines within a block keep its role
    for r in places.filter("at = 0").groupBy("role").agg(F.count("*").alias("n")).collect():
        first[ROLES.index(r.role)] += r.n
    step = np.full((2, SIZE, SIZE), NEVER)
    step[0, :k, :k], step[1, :k, :k] = (np.log(x / x.sum(1, keepdims=True)) for x in (between, within))
    step[0, BEGIN, :k] = np.log(first / first.sum())
    return Model(np.array([*[NEVER] * k, 0.0]), step, seen)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, tie, …) with ``at``, their place in their conversation from 0 on.

    Places are counted by range, so that a conversation's rows are never in one task; rows equal
    in all of these are told apart by where they lie.
    """
    order = [F.col("conv_id"), F.coalesce("turn", F.lit(-1)), F.col("turn"), F.col("tie"), F.col("__place")]  # nulls come first
    dealt = rows.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(*order)
    ranges = written(dealt.withColumn("__range", F.spark_partition_id()), "chat-ranges")
    before = Window.partitionBy("conv_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = ranges.groupBy("conv_id", "__range").agg(F.count("*").alias("n")).select(F.col("conv_id").alias("__c"), F.col("__range").alias("__r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy("conv_id", "__range").orderBy(*order[1:]))
    out = ranges.withColumn("at", own).join(base, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("__range") == F.col("__r")))
    return out.withColumn("at", F.col("at") + F.col("__base") - 1).drop("__place", "__range", "__c", "__r", "__base")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def path(parts: list[np.ndarray], before: int, last: int) -> list[int]:
    """The best states after each of ``parts`` from ``before`` to ``last``; the smallest of equals."""
    scores, backs = parts[0][before], []
    for m in parts[1:]:
        whole = scores[:, None] + m
        backs.append(whole.argmax(0))
        scores = whole.max(0)
    out = [last]
    for back in reversed(backs):
        out.append(int(back[out[-1]]))
    return out[::-1]


def _line_matrices(model: Model, text: str | None) -> list[np.ndarray]:
    return [model.step[min(i, 1)] + e[None, :] for i, e in enumerate(model.emissions(text))]


def _matrix(values: list[float]) -> np.ndarray:
    return np.array(values).reshape(SIZE, SIZE)


def _blocks(model: Model):
    """Adds each block's matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ms = [reduce(product, _line_matrices(model, t)).ravel().tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ms, pa.list_(pa.float64()))], names=[*batch.schema.names, "m"])

    return run


def _by_chunk(of, names: list[str]):
    """Runs ``of`` on the rows of each chunk (conv_id, up) in turn; rows come sorted, a chunk may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, key = None, [], None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), schema, strict=True)], names=names)

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            schema, out = [KINDS.get(n, batch.schema.field("conv_id").type) for n in names], []
            for row in zip(*cols, strict=True):
                if held and row[:2] != key:
                    out += of(held)
                    held = []
                key = row[:2]
                held.append(row)
            if out:
                yield batch_of(out)
        if held:
            yield batch_of(of(held))

    return run


KINDS = {"at": pa.int64(), "turn": pa.int64(), "m": pa.list_(pa.float64()), "text": pa.string(), "before": pa.int32(), "last": pa.int32()}


def _joined(rows: list[tuple]) -> list[tuple]:
    """A chunk's rows (conv_id, up, at, m) as one: the product of their matrices."""
    m = reduce(product, (_matrix(r[3]) for r in rows))
    return [(rows[0][0], rows[0][1], m.ravel().tolist())]


def _resolved(rows: list[tuple]) -> list[tuple]:
    """A chunk's rows (conv_id, up, at, m, turn, text, before, last), with their own role before and after instead of the chunk's."""
    after = path([_matrix(r[3]) for r in rows], rows[0][6], rows[0][7])
    return [(r[0], r[2], r[4], r[5], b, e) for r, b, e in zip(rows, [rows[0][6], *after[:-1]], after, strict=True)]


def parse(blocks: DataFrame, model: Model) -> DataFrame:
    """(conv_id, turn, text, roles): the role of each line of each block of ``blocks`` (conv_id, turn, text)."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    rows = numbered(blocks.select("conv_id", F.col("turn").cast("long").alias("turn"), F.xxhash64("text").alias("tie"), "text"))
    rows = rows.select("conv_id", "at", "turn", "text").mapInArrow(_blocks(model), f"conv_id {kind}, at long, turn long, text string, m array<double>")
    levels, up = [written(rows, "chat-blocks")], F.floor(F.col("at") / SPAN)
    far = levels[0].agg(F.max("at")).first()[0] or 0
    while True:  # the top level has one chunk a conversation
        top = far < SPAN
        cut = levels[-1].select("conv_id", up.alias("up"), "at", "m").repartition("conv_id", "up").sortWithinPartitions("conv_id", "up", "at")
        done = cut.mapInArrow(_by_chunk(_joined, ["conv_id", "at", "m"]), f"conv_id {kind}, at long, m array<double>")
        levels.append(written(done, "chat-chunks"))
        if top:
            break
        far = far // SPAN
    start = model.start

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state before the first line and the best last role."""
        for batch in batches:
            out = []
            for m in batch.column("m").to_pylist():
                every = start[:, None] + _matrix(m)
                out.append(np.unravel_index(every.argmax(), every.shape))
            spots = [pa.array([int(x[i]) for x in out], pa.int32()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("at"), *spots], names=["conv_id", "at", "before", "last"])

    known = levels[-1].select("conv_id", "at", "m").mapInArrow(ends, f"conv_id {kind}, at long, before int, last int")
    for n in range(len(levels) - 2, -1, -1):
        known = written(known.select(F.col("conv_id").alias("c"), F.col("at").alias("up_"), "before", "last"), "chat-known")
        more = [F.col(c) if n == 0 else F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("text", "string"))]
        own = levels[n].select("conv_id", up.alias("up"), "at", "m", *more)
        both = own.join(known, own.conv_id.eqNullSafe(F.col("c")) & (own.up == F.col("up_"))).drop("c", "up_")
        dealt = both.repartition("conv_id", "up").sortWithinPartitions("conv_id", "up", "at")
        known = dealt.mapInArrow(_by_chunk(_resolved, ["conv_id", "at", "turn", "text", "before", "last"]), f"conv_id {kind}, at long, turn long, text string, before int, last int")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = zip(*(batch.column(c).to_pylist() for c in ("text", "before", "last")), strict=True)
            roles = [[ROLES[i] for i in path(_line_matrices(model, t), b, e)] for t, b, e in each]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "text")), pa.array(roles, pa.list_(pa.string()))], names=["conv_id", "turn", "text", "roles"])

    found = known.mapInArrow(lines, f"conv_id {kind}, turn long, text string, roles array<string>")
    return found.withColumn("turn", F.col("turn").cast(blocks.schema["turn"].dataType))


def rendered(parsed: DataFrame) -> DataFrame:
    """``parsed`` with role (of the block's first line), n_lines and canonical: its lines without markers as turns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, roles in zip(pdf.text, pdf.roles, strict=True):
                turns: list[tuple[str, list[str]]] = []
                for line, role in zip(lines_of(text), roles, strict=True):
                    if not turns or turns[-1][0] != role:
                        turns.append((role, []))
                    turns[-1][1].append(marker_of(line)[1])
                out.append("".join(f"<|{role}|>\n" + "\n".join(own) + "\n<|end|>\n" for role, own in turns))
            yield pd.DataFrame({"conv_id": pdf.conv_id, "turn": pdf.turn, "role": [r[0] for r in pdf.roles], "n_lines": [len(r) for r in pdf.roles], "canonical": out})

    kinds = {c: parsed.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    return parsed.mapInPandas(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, n_lines long, canonical string")


def as_transcript(conversations: DataFrame) -> DataFrame:
    """Labelled turns as raw transcript blocks: most first lines get a marker, in a style that a conversation keeps; one in eight has none."""
    names = F.create_map(*(x for role, own in MARKERS.items() for x in (F.lit(role), F.array(*map(F.lit, own[:3])))))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(3)).cast("int") + 1
    name = F.element_at(F.element_at(names, F.col("role")), style)
    mark = F.when(style == 1, F.concat(F.initcap(name), F.lit(": "))).when(style == 2, F.concat(F.lit("### "), name, F.lit(": "))).otherwise(F.concat(F.lit("<"), name, F.lit("> ")))
    bare = F.pmod(F.xxhash64("conv_id", "turn", F.lit("marker")), F.lit(8)) == 0
    return conversations.withColumn("text", F.when(bare, F.col("text")).otherwise(F.concat(F.coalesce(mark, F.lit("")), F.coalesce("text", F.lit("")))))


def op7(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role (recovered), n_lines, canonical: transcripts made of all conversations, parsed without their roles.

    The model is fitted on the half of the conversations whose id's hash is even; the other half's roles are unseen.
    """
    blocks = as_transcript(conversations.select("conv_id", "turn", "role", "text"))
    return rendered(parse(blocks.select("conv_id", "turn", "text"), fit(blocks.filter(fitted_on()))))


def fitted_on() -> Column:
    """Whether a conversation is of the half that ``op7`` fits on."""
    return F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0
