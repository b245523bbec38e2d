"""Toxicity by cumulative-link ordinal regression.

Grades: 0 is not toxic; labelled toxic texts get grade 1, 2 or 3 by thirds of the share of
their words that occur in toxic texts alone. One weight for each sparse feature, shared by
all thresholds, predicts the grade: P(grade > k) = sigmoid(x.w - t_k) with t_0 < t_1 < t_2
(proportional odds; McCullagh, 1980). The result is the expected severity, the sum of these.

Features of a word are the word and the runs of five letters in it; a text's value of a
feature is the sum of log(1 + count) of its words with it, over a small power of the text's
length. As the model is linear, a word's score is the sum over its features and is worked out once. Fitting takes a sample of at most
``SAMPLE`` labelled texts, those with the smallest hash of their id, and at most ``FEATURES``
features; scoring reads every whole text once, without a shuffle.

Edge cases: a null or empty text has no features and is clean unless the thresholds say
otherwise for all; labels without a text or a null label are not fitted on; texts labelled twice count twice; without
toxic labels everything has severity 0; repeated rows each get a row; ``score`` keeps all
columns (one named like a column it adds is replaced); ``remove_toxic`` keeps the rows' own columns, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.names import col
from tablemill.llm.common import filtered, positional, worker_released

#: Labelled texts, and characters of them, that the model is fitted on at most; texts longer than LONGEST are scored but not fitted on.
SAMPLE, SAMPLE_CHARS, LONGEST = 4_000, 12_000_000, 20_000
FEATURES = 30_000
#: Texts that a feature must be in, and the least log of the ratio of its shares in toxic and in clean texts.
LEAST_TEXTS, LEAST_ODDS = 3, 1.5
GRADES = 3
RUN = 5
#: Texts' features are divided by their number of words to this power; a missed toxic text costs so many times a wrong alarm.
DAMP, MISS = 0.1, 3.0
STEPS, RATE, PENALTY = 200, 0.3, 3e-6
#: Word scores a task keeps at most.
CACHE = 300_000
#: Bytes that words are made of: digits, letters (lower-cased) and all beyond ASCII.
BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
ADDED = "severity double, grade int, toxic boolean"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(BYTES).split()


def features_of(word: bytes) -> list[bytes]:
    """The word itself and its inner runs, marked at the word's ends."""
    marked = b"<" + word + b">"
    return [marked, *(marked[i : i + RUN] for i in range(len(marked) - RUN + 1) if len(marked) > RUN)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Feature weights and the ordered thresholds; bounded by ``FEATURES``."""

    weights: dict[bytes, float] = field(default_factory=dict)
    cuts: list[float] = field(default_factory=list)
    words: dict[bytes, float] = field(default_factory=dict)

    def word(self, word: bytes) -> float:
        out = self.words.get(word)
        if out is None:
            if len(self.words) >= CACHE:
                self.words.clear()
            get = self.weights.get
            out = self.words[word] = sum([get(f, 0.0) for f in features_of(word)])
        return out

    def chances(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        words = words_of(text)
        x = sum([log1p(n) * self.word(w) for w, n in Counter(words).items()]) / max(1, len(words)) ** DAMP
        return _sigmoid(x - np.array(self.cuts))


def grades_of(texts: list[Counter], toxic: np.ndarray) -> np.ndarray:
    """Grades from binary labels: toxic texts in thirds by their share of words met in toxic texts alone."""
    in_toxic, in_clean = Counter(), Counter()
    for words, is_toxic in zip(texts, toxic, strict=True):
        (in_toxic if is_toxic else in_clean).update(words.keys())
    marks = {w for w, n in in_toxic.items() if n >= LEAST_TEXTS and w not in in_clean}
    share = np.array([sum(n for w, n in t.items() if w in marks) / max(1, sum(t.values())) for t in texts])
    out = toxic.astype(np.int64)
    for cut in np.quantile(share[toxic], [1 / 3, 2 / 3]) if toxic.any() else []:
        out += toxic & (share > cut)
    return out


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """Fits on a bounded list of (text, toxic 0 or 1), on the driver; the same rows give the same model."""
    texts, toxic = [Counter(words_of(t)) for t, _ in rows], np.array([bool(y) for _, y in rows], bool)
    if not toxic.any() or toxic.all():
        return Model()
    grades = grades_of(texts, toxic)
    found: dict[bytes, list[bytes]] = {}
    split = lambda w: found.setdefault(w, features_of(w)) if w not in found else found[w]
    seen, seen_toxic = Counter(), Counter()
    for words, is_toxic in zip(texts, toxic, strict=True):
        own = {f for w in words for f in split(w)}
        seen.update(own)
        if is_toxic:
            seen_toxic.update(own)
    n, m = len(texts), int(toxic.sum())
    odds = {f: np.log((seen_toxic[f] + 0.5) / (m + 1)) - np.log((c - seen_toxic[f] + 0.5) / (n - m + 1)) for f, c in seen.items() if c >= LEAST_TEXTS}
    names = sorted((f for f, x in odds.items() if x >= LEAST_ODDS), key=lambda f: (-odds[f] * seen[f] ** 0.5, f))[:FEATURES]
    number = {f: i for i, f in enumerate(names)}
    at, to, value = [], [], []
    for i, words in enumerate(texts):
        own: Counter = Counter()
        for w, c in words.items():
            for f in split(w):
                if (k := number.get(f)) is not None:
                    own[k] += log1p(c)
        at += [i] * len(own)
        to += own.keys()
        value += [c / sum(words.values()) ** DAMP for c in own.values()]
    at_, to_, value_ = np.array(at, np.int64), np.array(to, np.int64), np.array(value)
    levels = int(grades.max())
    above = grades[:, None] > np.arange(levels)[None, :]  # n x K
    # Thresholds are the first plus sums of exp(gap), so they stay in order; Adam on the mean of all binary losses.
    start = [float(-np.log(above[:, 0].mean() / (1 - above[:, 0].mean()))), *([0.0] * (levels - 1))]
    theta = np.concatenate(([odds[f] for f in names], start))  # starts from naive Bayes
    cost = np.where(toxic, MISS, 1.0)[:, None]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, t0, gaps = theta[: len(names)], theta[len(names)], np.exp(theta[len(names) + 1 :])
        cuts = t0 + np.concatenate(([0.0], np.cumsum(gaps)))
        x = np.bincount(at_, value_ * w[to_], minlength=n)
        wrong = (_sigmoid(x[:, None] - cuts[None, :]) - above) * cost / n
        grad = np.empty_like(theta)
        grad[: len(names)] = np.bincount(to_, value_ * wrong.sum(1)[at_], minlength=len(names)) + PENALTY * w
        by_cut = -wrong.sum(0)
        grad[len(names)] = by_cut.sum()
        grad[len(names) + 1 :] = np.cumsum(by_cut[::-1])[::-1][1:] * gaps
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(theta[len(names) + 1 :])
    cuts = theta[len(names)] + np.concatenate(([0.0], np.cumsum(gaps)))
    return Model(dict(zip(names, theta[: len(names)].tolist(), strict=True)), cuts.tolist())


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled documents, and at most ``SAMPLE_CHARS`` characters of whole texts."""
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "toxic", order.alias("h")).orderBy("h", "toxic").limit(sample)
    rows = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (F.length("text") <= LONGEST)).join(F.broadcast(chosen), "doc_id")  # ``sample`` rows at most
    first = rows.select("h", "toxic", "text").orderBy("h", "toxic", "text").limit(sample)  # some thousand rows, so one window holds them
    used = F.sum(F.length("text")).over(Window.orderBy("h", "toxic", "text").rowsBetween(Window.unboundedPreceding, 0))
    return fit([(r.text, r.toxic) for r in first.withColumn("used", used).filter(F.col("used") <= SAMPLE_CHARS).orderBy("h", "toxic", "text").collect()])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with severity (0 to 3), grade (its nearest whole number, 1 at least if toxic) and toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.cuts))  # FEATURES entries at most
    added = T._parse_datatype_string(ADDED)
    kept = [c for c in docs.columns if c.lower() not in {f.name for f in added}]
    at, schema = kept.index("text"), T.StructType([*docs.select(*map(col, kept)).schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_released()
        own = Model(*shared.value)
        for batch in batches:
            severity, grade, toxic = [], [], []
            for text in batch.column(at).to_pylist():
                chances = own.chances(text) if own.cuts else np.zeros(1)
                severity.append(float(chances.sum()))
                toxic.append(bool(chances[0] >= 0.5))
                grade.append(max(1, round(severity[-1])) if toxic[-1] else 0)
            extra = [pa.array(severity, pa.float64()), pa.array(grade, pa.int32()), pa.array(toxic, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[f.name for f in schema])

    return positional(docs, kept).mapInArrow(run, schema)


def remove_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model takes for clean, with their own columns."""
    return filtered(docs, lambda df: score(df, model), [f.name for f in T._parse_datatype_string(ADDED)], ~F.col("toxic"))


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity, grade, toxic."""
    return score(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
