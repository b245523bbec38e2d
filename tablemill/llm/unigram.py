"""Token counts under a unigram vocabulary, by dynamic programming shared along a trie.

A text's pre-tokens are its words (between ASCII white space), each after a word mark. Distinct pre-tokens go into a trie;
a node holds the best score of its prefix, that is the largest sum of piece scores over all
ways to cut it, and the number of pieces of that way. A prefix's score depends on the prefix
alone, so it is computed once, however many pre-tokens share it, and a pre-token's terminal node
gives its count. Texts are read once and nothing is shuffled; each worker keeps a trie of at
most ``NODES`` nodes, which starts anew when it is full, and the counts of at most ``WORDS`` words. Words of
more than ``LONG`` characters are worked out alike, but on their own and with no more prefixes than a piece is long.

The vocabulary is a public file's pieces, taken as ordered by frequency: the score of rank r
is the logarithm of its chance under Zipf's law, 1 / (r + 2) over the sum of these. A character
that no piece covers costs ``UNKNOWN`` and counts as its UTF-8 bytes. Of ways with the same
score the one with fewer tokens counts.

Edge cases: null, empty and blank texts have no tokens; repeated rows each get a row; an empty
table gives an empty result; ``token_counts`` keeps all columns (one named like a column it
adds is replaced).
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablemill.functions.names import col
from tablemill.llm.common import WORD, positional, worker_held

MARK = "▁"
UNKNOWN = -30.0
NODES, WORDS = 300_000, 500_000
#: Characters of the longest word that goes into the trie.
LONG = 200
WORDS_OF = re.compile(WORD)
ADDED = "n_words long, n_tokens long"


def vocabulary(path: str) -> dict[str, float]:
    """Piece to score, from a sentencepiece model file; control, unknown and byte pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    kept = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    pieces = list(dict.fromkeys(map(model.id_to_piece, kept)))
    total = sum(1 / (r + 2) for r in range(len(pieces)))
    return {piece: -log((r + 2) * total) for r, piece in enumerate(pieces)}


class Trie:
    """Pre-tokens with forward scores: node 0 is the empty prefix."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.known: dict[str, int] = {}
        self.clear()

    def long(self, word: str) -> int:
        """The token count of a word of any length by the same recurrence, with the last prefixes alone."""
        best, count, width = [0.0], [0], self.longest
        for i, char in enumerate(word, 1):
            score, n = best[-1] + UNKNOWN, count[-1] + len(char.encode("utf-8", "surrogatepass"))
            for k in range(min(width, i), 0, -1):
                own = self.scores.get(word[i - k : i])
                if own is not None and ((total := best[-k] + own) > score or (total == score and count[-k] + 1 < n)):
                    score, n = total, count[-k] + 1
            best.append(score)
            count.append(n)
            if len(best) > 4 * width + 64:
                del best[:-width], count[:-width]
        return count[-1]

    def clear(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.best: list[float] = [0.0]
        self.count: list[int] = [0]

    def insert(self, word: str) -> int:
        """The token count of ``word``; only prefixes that no word before had are computed."""
        path, node = [0], 0
        for i, char in enumerate(word, 1):
            child = self.next[node].get(char)
            if child is None:
                child = self.next[node][char] = len(self.next)
                # The last character alone, if it is no piece, goes by its bytes.
                score, count = self.best[node] + UNKNOWN, self.count[node] + len(char.encode("utf-8", "surrogatepass"))
                for j in range(max(0, i - self.longest), i):
                    own = self.scores.get(word[j:i])
                    if own is not None:
                        total, n = self.best[path[j]] + own, self.count[path[j]] + 1
                        if total > score or (total == score and n < count):
                            score, count = total, n
                self.next.append({})
                self.best.append(score)
                self.count.append(count)
            node = child
            path.append(node)
        return self.count[node]


def token_counts(docs: DataFrame, scores: dict[str, float], nodes: int = NODES) -> DataFrame:
    """``docs`` with n_words and n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(scores)  # a vocabulary: some ten thousand pieces
    key = uuid.uuid4().hex
    added = T._parse_datatype_string(ADDED)
    kept = [c for c in docs.columns if c.lower() not in {f.name for f in added}]
    at, schema = kept.index("text"), T.StructType([*docs.select(*map(col, kept)).schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = worker_held("unigram", key, lambda: Trie(shared.value))  # Spark runs many tasks in one worker
        known = trie.known
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(at).to_pylist():
                own, total = Counter(WORDS_OF.findall(text or "")), 0
                for word, n in own.items():
                    count = known.get(word)
                    if count is None and len(word) > LONG:
                        count = trie.long(MARK + word)
                    elif count is None:
                        if len(trie.next) > nodes:
                            trie.clear()
                        count = trie.insert(MARK + word)
                        if len(known) < WORDS:
                            known[word] = count
                    total += n * count
                words.append(sum(own.values()))
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[f.name for f in schema])

    return positional(docs, kept).mapInArrow(run, schema)


def op6(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens."""
    if model is None:
        from public_tokenizers import path

        model = path("piece_bpe_32k.model")
    return token_counts(docs.select("doc_id", "text"), vocabulary(model)).drop("text")
