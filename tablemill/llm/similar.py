"""Near-duplicates by the Jaccard similarity of five-word shingle sets: SimHash and multi-index hashing first, the rest exactly by prefix filtering.

Each set gets a SimHash over its shingles, and sets at three or fewer differing bits are found by multi-index hashing
(``simhash.links``), verified on whole sets. That reaches close copies and can't promise pairs at 0.8, so prefix filtering
looks for links between the groups it leaves.

If two sets have a similarity of 0.8 or more, they share an element among the first
n - ceil(0.8 n) + 1 of each, in any order of elements that all sets use. So each set is posted
under that prefix only, and no pair is missed, which a bound on SimHash bits can't promise: a
similarity of 0.8 turns about 15 % of the bits, with a wide spread. Elements met often in a sample
come last in the order, so that common lines are seldom in a prefix; the sample decides what the
work costs and never what is found.

Each text is read once for this: a row keeps its set's hash, size and prefix, and a parity bitmap of
about one bit an element. Two bitmaps differ in at most as many bits as the sets in elements, which rules
most pairs out that share a passage without being alike. Each list of sets under an element first links its
members to one of them. Then members that are still in different groups are tried in rounds: a list gives pairs, by their
distance in it, until it has given as many as it has members, twice as many in the next round, and so on from where it stopped;
what has come together meanwhile isn't tried any more. So each list ends after a logarithm of rounds, and all that is
tried beyond twice its members are pairs that nothing but their whole sets can tell apart. Every link is
verified on whole shingle sets. Lists are counted once they are posted, and longer ones cut into blocks
whose pairs all meet.

Edge cases: null texts count as empty, and empty texts are alike; a text of fewer than five words is
one shingle; equal sets are always duplicates; a null doc_id is the largest; repeated rows are duplicates;
an empty table gives an empty result; other columns may have any names and types and are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.common import discard, shuffles_removed, spread, whole_rows, written
from tablemill.llm.simhash import SEED, components, majority
from tablemill.llm.simhash import links as near_fingerprints

SHINGLE = 5
#: Two sets are alike if 9 * common >= 4 * (n + m), which is a similarity of 0.8: they differ in (n + m) / 9 elements at most.
COMMON, BOTH = 9, 4
#: Sets with fewer elements are like equal sets alone.
LEAST = 4
#: The order of elements comes from a sample of one text in EVERY, of SAMPLE texts at least; so many elements of it are kept.
EVERY, SAMPLE, KEPT = 1000, 10_000, 500_000
#: Sets of one block of a list; a cell has two blocks.
BLOCK = 4096
#: Sets that a task remembers so as not to post an equal one again.
SEEN = 200_000
#: Bytes of a text that are hashed at once; a longer word is hashed on its own.
SEGMENT = 1 << 20
BASE = 0x9E3779B97F4A7C15
#: Bits of a bitmap, as powers of two, and how many times finer the second one of a set is.
FEWEST_BITS, MOST_BITS, FINER = 6, 16, 3
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n - 1 and their inverses, modulo 2 ** 64."""
    if not POWERS or len(POWERS[0]) < n:
        size = min(SEGMENT, max(1 << 14, 1 << n.bit_length()))
        POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x, np.uint64))), dtype=np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64))]
    return POWERS[0][:n], POWERS[1][:n]


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word, from polynomials over the bytes."""
    from xxhash import xxh64_intdigest

    data = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(BLANK[data].astype(np.int8), prepend=1, append=1))
    starts, ends = edges[::2], edges[1::2]
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        low = int(starts[at])
        upto = int(np.searchsorted(ends, low + SEGMENT, "right"))
        if upto == at:  # a very long word
            out[at] = xxh64_intdigest(text[low : int(ends[at])], SEED)
            at += 1
            continue
        own = data[low : int(ends[upto - 1])].astype(np.uint64) + np.uint64(1)
        powers, inverses = _powers(len(own))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * powers, dtype=np.uint64)))
        a, b = starts[at:upto] - low, ends[at:upto] - low
        out[at:upto] = spread((sums[b] - sums[a]) * inverses[a], 0)
        at = upto
    return out


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(BASE) + words[k : k + n]
    return np.unique(spread(out, 1))


def bitmap(own: np.ndarray, finer: int = 0) -> bytes:
    """For each bit whether an odd number of elements falls on it."""
    bits = 1 << (min(MOST_BITS, max(FEWEST_BITS, (len(own) - 1).bit_length())) + finer)
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def frequent(docs: DataFrame, every: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements met three times or more in one of ``every`` distinct texts, sorted, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py()).view(np.int64))], names=["token"])

    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").distinct().mapInArrow(run, "token long")
    counts = some.groupBy("token").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "token").limit(KEPT)
    with shuffles_removed(docs.sparkSession):
        counts = counts.toPandas()
    tokens = counts["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], counts["n"].to_numpy(np.int64)[order]


def prefix(own: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first elements of a set, rare ones first."""
    n = len(own)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
        often = np.where(tokens[at] == own, counts[at], 0)
    else:
        often = np.zeros(n, np.int64)
    return own[np.argsort(often, kind="stable")[: n - -(-4 * n // 5) + 1]]


def sketches(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text_hash, fp, size, sim, bits, fine, keys) of every row; the last four only where a task meets a set first."""
    from xxhash import xxh64_intdigest

    n = docs.count()
    every = max(1, n // max(sample, n // EVERY))
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, every))  # KEPT elements at most
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = shared.value
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for text in batch.column(2):
                own = shingles(text.as_py())
                fp = xxh64_intdigest(own.tobytes(), SEED)
                if len(own) < LEAST or fp in seen:
                    rows.append((fp, len(own), None, None, None, None))
                    continue
                if len(seen) < SEEN:
                    seen.add(fp)
                rows.append((fp, len(own), np.uint64(majority(own)).astype(np.int64), bitmap(own), bitmap(own, FINER), prefix(own, tokens, counts).view(np.int64)))
            fps, sizes, sims, bits, fine, keys = list(zip(*rows, strict=True)) or [[]] * 6
            made = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(sims, pa.int64()), pa.array(bits, pa.binary()), pa.array(fine, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["doc_id", "text_hash", "fp", "size", "sim", "bits", "fine", "keys"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, fp long, size int, sim long, bits binary, fine binary, keys array<long>")
    return written(rows, "set-sketches")


def shared_lists(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, fp, shape, hub, hub_shape) of the lists that two of the distinct ``sets`` or more are in; shape holds the set's size and the element's place.

    A list of more than ``block`` sets is cut into blocks by its exact length, and each two of them share a list of their own.
    """
    posts = sets.select("fp", "size", F.posexplode("keys").alias("place", "key")).select("key", "fp", F.expr("shiftleft(CAST(size AS BIGINT), 32) + place").alias("shape"))
    long = posts.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    long = written(long.select("key", F.ceil(F.col("n") / block).alias("m")), "long-lists")
    cells = F.expr("""
        CASE WHEN m IS NULL THEN array(key)
        ELSE transform(sequence(0L, m - 1), j -> xxhash64(key, least(i, j) * m + greatest(i, j))) END""")
    once = posts.join(long, "key", "left").withColumn("i", F.expr("pmod(xxhash64(fp), m)")).select(F.explode(cells).alias("key"), "fp", "shape")
    over = Window.partitionBy("key")
    hub = once.withColumn("hub", F.min(F.struct("fp", "shape")).over(over)).withColumn("n", F.count("*").over(over)).filter("n > 1")
    return written(hub.select("key", "fp", "shape", F.col("hub.fp").alias("hub"), F.col("hub.shape").alias("hub_shape")), "shared-shingles")


def _may_be_alike(shape: Column, other: Column) -> Column:
    """Whether sizes and places of a common element leave room for the similarity."""
    n, m = (F.shiftright(x, 32) for x in (shape, other))
    p, q = (x.bitwiseAND(F.lit((1 << 32) - 1)) for x in (shape, other))
    return COMMON * F.least(F.least(p, q) + F.least(n - p, m - q), n, m) >= BOTH * (n + m)


def possible(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The same for arrays of sizes and places."""
    common = np.minimum(np.minimum(p, q) + np.minimum(n - p, m - q), np.minimum(n, m))
    return COMMON * common >= BOTH * (n + m)


class Bitmaps:
    """The bitmaps of some sets by their lengths, for many comparisons at once."""

    def __init__(self, column: pa.Array):
        lengths = np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4))
        start = int(np.frombuffer(column.buffers()[1], np.int32, 1, column.offset * 4)[0])
        data = np.frombuffer(column.buffers()[2], np.uint8)[start : start + int(lengths.sum())]
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.length, self.row, self.matrix = lengths, np.zeros(len(column), np.int64), {}
        for size in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == size)
            self.row[own] = np.arange(len(own))
            self.matrix[size] = data[(offsets[own][:, None] + np.arange(size)[None, :])].view(np.uint64)

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of places the number of bits that differ; longer bitmaps are folded to the shorter one's length."""
        out = np.zeros(len(a), np.int64)
        for x in np.unique(self.length[a]).tolist():
            for y in np.unique(self.length[b]).tolist():
                at = np.flatnonzero((self.length[a] == x) & (self.length[b] == y))
                for part in np.array_split(at, -(-len(at) // 4096)) if len(at) else ():
                    left, right = self.matrix[x][self.row[a[part]]], self.matrix[y][self.row[b[part]]]
                    while left.shape[1] != right.shape[1]:
                        if left.shape[1] > right.shape[1]:
                            left, right = right, left
                        half = right.shape[1] // 2
                        right = right[:, :half] ^ right[:, half:]
                    out[part] = np.bitwise_count(left ^ right).sum(1)
        return out


def alike_by_bits(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps don't rule the similarity out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                bits = Bitmaps(pa.concat_arrays([batch.column("x"), batch.column("y")]))
                total = batch.column("n").to_numpy().astype(np.int64) + batch.column("m").to_numpy()
                near = COMMON * bits.differ(np.arange(n), np.arange(n, 2 * n)) <= total
                yield batch.select(["a", "b"]).filter(pa.array(near))

    both = pairs.join(sets.selectExpr("fp AS a", "size AS n", "fine AS x"), "a").join(sets.selectExpr("fp AS b", "size AS m", "fine AS y"), "b")
    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that part no list; rows come sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        last = int(np.flatnonzero(keys == keys[-1])[0])
        if last or held and held[0].column("key")[-1].as_py() != keys[-1]:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _by_step(batch: pa.RecordBatch, bits: Bitmaps, group: np.ndarray, step: np.ndarray, alive: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a list, of different groups, that may be alike; all pairs of one distance in the list at a time.

    ``step`` holds each row's next distance and is carried on; rows that are no longer ``alive`` give no more.
    """
    key, shape = batch.column("key").to_numpy(), batch.column("shape").to_numpy()
    size, place = shape >> 32, shape & ((1 << 32) - 1)
    at = np.arange(len(key))
    while True:
        to = at + step[at]
        inside = alive[at] & (to < len(key))
        at, to = at[inside], to[inside]
        inside = key[at] == key[to]
        at, to = at[inside], to[inside]
        if not len(at):
            return
        near = (group[at] != group[to]) & possible(size[at], place[at], size[to], place[to])
        a, b = at[near], to[near]
        near = COMMON * bits.differ(a, b) <= size[a] + size[b]
        if near.any():
            yield a[near], b[near]
        step += 1


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, fp, shape, root, bits) sorted by key those that have some candidate of another root in their list."""
    for batch in _whole_lists(batches):
        n = batch.num_rows
        some = np.zeros(n, bool)
        for a, b in _by_step(batch, Bitmaps(batch.column("bits")), batch.column("root").to_numpy(), np.ones(n, np.int64), np.ones(n, bool)):
            some[a] = some[b] = True
        if some.any():
            yield batch.select(["key", "fp", "shape"]).filter(pa.array(some))


def _next_pairs(times: int):
    """Reads rows (key, fp, shape, root, bits, step) sorted by key and fp; gives candidates (a, b) of each list, from its ``step`` on.

    A list stops at the distance at which it has given ``times`` as many as it has rows, and gives a row (key, step) to go on from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("step", pa.int64())])

        def rows(a, b, key, step) -> pa.RecordBatch:
            n = max(len(a), len(key))
            return pa.RecordBatch.from_arrays([pa.array(x) if len(x) else pa.nulls(n, pa.int64()) for x in (a, b, key, step)], schema=kind)

        for batch in _whole_lists(batches):
            fp, key = batch.column("fp").to_numpy(), batch.column("key").to_numpy()
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            length = np.diff(np.append(starts, len(key)))
            of = np.repeat(np.arange(len(starts)), length)
            step, alive, given = batch.column("step").to_numpy().copy(), np.ones(len(key), bool), np.zeros(len(starts), np.int64)
            for a, b in _by_step(batch, Bitmaps(batch.column("bits")), batch.column("root").to_numpy(), step, alive):
                yield rows(np.minimum(fp[a], fp[b]), np.maximum(fp[a], fp[b]), [], [])
                given += np.bincount(of[a], minlength=len(starts))
                full = np.flatnonzero((given >= times * length) & alive[starts])
                if len(full):
                    yield rows([], [], key[starts[full]], step[starts[full]] + 1)
                    alive &= ~np.isin(of, full)

    return run


def verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets have a similarity of 0.8 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                own = pa.array([shingles(text.as_py()).view(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), own], names=["fp", "own"])

    met = pairs.selectExpr("a AS fp").unionByName(pairs.selectExpr("b AS fp")).distinct()
    of = sets.join(met, "fp", "left_semi").select("fp", F.col("at.text_hash").alias("h"), F.col("at.doc_id").alias("d"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = texts.join(of, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("fp", "text")
    own = written(found.mapInArrow(run, "fp long, own array<long>").dropDuplicates(["fp"]), "shingle-sets")
    both = pairs.join(own.selectExpr("fp AS a", "own AS x"), "a").join(own.selectExpr("fp AS b", "own AS y"), "b")
    out = written(both.filter(COMMON * F.size(F.array_intersect("x", "y")) >= BOTH * (F.size("x") + F.size("y"))).select("a", "b"), "similar-links")
    discard(own)
    return out


def by_fingerprint(sets: DataFrame) -> DataFrame:
    """(a, b), a < b: of ``sets`` (fp, sim) those with equal SimHashes, each with one of them, and these ones where their SimHashes differ in three bits or fewer."""
    firsts = written(sets.groupBy(F.col("sim").alias("fp")).agg(F.min("fp").alias("first")), "set-fingerprints")
    equal = sets.join(firsts.withColumnRenamed("fp", "sim"), "sim").filter("fp != first").selectExpr("first AS a", "fp AS b")
    ends = [firsts.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_first")) for x in ("a", "b")]
    between = near_fingerprints(firsts).join(ends[0], "a").join(ends[1], "b")
    out = written(equal.unionByName(between.selectExpr("least(a_first, b_first) AS a", "greatest(a_first, b_first) AS b")).distinct(), "near-fingerprints")
    discard(firsts)
    return out


def groups(docs: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, root) for every set of ``rows`` (``sketches`` of ``docs``) that is like another one."""
    least = F.min(F.struct("text_hash", "doc_id")).alias("at")
    own = rows.filter("bits IS NOT NULL").groupBy("fp", "size").agg(F.first("sim").alias("sim"), F.first("bits").alias("bits"), F.first("fine").alias("fine"), F.first("keys").alias("keys"), least)
    sets = written(own, "distinct-sets")
    lists = shared_lists(sets, block)
    sets = sets.drop("keys")
    star = lists.filter((F.col("fp") != F.col("hub")) & _may_be_alike(F.col("shape"), F.col("hub_shape"))).select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    near = by_fingerprint(sets)
    candidates = written(alike_by_bits(near.unionByName(star).distinct(), sets), "first-candidates")
    discard(near)
    links = verified(docs, sets, candidates)
    roots = written(components(links), "first-groups")
    rooted = lists.join(roots, F.col("fp") == F.col("node"), "left").select("key", "fp", "shape", F.coalesce("root", "fp").alias("root"))
    mixed = written(_of_many_roots(rooted), "lists-of-groups")
    dealt = mixed.join(sets.select("fp", "bits"), "fp").select("key", "fp", "shape", "root", "bits").repartition("key").sortWithinPartitions("key")
    open_ = written(dealt.mapInArrow(_partners, "key long, fp long, shape long"), "lists-of-candidates")
    failed = written(candidates.join(links, ["a", "b"], "left_anti"), "tried-candidates")
    discard(lists, candidates, mixed)
    reached, times = open_.select("key").distinct().withColumn("step", F.lit(1).cast("long")), 1
    while reached.limit(1).count():
        rows_ = open_.join(roots, F.col("fp") == F.col("node"), "left").select("key", "fp", "shape", F.coalesce("root", "fp").alias("root"))
        rows_ = _of_many_roots(rows_).join(reached, "key").join(sets.select("fp", F.col("fine").alias("bits")), "fp")
        dealt = rows_.select("key", "fp", "shape", "root", "bits", "step").repartition("key").sortWithinPartitions("key", "fp")
        next_ = written(dealt.mapInArrow(_next_pairs(times), "a long, b long, key long, step long"), "list-pairs")
        found = written(next_.filter("a IS NOT NULL").select("a", "b").distinct().join(failed, ["a", "b"], "left_anti"), "other-candidates")
        more = verified(docs, sets, found)
        failed = written(failed.unionByName(found.join(more, ["a", "b"], "left_anti")), "tried-candidates")
        roots = merged(roots, more)
        reached, times = next_.filter("key IS NOT NULL").select("key", "step"), 2 * times
        discard(found, more)
    discard(sets, open_, links)
    return roots


def merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) after the links ``more`` (a, b) between nodes of ``roots`` or new ones; only roots are linked anew."""
    of = [roots.select(F.col("node").alias(x), F.col("root").alias(y)) for x, y in (("a", "x"), ("b", "y"))]
    between = more.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    higher = written(components(between).selectExpr("node AS was", "root AS higher"), "linked-groups")
    moved = roots.join(higher, F.col("root") == F.col("was"), "left").select("node", F.coalesce("higher", "root").alias("root"))
    single = higher.join(roots, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("higher").alias("root"))
    out = written(moved.unionByName(single), "similar-groups")
    discard(higher)
    return out


def _of_many_roots(rows: DataFrame) -> DataFrame:
    """The rows (key, fp, shape, root) of lists that hold sets of different groups."""
    over = Window.partitionBy("key")
    out = rows.withColumn("low", F.min("root").over(over)).withColumn("high", F.max("root").over(over)).filter("low != high")
    return out.select("key", "fp", "shape", "root")


def representatives(docs: DataFrame, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """One row of ``docs`` for each group of similar texts, the one with the smallest doc_id (null is largest), with its own columns.

    Of rows that share that doc_id, one with the smallest set hash and text hash stays; of wholly equal ids and texts the
    one whose columns come first as JSON.
    """
    rows = sketches(docs, sample)
    each = rows.groupBy("fp", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "text_hash", "n")
    best = each.groupBy("fp").agg(F.min(key).alias("k")).join(groups(docs, rows, block), F.col("fp") == F.col("node"), "left")
    kept = best.groupBy(F.coalesce("root", "fp")).agg(F.min("k").alias("k")).select("k.doc_id", "k.text_hash", "k.n")
    kept = written(kept, "kept-documents")
    discard(rows)
    return whole_rows(docs, kept)
