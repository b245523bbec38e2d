"""Near-duplicate groups by SimHash and multi-index hashing.

Each text gets a 64-bit fingerprint over its word shingles. Distinct fingerprints are then
linked at ``DISTANCE`` or fewer differing bits: a fingerprint is cut into two segments of 32
bits, and if two differ in at most three bits, they differ in at most one bit of some segment.
So each segment's Hamming ball of radius one is enumerated and looked up in the table of
segment values. A step across one bit changes the segment's parity, so only segments of even
parity probe: the other end of each link is then in the table.

Each looked-up cell is searched locally for a spanning forest of its links, verified on whole
fingerprints, so its output grows with its rows and not with its pairs. Cells of frequent
segment values are cut into blocks whose pairs are all visited, so no task holds more than a
few blocks. Links are merged to components by alternating large-star and small-star rounds.

Edge cases: null texts count as empty; an empty text has fingerprint zero and is linked like
any other; a null doc_id never names a component unless all ids of it are null; repeated rows
each get a row; an empty table gives an empty result; other columns are ignored by ``near_duplicates``
and kept, whatever their names, by ``representatives``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import discard, whole_rows, written

SHINGLE = 3
DISTANCE = 3
SEED = 42
SEGMENTS = 2
SEGMENT_BITS = 32
#: Table rows (and probing rows) of one segment value that one cell holds at most; beyond it is cut into blocks.
BLOCK = 4096


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that more than half of the hashes have set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # so that very long texts take bounded memory
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    hashes = np.fromiter(
        (xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)),
        np.uint64,
        n,
    )
    return majority(hashes)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): one row per row of ``docs``; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(bits.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def spanning(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect whatever fingerprints of the cell links of ``distance`` bits connect."""
    links, left = [], np.unique(fps)
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                found = left[near]
                links += [(int(at), int(x)) for x in found]
                left = left[~near]
                frontier += list(found)
    return links


def _links_of_cells(distance: int):
    """Reads rows (seg, key, cell, own, fp) sorted by cell; gives each cell's spanning links."""

    def of(groups: np.ndarray, own: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
        bounds = np.append(groups, len(fps))
        out: list[tuple[int, int]] = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a > 1 and own[a:b].any():
                out += spanning(fps[a:b], distance)
        return out

    def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            cols[4] = cols[4].view(np.uint64)
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            seg, key, cell, own, fps = cols
            new = np.flatnonzero((seg[1:] != seg[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
            if not len(new):
                rest = cols
                continue
            last = new[-1]
            starts = np.concatenate(([0], new[:-1]))
            rest = [x[last:] for x in cols]
            sizes = np.diff(np.append(starts, last))
            keep = np.repeat(sizes > 1, sizes)  # most cells hold one row
            if keep.any():
                sizes = sizes[sizes > 1]
                if links := of(np.concatenate(([0], np.cumsum(sizes)[:-1])), own[:last][keep], fps[:last][keep]):
                    yield batch_of(links)
        if rest is not None and (links := of(np.array([0]), rest[3], rest[4])):
            yield batch_of(links)

    return run


def links(reps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): links of distinct fingerprints ``reps.fp`` that span all pairs within ``distance`` bits."""
    if distance // SEGMENTS > 1:
        raise ValueError("two segments with balls of radius one reach three bits")
    whole = (1 << SEGMENT_BITS) - 1
    segment = [F.col("fp").bitwiseAND(F.lit(whole)), F.shiftrightunsigned("fp", SEGMENT_BITS)]
    table = reps.select("fp", F.posexplode(F.array(*segment)).alias("seg", "key"))
    # Values with many fingerprints, and the values one bit away from them, which they probe.
    hot = table.groupBy("seg", "key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    flips = F.expr(f"transform(sequence(0, {SEGMENT_BITS - 1}), i -> key ^ shiftleft(1L, i))")
    around = hot.select("seg", F.explode(flips).alias("key"), F.lit(0).cast("long").alias("n"), F.col("n").alias("probes"))
    blocks = written(
        hot.withColumn("probes", F.lit(0).cast("long")).unionByName(around).groupBy("seg", "key")
        .agg(F.ceil(F.sum("n") / block).alias("own_blocks"), F.ceil(F.sum("probes") / block).alias("probe_blocks")),
        "simhash-blocks",
    )
    probes = (
        table.filter(F.bit_count("key") % 2 == 0)
        .select("fp", "seg", F.explode(flips).alias("key"), F.lit(False).alias("own"))
    )
    rows = table.select("fp", "seg", "key", F.lit(True).alias("own")).unionByName(probes).join(blocks, ["seg", "key"], "left")
    # Cells: block i of the table meets block j in cell -(1 + i * m + j), i <= j, and block q of the probes in cell i * k + q.
    cells = F.expr("""
        CASE WHEN own_blocks IS NULL THEN array(0L)
        WHEN own THEN concat(
            transform(sequence(0L, m - 1), j -> -(1L + least(i, j) * m + greatest(i, j))),
            transform(sequence(0L, k - 1), q -> i * k + q))
        ELSE transform(sequence(0L, m - 1), b -> b * k + q0) END""")
    rows = (
        rows.withColumn("m", F.greatest("own_blocks", F.lit(1).cast("long")))
        .withColumn("k", F.greatest("probe_blocks", F.lit(1).cast("long")))
        .withColumn("i", F.expr("pmod(xxhash64(fp), m)"))
        .withColumn("q0", F.expr("pmod(xxhash64(fp), k)"))
        .select("seg", "key", F.explode(cells).alias("cell"), "own", "fp")
    )
    cells_ = rows.repartition("seg", "key", "cell").sortWithinPartitions("seg", "key", "cell")
    return cells_.mapInArrow(_links_of_cells(distance), "a long, b long")


def _all_stars(edges: DataFrame) -> bool:
    """Whether the links (a, b), a > b, are stars already: every a has one b, and no b is an a."""
    ends = edges.select("a", F.lit(1).alias("out")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("out")))
    odd = ends.groupBy("a").agg(F.sum("out").alias("out"), F.min("out").alias("all_out")).filter("out > 1 OR out = 1 AND all_out = 0")
    return odd.agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node it is connected with.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) until the links are stars. Each
    round is written to the shared folder; what a node's neighbours give is a minimum, summed up before the
    shuffle, and the join that applies it is a plain one, so that a hot node's rows can be split.
    """
    stars = written(edges.filter("a != b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "links")
    while not _all_stars(stars):
        before = stars
        both = stars.unionByName(stars.selectExpr("b AS a", "a AS b"))
        lows = written(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a AS u", "least(a, m) AS m"), "large-star")
        large = both.filter("b > a").join(lows, F.col("a") == F.col("u")).selectExpr("b AS a", "m AS b")
        wide = written(large.filter("a != b").distinct(), "links")
        least = written(wide.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), "small-star")
        small = wide.join(least, F.col("a") == F.col("u")).selectExpr("b AS a", "m AS b").filter("a != b")
        stars = written(small.unionByName(least.selectExpr("u AS a", "m AS b")).distinct(), "links")
        discard(before, lows, wide, least)
    roots = stars.select("b").distinct().selectExpr("b AS node", "b AS root")
    return stars.selectExpr("a AS node", "b AS root").unionByName(roots)


def classes(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(fp, root, component_id) for every fingerprint of ``fps`` (doc_id, fp); root is a fingerprint of the class."""
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    members = written(components(links(reps, distance, block)).withColumnRenamed("node", "fp"), "components")
    named = written(members.join(reps, "fp"), "members")
    names = written(named.groupBy("root").agg(F.min("least_id").alias("name")), "component-names")
    of = named.join(names, "root").select("fp", "root", "name", F.lit(True).alias("linked"))
    name = F.when(F.col("linked"), F.col("name")).otherwise(F.col("least_id"))
    return written(reps.join(of, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), name.alias("component_id")), "classes")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    fps = written(fingerprints(docs, shingle).select("doc_id", "fp"), "fingerprints")
    return fps.join(classes(fps, distance, block), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of ``docs`` for each group, the one with the smallest doc_id (null is largest), with its own columns.

    Of rows that share that doc_id, one with the smallest fingerprint and text hash stays; of wholly equal ids and texts
    the one whose columns come first as JSON. Texts aren't written with their fingerprints; they are read again at the end.
    """
    fps = written(fingerprints(docs, shingle), "fingerprinted")
    each = fps.groupBy("fp", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "text_hash", "n")
    kept = each.join(classes(fps.select("doc_id", "fp"), distance), "fp").groupBy("root").agg(F.min(key).alias("k"))
    return whole_rows(docs, written(kept.select("k.doc_id", "k.text_hash", "k.n"), "kept-documents"))


def op2(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
