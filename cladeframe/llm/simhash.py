"""SimHash fingerprints, and near copies by a Gray-order hierarchical index.

Fingerprints within d differing bits agree on at least one of d + 1 blocks of bits. Each distinct fingerprint goes
to one bucket per block. Inside a bucket, fingerprints are sorted by Gray rank, so that neighbours share many
bits. Runs of neighbours become leaves, runs of leaves become upper nodes; a node keeps the bits that all its members share. Two nodes
whose shared bits already differ in more than d places are dropped with everything below them. A bucket too large for one
task is cut into runs first, and the same test on the runs' shared bits says which pairs of runs must meet.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladeframe.llm.common import as_bytes, column_of, components, tidy, words
from cladeframe.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 4
SEED = 42
MAX_DIFF = 4
#: Members of a node, at every level of the index.
FAN = 32
#: Largest bucket that one task joins as a whole; larger ones are cut into runs of this length.
RUN = 4096
#: Pairs compared at once.
SLICE = 1 << 20


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """Majority of the bits of all shingle hashes; 0 for a text without words."""
    ws = words(text)
    if not ws:
        return 0
    joined = memoryview(b" ".join(ws))
    k = min(k, len(ws))
    starts = np.zeros(len(ws) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1, out=starts[1:])
    n = len(ws) - k + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:to].tolist(), (starts[at + k : to + k] - 1).tolist())], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp`` of every document; the fingerprint is a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in as_bytes(column_of(b, "text"))], np.uint64).view(np.int64)
            yield pa.record_batch([column_of(b, "doc_id"), column_of(b, "text_hash"), pa.array(fps)], names=["doc_id", "text_hash", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, text_hash bigint, fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of a word in the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def nodes(bits_and: np.ndarray, bits_or: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level up: what runs of FAN nodes share."""
    at = np.arange(0, len(bits_and), FAN)
    return np.bitwise_and.reduceat(bits_and, at), np.bitwise_or.reduceat(bits_or, at)


def near_pairs(fps: np.ndarray, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of Gray-sorted fingerprints with at most d differing bits, in slices of bounded size."""
    levels = [(fps, fps)]
    while len(levels[-1][0]) > FAN:
        levels.append(nodes(*levels[-1]))

    def differ(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        land, lor = levels[level]
        # a bit counts if all members of one node have it set and all members of the other have it clear
        apart = (land[i] & ~lor[j]) | (land[j] & ~lor[i])
        return np.bitwise_count(apart) <= d

    def descend(level: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keep = differ(level, i, j)
        i, j = i[keep], j[keep]
        if level == 0:
            if len(i):
                yield i, j
            return
        n = len(levels[level - 1][0])
        step = max(1, SLICE // (FAN * FAN))
        kids = np.arange(FAN)
        for at in range(0, len(i), step):
            a = (i[at : at + step, None] * FAN + kids).repeat(FAN, axis=1).ravel()
            b = np.tile(j[at : at + step, None] * FAN + kids, (1, FAN)).ravel()
            ok = (a < n) & (b < n) & ((a < b) if level == 1 else (a <= b))
            yield from descend(level - 1, a[ok], b[ok])

    top = len(levels) - 1
    m = len(levels[top][0])
    i, j = np.triu_indices(m, k=1 if top == 0 else 0)
    yield from descend(top, i, j)


def spanning(fps: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked in one bucket: every fingerprint with the smallest one it reaches."""
    if len(fps) < 2:
        return fps[:0], fps[:0]
    fps = fps[np.argsort(gray_rank(fps), kind="stable")]
    label = np.arange(len(fps))
    for i, j in near_pairs(fps, d):
        new = label[i] != label[j]
        if new.any():
            label = components(len(fps), np.append(label[i[new]], np.arange(len(fps))), np.append(label[j[new]], label))
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def _join_buckets(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Links inside the buckets of one partition, which comes sorted by bucket; rows of a bucket may span batches."""

    def links(key: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.append(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key))
        starts = np.append(0, ends[:-1])
        size = ends - starts
        out_a, out_b = [], []
        # small buckets all at once: compare each row with the s-th after it, while both lie in one bucket
        small = size <= FAN
        last = np.repeat(np.where(small, ends, 0), size)
        at = np.arange(len(fps))
        for s in range(1, FAN):
            i = at[at + s < last]
            if not len(i):
                break
            i = i[np.bitwise_count(fps[i] ^ fps[i + s]) <= d]
            out_a.append(fps[i])
            out_b.append(fps[i + s])
        for k in np.flatnonzero(~small):
            a, b = spanning(fps[starts[k] : ends[k]], d)
            out_a.append(a)
            out_b.append(b)
        a, b = np.concatenate(out_a or [fps[:0]]), np.concatenate(out_b or [fps[:0]])
        if len(a):
            a, b = a.view(np.int64), b.view(np.int64)
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    key, fps = np.empty((0, 3), np.int64), np.empty(0, np.uint64)
    for batch in batches:
        k = np.stack([column_of(batch, n).to_numpy(zero_copy_only=False) for n in ("bucket", "run_a", "run_b")], axis=1)
        key = np.concatenate([key, k])
        fps = np.concatenate([fps, column_of(batch, "fp").to_numpy(zero_copy_only=False).view(np.uint64)])
        changes = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
        if len(changes):
            cut = changes[-1] + 1
            yield from links(key[:cut], fps[:cut])
            key, fps = key[cut:], fps[cut:]
    if len(fps):
        yield from links(key, fps)


def links(distinct: DataFrame, max_diff: int = MAX_DIFF, run: int = RUN) -> DataFrame:
    """Links ``a < b`` between distinct fingerprints ``fp``, enough to connect all that are near each other."""
    blocks = max_diff + 1
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    # the bucket's number holds the block and the block's bits
    parts = [
        F.shiftrightunsigned(F.shiftleft("fp", 64 - hi), 64 - hi + lo) * blocks + i for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))
    ]
    rows = distinct.select("fp", F.explode(F.array(*parts)).alias("bucket"))
    large = materialise(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > run), "large-buckets")
    zero = F.lit(0).cast("long")
    small = rows.join(large, "bucket", "left_anti").select("bucket", zero.alias("run_a"), zero.alias("run_b"), "fp")
    hot = rows.join(large, "bucket")
    rank = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))
    hot = hot.select("bucket", "fp", rank.bitwiseXOR(F.lit(-(2**63)).cast("long")).alias("rank"))
    # ranges, not buckets, go to tasks; ids of different ranges are far apart, so no run reaches over the end of its range
    hot = hot.repartitionByRange("bucket", "rank").sortWithinPartitions("bucket", "rank")
    hot = hot.withColumn("at", F.monotonically_increasing_id()).select("bucket", F.expr(f"at div {run}").alias("run"), "fp")
    hot = materialise(hot, "large-bucket-runs")
    bits = F.bit_and("fp").alias("all_set"), F.bit_or("fp").alias("some_set")
    low = hot.groupBy("bucket", "run").agg(*bits).withColumn("above", F.expr(f"run div {FAN}"))
    low = materialise(low, "shared-bits")
    top = low.groupBy("bucket", "above").agg(F.bit_and("all_set").alias("all_set"), F.bit_or("some_set").alias("some_set"))
    near = F.expr(f"bit_count((x.all_set & ~y.some_set) | (y.all_set & ~x.some_set)) <= {max_diff}")
    met = top.alias("x").join(top.alias("y"), F.expr("x.bucket = y.bucket and x.above <= y.above") & near)
    met = met.select("x.bucket", F.col("x.above").alias("above_a"), F.col("y.above").alias("above_b")).alias("m")
    meet = met.join(low.alias("x"), F.expr("x.bucket = m.bucket and x.above = m.above_a"))
    meet = meet.join(low.alias("y"), F.expr("y.bucket = m.bucket and y.above = m.above_b and x.run <= y.run") & near)
    meet = meet.select("m.bucket", F.col("x.run").alias("run_a"), F.col("y.run").alias("run_b"))
    sides = meet.withColumn("run", F.explode(F.array_distinct(F.array("run_a", "run_b"))))
    hot = hot.join(sides, ["bucket", "run"]).select("bucket", "run_a", "run_b", "fp")
    buckets = small.unionByName(hot).repartition("bucket", "run_a", "run_b").sortWithinPartitions("bucket", "run_a", "run_b")
    return buckets.mapInArrow(tidy(lambda it: _join_buckets(it, max_diff)), "a bigint, b bigint").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for all nodes of ``a, b`` edges; root is the smallest node of the component.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its smallest one, then
    every node hands its smaller neighbours to the smallest. Paths shrink at each step; a node's neighbours are never gathered, only
    their minimum is. Every round is a table in the shared folder.
    """
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").distinct()
        edges = materialise(edges, "edges")
        low = edges.groupBy("b").agg(F.min("a").alias("m"))
        near = edges.join(low, "b")
        # b and every smaller neighbour a of b hang below the smallest of them
        near = near.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        edges = materialise(near, "edges")
        now = edges.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first()
        if tuple(now) == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = tuple(now)


def classes(prints: DataFrame, max_diff: int = MAX_DIFF, run: int = RUN) -> DataFrame:
    """``fp, root, component_id`` of every distinct fingerprint of ``doc_id, fp``.

    The component's id is the smallest doc_id reachable (NULL where no row has one), root its smallest fingerprint.
    """
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-prints")
    roots = connected(links(distinct.select("fp"), max_diff, run))
    tied = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    tied = materialise(tied, "rooted-prints")
    least = tied.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return tied.join(least, "root").select("fp", "root", "component_id")


def near_classes(docs: DataFrame, max_diff: int = MAX_DIFF) -> DataFrame:
    """``doc_id, fp, component_id`` of every document.

    Texts without words, NULL among them, have fingerprint 0 and are linked like any others. Repeated rows stay. A class whose
    rows have no id has a NULL component. An empty table gives no rows.
    """
    prints = materialise(fingerprints(docs), "prints")
    return prints.join(classes(prints, max_diff), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, max_diff: int = MAX_DIFF) -> DataFrame:
    """One document of each class, the one with the smallest id; all columns as they were.

    Of several rows with that id, the one with the smallest text hash stays. A class without ids keeps one row.
    """
    prints = materialise(fingerprints(docs), "prints")
    first = prints.join(classes(prints, max_diff), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = first.groupBy("root").agg(F.min(F.struct(F.col("text_hash"), "doc_id")).alias("kept"))
    kept = first.select(F.xxhash64("kept.doc_id", "kept.text_hash").alias("key"))
    # joined and numbered by one key, so whole rows are moved once
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(docs.doc_id, F.xxhash64(docs.text)).alias("key")).join(kept, "key")
    number = F.row_number().over(W.partitionBy("key").orderBy(F.lit(0)))
    return rows.withColumn("number", number).where("number = 1").select("row.*")
