"""Approximate nearest neighbours by cosine: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node. Random hyperplanes deal the nodes into small buckets, whose members make a first graph. Then
each round lets neighbours of a node, in both directions, meet at that node and propose each other; a node keeps its nearest.
A query starts at some nodes, looks at the neighbours of the best nodes it knows and hasn't opened, and ends when none of its
best is unopened. Rounds are joins on node ids; nothing is gathered but counts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BinaryType, DoubleType

from cladeframe.llm.common import column_of, whole_groups
from cladeframe.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Neighbours of a node.
K = 32
#: Neighbours, and nodes it is a neighbour of, that meet at a node in a round; sampled anew each round.
MEET = 12
#: First graph: times the nodes are dealt out, and the usual size of a bucket; the largest is twice that.
DEALS = 12
BUCKET = 1024
#: A round that improves a smaller share of all neighbours is the last one.
LEAST_CHANGE = 0.08
#: Best nodes a query knows, and how many of them it opens in a round.
BEAM = 128
OPEN = 32
#: Nodes every query starts at.
STARTS = 8
#: Best nodes of a query whose score is computed anew from the original vectors, in double precision.
EXACT = 32
SEED = 11


def usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """``vec_id, vec`` of vectors with a direction: not NULL, not zero, all components finite, of the most common length."""
    v = F.col(vector).cast("array<float>")
    rows = vectors.select(F.col(id_).cast("long").alias("vec_id"), v.alias("vec")).where(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull()
    )
    rows = rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    usual = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vec") == (usual[0].n if usual else 0))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def halves(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Directions from their half precision bytes, as which they travel between tasks."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(len(column), -1).astype(np.float32)


@F.arrow_udf(BinaryType())
def half_of(vec: pa.Array) -> pa.Array:
    return pa.array([x.tobytes() for x in unit(matrix(vec)).astype(np.float16)], pa.binary())


@F.arrow_udf(DoubleType())
def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    a, b = (matrix(x).astype(np.float64) for x in (a, b))
    return pa.array((a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1)) / np.sqrt((b * b).sum(axis=1)))


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def lists(values: np.ndarray, size: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(values, kind))


def _best(node: np.ndarray, near: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each node from (node, near, sim) with repeats, sorted by node and nearness."""
    order = np.lexsort((near, -sim, node))
    node, near, sim = node[order], near[order], sim[order]
    # equal pairs have equal similarity, but for rounding; the first one stays
    pair = np.lexsort((np.arange(len(node)), near, node))
    again = np.append(False, (node[pair][1:] == node[pair][:-1]) & (near[pair][1:] == near[pair][:-1]))
    keep = np.ones(len(node), bool)
    keep[pair[again]] = False
    node, near, sim = node[keep], near[keep], sim[keep]
    start = np.append(0, np.flatnonzero(node[1:] != node[:-1]) + 1) if len(node) else np.empty(0, np.int64)
    rank = np.arange(len(node)) - np.repeat(start, np.diff(np.append(start, len(node))))
    top = rank < k
    return node[top], near[top], sim[top]


GRAPH = "node bigint, near array<bigint>, sim array<float>"


def _graph_rows(node: np.ndarray, near: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    nodes, size = np.unique(node, return_counts=True)
    return pa.record_batch(
        [pa.array(nodes, pa.int64()), lists(near, size, pa.int64()), lists(sim.astype(np.float32), size, pa.float32())], names=["node", "near", "sim"]
    )


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    near = column_of(b, "near")
    size = np.diff(near.offsets.to_numpy())
    node = np.repeat(column_of(b, "node").to_numpy(zero_copy_only=False), size)
    return node, near.flatten().to_numpy(zero_copy_only=False), column_of(b, "sim").flatten().to_numpy(zero_copy_only=False)


def _merge(rows: DataFrame, k: int) -> DataFrame:
    """One row per node with its k nearest, from several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches, "node"):
            yield _graph_rows(*_best(*_flat(b), k))

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, GRAPH)


def first_graph(nodes: DataFrame, n: int, k: int = K) -> DataFrame:
    """Neighbours inside buckets of nodes on the same sides of random hyperplanes through the mean."""
    if not n:
        return nodes.sparkSession.createDataFrame([], GRAPH)
    dims = nodes.select(F.size("vec")).first()[0]
    mean = np.array(nodes.agg(*[F.avg(F.col("vec")[i]) for i in range(dims)]).first(), float)
    bits = max(0, int(np.ceil(np.log2(max(1, n / BUCKET)))))
    planes = np.random.default_rng(SEED).normal(size=(DEALS, dims, bits))

    @F.arrow_udf("array<bigint>")
    def sides(vec: pa.Array) -> pa.Array:
        v = matrix(vec) - mean
        found = [((v @ p > 0) * (1 << np.arange(bits))).sum(axis=1) * DEALS + i for i, p in enumerate(planes)]
        return pa.array(np.stack(found, axis=1).tolist(), pa.list_(pa.int64()))

    deals = materialise(nodes.select("node", F.explode(sides("vec")).alias("bucket")), "deals")
    counts = deals.groupBy("bucket").count().withColumnRenamed("count", "n")
    # a bucket that is too large is dealt on by chance
    part = F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("n") / (2 * BUCKET)))
    dealt = deals.join(counts, "bucket").select("node", "bucket", part.alias("part")).join(nodes.select("node", "half"), "node")

    def near(t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        v = halves(t.column("half"))
        s = v @ v.T
        np.fill_diagonal(s, -2)
        m = min(k, len(node) - 1)
        at = np.argpartition(-s, m - 1, axis=1)[:, :m] if m > 0 else np.empty((len(node), 0), np.int64)
        sim = np.take_along_axis(s, at, axis=1)
        size = np.full(len(node), m)
        return pa.table([pa.array(node), lists(node[at].ravel(), size, pa.int64()), lists(sim.ravel(), size, pa.float32())], names=["node", "near", "sim"])

    return _merge(dealt.groupBy("bucket", "part").applyInArrow(near, GRAPH), k)


def _sampled(edges: DataFrame, by: str, salt: int, m: int) -> DataFrame:
    """At most m edges of each node, by chance; the limit is applied before rows move."""
    number = F.row_number().over(W.partitionBy(by).orderBy(F.xxhash64("center", "member", F.lit(salt)), "center", "member"))
    return edges.withColumn("number", number).where(F.col("number") <= m).drop("number")


def descend(graph: DataFrame, nodes: DataFrame, round_: int, k: int = K, meet: int = MEET) -> DataFrame:
    """One round: members that meet at a center propose each other. ``graph`` rows of improved proposals."""
    edges = graph.select(F.col("node").alias("center"), F.explode("near").alias("member"))
    forward = _sampled(edges, "center", round_, meet)
    backward = _sampled(edges, "member", round_ + 1000, meet).select(F.col("member").alias("center"), F.col("center").alias("member"))
    worst = F.when(F.size("sim") < k, F.lit(-2.0)).otherwise(F.array_min("sim")).cast("float")
    known = nodes.select("node", "half").join(graph.select("node", worst.alias("worst")), "node")
    rows = forward.unionByName(backward).distinct().join(known.withColumnRenamed("node", "member"), "member")

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches, "center"):
            center = column_of(b, "center").to_numpy()
            member, worst = column_of(b, "member").to_numpy(), column_of(b, "worst").to_numpy()
            start = np.append(0, np.flatnonzero(center[1:] != center[:-1]) + 1)
            size = np.diff(np.append(start, len(center)))
            place = np.arange(len(center)) - np.repeat(start, size)
            group = np.repeat(np.arange(len(start)), size)
            v = halves(column_of(b, "half"))
            m = int(size.max())
            padded, who = np.zeros((len(start), m, v.shape[1]), np.float32), np.full((len(start), m), -1, np.int64)
            padded[group, place], who[group, place] = v, member
            least = np.full((len(start), m), 2, np.float32)
            least[group, place] = worst
            s = padded @ padded.transpose(0, 2, 1)
            better = (s > least[:, :, None]) & (who[:, None, :] >= 0) & (who[:, :, None] != who[:, None, :])
            g, i, j = np.nonzero(better)
            if len(g):
                yield _graph_rows(*_best(who[g, i], who[g, j], s[g, i, j], k))

    rows = rows.repartition("center").sortWithinPartitions("center")
    return rows.select("center", "member", "worst", "half").mapInArrow(propose, GRAPH)


def neighbour_graph(nodes: DataFrame, k: int = K, least_change: float = LEAST_CHANGE) -> DataFrame:
    """``node, near, sim``: the graph of ``node, vec, half``, improved until a round changes little."""
    n = nodes.count()
    graph = materialise(first_graph(nodes, n, k), "graph")
    round_ = 0
    while n > 2:
        found = descend(graph, nodes, round_, k)
        after = materialise(_merge(graph.unionByName(found), k), "graph")
        old = graph.select("node", F.col("near").alias("old"))
        changed = after.join(old, "node", "left").agg(F.sum(F.size(F.array_except("near", F.coalesce("old", F.array().cast("array<bigint>"))))), F.sum(F.size("near"))).first()
        graph = after
        round_ += 1
        if (changed[0] or 0) <= least_change * (changed[1] or 1):
            break
    return graph


def both_ways(graph: DataFrame, k: int = K) -> DataFrame:
    """``node, near`` with edges in both directions; of backward edges at most k by chance."""
    edges = graph.select(F.col("node").alias("center"), F.explode("near").alias("member"))
    back = _sampled(edges, "member", -1, k).select(F.col("member").alias("center"), F.col("center").alias("member"))
    return edges.unionByName(back).groupBy("center").agg(F.collect_set("member").alias("near")).withColumnRenamed("center", "node")


STATE = "query_id bigint, half binary, node array<bigint>, score array<float>, opened array<boolean>, seen array<bigint>"


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, beam: int = BEAM, open_: int = OPEN) -> DataFrame:
    """``query_id, node, score``: the best nodes found for each ``query_id, half`` (and ``start``, a node or NULL), best first."""
    edges = materialise(both_ways(graph), "search-graph")
    starts = [r.node for r in nodes.orderBy(F.xxhash64("node"), "node").limit(STARTS).select("node").collect()]
    first = F.array_distinct(F.array_compact(F.concat(F.array("start"), F.array(*[F.lit(s).cast("long") for s in starts]))))
    empty = [F.expr(f"cast(array() as array<{t}>)").alias(n) for n, t in (("node", "bigint"), ("score", "float"), ("opened", "boolean"), ("seen", "bigint"))]
    state = materialise(queries.select("query_id", "half", *empty), "search-state")
    look = queries.select(F.col("query_id").alias("asked"), F.explode(first).alias("node"))

    def advance(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left
        row = left.slice(0, 1)
        node, score, opened, seen = (np.array(row.column(n)[0].as_py(), t) for n, t in (("node", np.int64), ("score", np.float32), ("opened", bool), ("seen", np.int64)))
        # the best unopened ones were looked at in this round
        opened[np.flatnonzero(~opened)[:open_]] = True
        if right.num_rows:
            new = right.column("other").to_numpy()
            s = halves(right.column("other_half")) @ halves(row.column("half"))[0]
            node, score = np.append(node, new), np.append(score, s)
            opened, seen = np.append(opened, np.zeros(len(new), bool)), np.append(seen, new)
            top = np.lexsort((node, -score))[:beam]
            node, score, opened = node[top], score[top], opened[top]
        kinds = (pa.int64(), pa.float32(), pa.bool_(), pa.int64())
        out = [pa.array([x.tolist()], pa.list_(t)) for x, t in zip((node, score, opened, seen), kinds)]
        return pa.table([row.column("query_id"), row.column("half"), *out], names=["query_id", "half", "node", "score", "opened", "seen"])

    while True:
        met = look.withColumnRenamed("node", "other").join(nodes.select(F.col("node").alias("other"), F.col("half").alias("other_half")), "other")
        state = materialise(state.groupBy("query_id").cogroup(met.groupBy("asked")).applyInArrow(advance, STATE), "search-state")
        unopened = F.filter(F.arrays_zip("node", "opened"), lambda x: ~x["opened"])
        waiting = state.select(F.col("query_id").alias("asked"), F.explode(F.transform(F.slice(unopened, 1, open_), lambda x: x["node"])).alias("node"))
        if not waiting.limit(1).count():
            break
        look = waiting.join(edges, "node").select("asked", F.explode("near").alias("node")).distinct()
        seen = state.select(F.col("query_id").alias("asked"), F.explode("seen").alias("node"))
        # files of these tables are much smaller than their rows, so their size says nothing about a broadcast
        look = look.join(seen.hint("merge"), ["asked", "node"], "left_anti")
    found = state.select("query_id", F.posexplode(F.arrays_zip("node", "score")).alias("place", "x"))
    return found.select("query_id", "place", "x.node", "x.score")


def nearest(vectors: DataFrame, is_query: Column, top: int = 5, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest other rows of each query row, by cosine in double precision.

    Vectors that are NULL, zero or hold NULL or non-finite components, and rows without id, take no part. Equal vectors are found
    together; ties go to the smaller id. Repeated rows of one id and vector count once. With fewer other rows than ``top``, all are returned; an empty table gives no rows.
    """
    rows = materialise(usable(vectors, id_, vector).distinct(), "vectors")
    nodes = materialise(rows.groupBy("vec").agg(F.min("vec_id").alias("node")).select("node", "vec", half_of("vec").alias("half")), "nodes")
    tied = rows.join(nodes, "vec").select("vec_id", "node")
    tied = materialise(tied, "members")
    number = F.row_number().over(W.partitionBy("node").orderBy("vec_id"))
    # of equal vectors, only the smallest ids can be among a query's nearest
    members = tied.withColumn("number", number).where(F.col("number") <= top + 1).select("node", "vec_id")
    graph = neighbour_graph(nodes)
    asked = tied.where(is_query).join(nodes, "node").select(F.col("vec_id").alias("query_id"), "vec", "half", F.col("node").alias("start"))
    asked = materialise(asked, "queries")
    found = search(asked, nodes, graph).where(F.col("place") < EXACT).select("query_id", "node")
    own = asked.select("query_id", F.col("vec").alias("query_vec"))
    found = found.join(own, "query_id").join(nodes.select("node", "vec"), "node").select("query_id", "node", cosine("query_vec", "vec").alias("score"))
    each = found.join(members, "node").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
