"""Tree search as rounds of set-at-a-time jobs.

A round moves every run of every alignment at once: neighbours of all current
trees, duplicates and known trees removed by key, one scoring job, one best-set
job. Each round is written to the shared folder, which cuts the lineage and lets
the search go on from the last round when executors are lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.operators.groups import with_group_value
from cladeframe.operators.moves import keyed_moves, moved
from cladeframe.operators.scoring import pattern_packs, score_moves, score_packs
from cladeframe.operators.topology import best_set
from cladeframe.operators.trees import with_topology_key
from cladeframe.plans.enumerate import ABSENT, enumerate_topologies, extend
from cladeframe.session import materialise, spread

#: Kernels of the neighbourhoods, each holding the one before.
NEIGHBOURHOODS = {"nni": "nni", "spr": "spr_full", "tbr": "tbr_full"}
#: Moves that are scored as one row of a pack, about; a tree with more is several rows.
GROUP = 512


def exact_search(alignments: DataFrame, patterns: DataFrame, n: int) -> DataFrame:
    """All shortest trees of each alignment of n taxa (n up to 9), by trying every topology."""
    every = enumerate_topologies(spread(alignments.select("alignment_id"), "alignment_id"), n)
    return best_set(score_packs(every, pattern_packs(patterns)), ["alignment_id"])


def stepwise_trees(alignments: DataFrame, patterns: DataFrame) -> DataFrame:
    """Start trees by adding taxa one at a time in the shortest way.

    ``alignments(alignment_id, n)`` may differ in n. Every round tries all places
    for the next taxon in all kept trees and keeps all the shortest; there is one job
    per taxon. The parent array names a partial tree: with a fixed order of taxa every
    topology comes about in one way only. Three taxa have one tree.
    """
    packs = pattern_packs(patterns)
    largest = alignments.agg(F.max("n")).first()[0] or 0
    absent = F.array_repeat(F.lit(ABSENT), (2 * F.col("n") - 6).cast("int"))
    start = F.concat(F.array(F.lit(-1), F.lit(0), F.lit(0)), absent)
    kept = alignments.filter("n >= 3").select("alignment_id", "n", start.alias("parent"))
    done = score_packs(kept.filter("n = 3"), packs)
    for taxon in range(3, largest):
        grown = extend(spread(kept.filter(F.col("n") > taxon), "alignment_id", "parent"), F.lit(taxon))
        scored = score_packs(grown, packs)
        kept = best_set(scored, ["alignment_id"])
        done = done.unionByName(kept.filter(F.col("n") == taxon + 1))
        kept = kept.select("alignment_id", "n", "parent")
    return done.select("alignment_id", "parent", "length")


def hill_climb(
    starts: DataFrame,
    patterns: DataFrame,
    neighbourhood: str = "nni",
) -> DataFrame:
    """Climb from start trees until no unseen tree is as short as the best.

    ``starts(run_id, alignment_id, parent)``. Each round takes all trees of a run
    that were new and shortest in the round before, so plateaus are explored in
    full. Result: all distinct shortest trees met, ``run_id, alignment_id, key,
    parent, length``. ``neighbourhood`` is nni, spr or tbr.

    A candidate is a tree of the frontier and a move, with the key of the tree it gives; that tree only exists in the tasks that work
    out its key and its length. A round writes keys, moves and lengths, and whole trees for the next frontier only. Keys met before
    are a table of their own that each round adds to.
    """
    group, ids = ["run_id"], ["run_id", "key"]
    kind = NEIGHBOURHOODS[neighbourhood]
    blocks = pattern_packs(patterns)
    first = materialise(with_topology_key(starts.select("run_id", "alignment_id", "parent")), "climb-new").dropDuplicates(ids)
    frontier = materialise(best_set(score_packs(first, blocks), group), "climb")
    met, seen = frontier, materialise(first.select(*ids), "climb-keys")
    best = frontier.groupBy(*group).agg(F.min("length").alias("best"))
    while True:
        origin = frontier.select("run_id", "alignment_id", F.col("key").alias("origin"), "parent")
        near = keyed_moves(origin, ["run_id", "alignment_id", "origin"], kind)
        move = F.struct("origin", "code", "a", "b", "c")
        fresh = near.groupBy(*ids).agg(F.min(move).alias("m")).join(seen, ids, "left_anti").select(*ids, "m.*")
        fresh = materialise(fresh, "climb-new")
        if fresh.isEmpty():
            break
        # moves of one tree in rows of bounded size
        rows = fresh.join(origin.select("run_id", "origin", "alignment_id", F.size("parent").alias("_b")), ["run_id", "origin"])
        part = F.pmod(F.xxhash64("key"), F.ceil(F.col("_b").cast("bigint") * F.col("_b") / GROUP))
        groups = rows.groupBy("run_id", "alignment_id", "origin", part.alias("_part")).agg(
            F.collect_list(F.struct("code", "a", "b", "c", "key")).alias("moves")
        )
        groups = groups.join(origin.select("run_id", "origin", "parent"), ["run_id", "origin"]).drop("_part")
        scored = score_moves(groups, blocks)
        # the frontier is what is new and not longer than anything before
        short = with_group_value(best_set(scored, group), best, group).where("length <= best").drop("best")
        frontier = materialise(moved(short.join(origin.select("run_id", "origin", "parent"), ["run_id", "origin"]).drop("origin")), "climb")
        seen = seen.unionByName(fresh.select(*ids))
        met = met.unionByName(frontier.select(*met.columns))
        best = met.groupBy(*group).agg(F.min("length").alias("best"))
    return best_set(met, group).select("run_id", "alignment_id", "key", "parent", "length")
