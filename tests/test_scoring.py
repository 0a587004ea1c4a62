"""The scoring grid: hot alignments, blocks and packs of any size."""

import pytest
from pyspark.sql import functions as F

from cladeframe.operators import scoring, sites, topology
from cladeframe.plans import enumerate as enum
from cladeframe.session import materialise
from tests import helpers as H

SEQS = ["ACGTACGTAACGGT", "ACGAACCTAGCTTA", "TCGTACGTNNCAGT", "TTGTGCGTA-CCCA", "GTGTGCGAARCGTA", "GTCTGCGAAYCTGT"]


@pytest.fixture(scope="module")
def patterns(spark):
    rows = [(a, i, f"t{i}", s) for a in ("hot", "cold") for i, s in enumerate(SEQS)]
    return sites.site_patterns(spark.createDataFrame(rows, "alignment_id string, taxon_id int, name string, seq string")).cache()


@pytest.fixture(scope="module")
def every(spark):
    """One alignment has nearly all trees, one few, one has trees but no patterns."""
    sets = spark.createDataFrame([("hot", i) for i in range(40)] + [("cold", 0), ("bare", 0)], "alignment_id string, copy int")
    trees = enum.enumerate_topologies(sets, 6).withColumn("tree_id", F.concat_ws("/", "copy", F.col("parent").cast("string")))
    return materialise(trees.select("alignment_id", "tree_id", "parent", F.lit("x").alias("extra")), "test-trees")


@pytest.fixture(params=[False, True])
def small(request, monkeypatch, spark):
    """Small packs and blocks, and no broadcast that wasn't asked for."""
    if request.param:
        monkeypatch.setattr(scoring, "TREE_PACK", 100)
        monkeypatch.setattr(scoring, "PATTERN_PACK", 20)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def want(r):
    return H.fitch(list(r.parent), H.columns_of(SEQS)) if r.alignment_id != "bare" else 0


def test_lengths(every, patterns, small):
    got = scoring.tree_length(every, patterns, ["tree_id"])
    assert got.columns == [*every.columns, "length"]
    rows = got.collect()
    assert len(rows) == 42 * 105 and len({(r.alignment_id, r.tree_id) for r in rows}) == 42 * 105
    known = {tuple(r.parent): want(r) for r in rows if r.alignment_id == "cold"}
    assert all(r.length == (known[tuple(r.parent)] if r.alignment_id != "bare" else 0) for r in rows)
    best = topology.best_set(got, ["alignment_id"]).collect()
    least = min(known.values())
    assert sum(r.alignment_id == "hot" for r in best) == 40 * sum(v == least for v in known.values())
    counts = {r.alignment_id: (r.length, r.topologies) for r in topology.count_best(got, ["alignment_id"]).collect()}
    assert counts == {"hot": (least, list(known.values()).count(least)), "cold": (least, list(known.values()).count(least)), "bare": (0, 105)}


def test_sites_and_branches_add_up(every, patterns, small):
    lengths = {(r.alignment_id, r.tree_id): r.length for r in scoring.tree_length(every, patterns, ["tree_id"]).collect() if r.alignment_id != "bare"}
    sums = scoring.fitch_site_length(every, patterns, ["tree_id"]).groupBy("alignment_id", "tree_id").agg(F.sum(F.expr("changes * weight")).alias("c"))
    assert {(r.alignment_id, r.tree_id): r.c for r in sums.collect()} == lengths
    sums = scoring.branch_changes(every, patterns, ["tree_id"]).groupBy("alignment_id", "tree_id").agg(F.sum("changes").alias("c"))
    assert {(r.alignment_id, r.tree_id): r.c for r in sums.collect()} == lengths
    states = scoring.ancestral_states(every, patterns, ["tree_id"])
    distinct = patterns.where("alignment_id = 'hot'").count()
    assert states.count() == len(lengths) * distinct * 3


def test_one_alignment_keeps_all_tasks_busy(spark, every, patterns, monkeypatch):
    monkeypatch.setattr(scoring, "TREE_PACK", 500)
    packs = scoring.tree_packs(every.where("alignment_id = 'hot'"))
    pairs = scoring.grid(packs, scoring.pattern_packs(patterns))
    tasks = [r.c for r in pairs.groupBy(F.spark_partition_id().alias("t")).agg(F.count(F.lit(1)).alias("c")).collect()]
    assert len(tasks) >= int(spark.conf.get("spark.sql.shuffle.partitions")) - 2
    assert max(tasks) < sum(tasks) / 2
    # packs are about full whatever task their trees came from
    assert packs.count() < 2 * 40 * 105 * 9 / 500
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "_x" in plan and "_y" in plan


def test_empty_tables(every, patterns):
    assert scoring.tree_length(every.limit(0), patterns, ["tree_id"]).count() == 0
    assert {r.length for r in scoring.tree_length(every, patterns.limit(0), ["tree_id"]).collect()} == {0}
