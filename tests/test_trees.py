from collections import Counter

import pytest
from pyspark.sql import functions as F

from cladeframe.operators import moves, scoring, topology, trees
from cladeframe.plans import enumerate as enum
from tests import helpers as H


@pytest.fixture(scope="module")
def some(spark):
    """Random trees of 5 to 9 taxa."""
    runs = spark.range(30).select(F.col("id").alias("run_id"), (F.col("id") % 5 + 5).cast("int").alias("n"))
    return enum.random_trees(runs, seed=5).cache()


def test_random_trees_are_trees(some):
    rows = some.collect()
    assert all(H.is_tree(r.parent) and len(r.parent) == 2 * r.n - 3 and r.parent[0] == -1 for r in rows)
    assert len({tuple(r.parent) for r in rows}) > 20


def test_random_trees_vary_and_repeat(spark):
    runs = spark.range(400).select(F.col("id").alias("run_id"), F.lit(5).alias("n"))
    once = {r.run_id: H.splits(r.parent) for r in enum.random_trees(runs, 1).collect()}
    again = {r.run_id: H.splits(r.parent) for r in enum.random_trees(runs.repartition(3), 1).collect()}
    assert once == again and len(set(once.values())) == 15


@pytest.mark.parametrize("n", [4, 5, 6, 7])
def test_enumeration_is_complete(spark, n):
    rows = enum.enumerate_topologies(spark.range(1), n).collect()
    assert all(H.is_tree(r.parent) for r in rows)
    assert len(rows) == len({H.splits(r.parent) for r in rows}) == H.double_factorial(2 * n - 5)


def test_keys_are_splits(some):
    keyed = trees.with_topology_key(some).collect()
    by_key, by_split = {}, {}
    for r in keyed:
        by_key.setdefault(r.key, set()).add((r.n, H.splits(r.parent)))
        by_split.setdefault((r.n, H.splits(r.parent)), set()).add(r.key)
    assert all(len(v) == 1 for v in by_key.values()) and all(len(v) == 1 for v in by_split.values())


def test_canonical_text(spark):
    df = spark.createDataFrame([([-1, 6, 6, 7, 8, 8, 0, 0, 7],)], "parent array<int>")
    from cladeframe.functions import trees as T
    got = trees.with_clades(df).withColumn("s", T.sorted_clades(F.col("clades"))).select(T.canonical_text(F.col("s"))).first()[0]
    assert got == "0    2    1   2   \n1    2    4   5   \n2    3    3   4   5   \n"


def test_reroot(some):
    moved = trees.reroot(some.withColumn("old", F.col("parent")), F.col("n") - 1)
    back = trees.reroot(moved.withColumn("turned", F.col("parent")), F.lit(0))
    for r in back.collect():
        assert H.is_tree(r.turned) and r.turned[r.n - 1] == -1
        assert H.splits(r.parent) == H.splits(r.old) == H.splits(r.turned)


def test_newick(spark):
    df = spark.createDataFrame([([-1, 0, 5, 6, 6, 0, 5],)], "parent array<int>")
    names = F.array(*[F.lit(x) for x in ("A ", "B", "C", "D", "E  ")])
    assert trees.with_newick(df, names).first().newick == "(A,B,(C,(D,E)));"


def neighbours_of(df, fn, **kw):
    out = fn(df, ["run_id", "n"], **kw)
    got = {}
    for r in out.collect():
        assert H.is_tree(r.parent)
        got.setdefault(r.run_id, []).append(H.splits(r.parent))
    return got


def test_neighbourhoods(some):
    start = {r.run_id: (r.n, H.splits(r.parent)) for r in some.collect()}
    nni = neighbours_of(some, moves.nni_neighbours)
    spr = neighbours_of(some, moves.spr_neighbours)
    full = neighbours_of(some, moves.spr_neighbours, full=True)
    tbr = neighbours_of(some, moves.tbr_neighbours)
    for run, (n, own) in start.items():
        assert len(nni[run]) == len(set(nni[run])) == 2 * (n - 3)
        assert own not in nni[run] and own not in spr[run]
        assert set(nni[run]) <= set(spr[run])
        # number of unrooted prune-and-regraft neighbours
        assert len(set(full[run]) - {own}) == 2 * (n - 3) * (2 * n - 7)
        assert set(tbr[run]) - {own}


def test_scores_match_brute_force(spark, some):
    letters = "ACGTRYKMN"
    texts = {r.run_id: ["".join(letters[(7 * i * i + 5 * j + i * j * r.run_id) % 9] for j in range(23)) for i in range(r.n)]
             for r in some.collect()}
    seqs = spark.createDataFrame(
        [(str(k), i, f"t{i}", s) for k, v in texts.items() for i, s in enumerate(v)],
        "alignment_id string, taxon_id int, name string, seq string",
    )
    from cladeframe.operators.sites import site_patterns
    patterns = site_patterns(seqs)
    named = some.withColumn("alignment_id", F.col("run_id").cast("string"))
    want = {r.run_id: H.fitch(r.parent, H.columns_of(texts[r.run_id])) for r in some.collect()}
    packs = scoring.tree_length(named, patterns, ["run_id"])
    assert {r.run_id: r.length for r in packs.collect()} == want
    folds = scoring.fitch_site_length(named, patterns, ["run_id"]).groupBy("run_id").agg(F.sum(F.expr("changes * weight")).alias("length"))
    assert {r.run_id: r.length for r in folds.collect()} == want
    turned = scoring.branch_changes(named, patterns, ["run_id"]).groupBy("run_id").agg(F.sum("changes").alias("length"))
    assert {r.run_id: r.length for r in turned.collect()} == want


def test_many_packs(spark, some, monkeypatch):
    """Several tree packs and pattern packs of one alignment add up."""
    monkeypatch.setattr(scoring, "TREE_PACK", 40)
    monkeypatch.setattr(scoring, "PATTERN_PACK", 30)
    every = enum.enumerate_topologies(spark.range(1).select(F.lit("x").alias("alignment_id")), 6)
    every = every.withColumn("tree_id", F.monotonically_increasing_id())
    seqs = ["ACGTACGTAAC", "ACGAACCTAGC", "TCGTACGTNNC", "TTGTGCGTA-C", "GTGTGCGAARC", "GTCTGCGAAYC"]
    from cladeframe.operators.sites import site_patterns
    rows = spark.createDataFrame(
        [("x", i, f"t{i}", s) for i, s in enumerate(seqs)], "alignment_id string, taxon_id int, name string, seq string"
    )
    every = every.cache()
    got = {tuple(r.parent): r.length for r in scoring.tree_length(every, site_patterns(rows), ["tree_id"]).collect()}
    assert len(got) == 105
    assert got == {p: H.fitch(list(p), H.columns_of(seqs)) for p in got}


def test_sets_of_trees(spark):
    rows = [(1, f"k{i % 7}", 10 + i % 7 // 3, i) for i in range(50)]
    df = spark.createDataFrame(rows, "run_id bigint, key string, length bigint, seq bigint")
    best = topology.count_best(df, ["run_id"]).first()
    assert (best.length, best.topologies) == (10, 3)
    assert topology.best_set(df, ["run_id"]).count() == sum(r[2] == 10 for r in rows)
    assert [r.seq for r in topology.cap_trees(df, ["run_id"], "seq", 5, bucket=3).orderBy("seq").collect()] == [0, 1, 2, 3, 4]
    assert topology.cap_trees(df, ["run_id"], "seq", 0).count() == 50
    known = df.filter("key IN ('k0', 'k1')")
    fresh = topology.push_new(df, known, ["run_id"], "seq").collect()
    assert Counter(r.key for r in fresh) == Counter(["k2", "k3", "k4", "k5", "k6"])
    assert all(r.seq == int(r.key[1]) for r in fresh)
