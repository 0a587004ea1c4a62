"""Kernels of rearrangements and split keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.functions import rearrange as R
from cladeframe.operators import moves, trees
from cladeframe.plans import enumerate as enum


def random_parents(n, count, seed):
    """Random trees rooted at taxon 0 by adding taxa."""
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        parent = np.full(2 * n - 3, -2)
        parent[:3] = -1, 0, 0
        for taxon in range(3, n):
            there = np.flatnonzero(parent >= 0)
            dest, inner = int(draw.choice(there)), n + taxon - 3
            parent[inner], parent[dest], parent[taxon] = parent[dest], inner, inner
        out.append(parent.tolist())
    return out


@pytest.mark.parametrize("n", [4, 8, 13])
def test_moves_equal_edits_of_the_tree(spark, n):
    """The kernel against expressions in the row of the tree."""
    df = spark.createDataFrame(list(enumerate(random_parents(n, 5, n))), "tree_id int, parent array<int>")
    for edits, whole in ((moves.nni_edits, moves.nni_neighbours), (moves.spr_edits, moves.spr_neighbours)):
        want = moves._applied(edits(df, ["tree_id"]))
        got = whole(df, ["tree_id"]).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_ranges_of_one_tree_give_the_same_rows(spark, monkeypatch):
    df = spark.createDataFrame([(7, random_parents(30, 1, 3)[0])], "tree_id int, parent array<int>")
    calls = {
        "nni": lambda: moves.nni_neighbours(df, ["tree_id"]), "spr": lambda: moves.spr_neighbours(df, ["tree_id"], full=True),
        "tbr": lambda: moves.tbr_neighbours(df, ["tree_id"]), "moves": lambda: moves.spr_moves(df, ["tree_id"]),
    }
    want = {k: sorted(map(str, c().collect())) for k, c in calls.items()}
    monkeypatch.setattr(R, "CELLS", 57 * 57 * 2)  # two moved branches a range
    monkeypatch.setattr(R, "OUT_CELLS", 600)
    assert {k: sorted(map(str, c().collect())) for k, c in calls.items()} == want


def test_one_large_tree_is_many_tasks(spark):
    n = 400
    df = spark.createDataFrame([(1, random_parents(n, 1, 1)[0])], "tree_id int, parent array<int>")
    found = moves.spr_moves(df, ["tree_id"]).groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("c")).collect()
    assert len(found) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    parent = np.array(random_parents(n, 1, 1))
    assert sum(r.c for r in found) == int(R.graft_points(R.Trees(parent), 0, 2 * n - 3).sum())


def test_split_keys_agree_with_the_clades(spark):
    every = enum.enumerate_topologies(spark.range(1), 8)
    both = trees.with_topology_key(trees.with_topology_key(every), name="text", algorithm="sha2").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"), F.count_distinct("text").alias("texts"),
        F.count_distinct("key", "text").alias("both"),
    ).first()
    assert (both.n, both.keys, both.texts, both.both) == (10395, 10395, 10395, 10395)


def test_split_keys_do_not_see_numbers_of_inner_branches(spark):
    tree = random_parents(9, 1, 2)[0]
    new = list(range(9)) + [9 + (i * 2) % 5 if i < 5 else 9 + i for i in range(6)]
    other = [0] * 15
    for b, p in enumerate(tree):
        other[new[b]] = p if p < 9 else new[p]
    df = spark.createDataFrame([(tree,), (other,), (random_parents(9, 1, 5)[0],)], "parent array<int>")
    keys = [r.key for r in trees.with_topology_key(df).collect()]
    texts = [r.key for r in trees.with_topology_key(df, algorithm="md5").collect()]
    assert keys[0] == keys[1] != keys[2] and texts[0] == texts[1] != texts[2]


@pytest.mark.parametrize("n", [4, 5, 9, 14])
def test_numbers_of_moves_are_their_places_in_the_list(n):
    """Every number of every kind, against the lists of all moves."""
    listed = (R.interchanges, R.regrafts, R.turned_regrafts)
    for parent in random_parents(n, 3, n):
        tree = R.Trees(np.array([parent]))
        for kind, moves_of in enumerate(listed):
            ((code, _, a, b, c),) = moves_of(tree, 0, 2 * n - 3)
            want = sorted(zip(a.tolist(), b.tolist(), c.tolist()), key=lambda x: (x[0], x[2], x[1]) if kind == 2 else x)
            u = (np.arange(len(a)) + 0.5)[None, :] / max(1, len(a))
            found, there = R.drawn(tree, kind, u)
            assert there.all() and (found[0, :, 0] == code).all()
            # interchanges and plain regrafts use their first two numbers only
            width = 3 if kind == 2 else 2
            assert [tuple(x[:width]) for x in found[0, :, 1:].tolist()] == [x[:width] for x in want]
