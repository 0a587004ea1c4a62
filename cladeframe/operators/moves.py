"""Tree rearrangements as tables: one row per neighbour of each tree.

Work is dealt out by tree and range of moved branches, so many small trees and one
large one both keep all cores busy; the shuffle moves the trees, not their neighbours.
Inside a task moves are array arithmetic on many trees at once (``functions.rearrange``).
Trees must be rooted at a taxon; ``keep`` names the columns that identify a tree.

``*_edits`` are the same moves by expressions in the row of the tree, without Python workers, for
small trees. Proposals need single moves only, which are worked out from their numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as types

from cladeframe.functions import rearrange as R
from cladeframe.functions import trees as T
from cladeframe.functions.binding import pinned
from cladeframe.operators.trees import with_merges
from cladeframe.session import spread


def _moved(trees: DataFrame, keep: list[str], kind: str, columns: list[str], result: str = "parent") -> DataFrame:
    """All moves of a kind: ``keep``, the ``columns`` that name the move and the ``result``."""
    size = F.size("parent")
    step = F.greatest(F.floor(F.lit(R.CELLS) / (size.cast("double") * size)), F.lit(1)).cast("int")
    ranges = trees.select(*keep, "parent", size.alias("_size"), step.alias("_step")).select(
        *keep, "parent", "_size", "_step", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_size") - 1, F.lit(0)), "_step")).alias("lo")
    )
    rows = ranges.select(*keep, "parent", "lo", F.least(F.col("lo") + F.col("_step"), F.col("_size")).alias("hi"))
    fields = [trees.schema[c] for c in keep] + [types.StructField(c, types.IntegerType()) for c in columns]
    fields += {
        "": [], "parent": [types.StructField("parent", types.ArrayType(types.IntegerType()))],
        "key": [types.StructField("code", types.IntegerType()), types.StructField("key", types.StringType())],
    }[result]
    return spread(rows, *keep, "lo").mapInArrow(R.move_batches(kind, keep, columns, result), types.StructType(fields))


def keyed_moves(trees: DataFrame, keep: list[str], kind: str) -> DataFrame:
    """All moves of a kind as ``code, a, b, c`` with the ``key`` of the tree they give; the trees themselves don't leave the task."""
    return _moved(trees, keep, kind, ["a", "b", "c"], "key")


def moved(rows: DataFrame) -> DataFrame:
    """Trees after one move each: ``parent`` is replaced, ``code, a, b, c`` go."""
    names = [c for c in rows.columns if c not in ("parent", "code", "a", "b", "c")]
    return rows.mapInArrow(lambda b: R.applied_batches(b, names), types.StructType([*[rows.schema[c] for c in names], rows.schema["parent"]]))


def _applied(moved: DataFrame) -> DataFrame:
    """Moves ``_old, _edits`` to neighbours: ``parent``."""
    return moved.withColumn("parent", pinned(T.rewire(F.col("_old"), F.col("_edits")))).drop("_old", "_edits")


def nni_edits(trees: DataFrame, keep: list[str]) -> DataFrame:
    """Nearest-neighbour interchanges ``branch, side``, with the tree as ``_old`` and ``_edits``."""
    tree = F.col("_old")
    rows = with_merges(trees).select(
        *keep, F.col("parent").alias("_old"), F.inline_outer(F.slice("_plan", F.lit(1), F.size("_plan") - 1)),
    ).withColumnRenamed("node", "branch")
    sides = rows.select(*keep, "_old", "branch", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    child = T.at(T.children(tree, F.col("branch")), F.col("side"))
    swap = F.array(
        T.edit(child, T.at(tree, F.col("branch"))), T.edit(T.sister(tree, F.col("branch")), F.col("branch"))
    )
    return sides.withColumn("_edits", swap)


def nni_neighbours(trees: DataFrame, keep: list[str]) -> DataFrame:
    """All nearest-neighbour interchanges: ``branch, side, parent``.

    Across each inner branch its left (side 0) or right (side 1) child changes
    places with its sister: 2(n-3) rows per tree.
    """
    return _moved(trees, keep, "nni", ["branch", "side"])


def _cut_points(trees: DataFrame, keep: list[str]) -> DataFrame:
    """Every subtree that may be moved: ``_old, _paths, src, up, sis``.

    ``up`` and ``sis`` are its parent and sister, ``_paths`` the way from every
    branch to the root. The root and its two children stay where they are.
    """
    tree = F.col("parent")
    ways = F.transform(F.sequence(F.lit(0), F.size(tree) - 1), lambda b: T.root_path(tree, b))
    rows = trees.withColumn("_paths", pinned(ways)).select(
        *keep, tree.alias("_old"), "_paths", F.posexplode_outer("parent").alias("src", "up")
    )
    movable = rows.filter((F.col("up") >= 0) & (F.col("up") != T.root_of(F.col("_old"))))
    return movable.withColumn("sis", T.sister(F.col("_old"), F.col("src")))


def spr_moves(trees: DataFrame, keep: list[str]) -> DataFrame:
    """Legal prune-and-regraft moves ``src, dest``.

    The destination is no branch of the moved subtree, nor the root, nor the
    parent or sister of the moved branch (which would give the same tree).
    """
    return _moved(trees, keep, "spr", ["src", "dest"], "")


def _graft_points(cut: DataFrame, columns: list[str]) -> DataFrame:
    """Every legal ``dest`` for each cut point."""
    outside = F.filter(
        F.sequence(F.lit(0), F.size("_old") - 1),
        lambda b: (T.at(F.col("_old"), b) >= 0)
        & (b != F.col("up"))
        & (b != F.col("sis"))
        & ~F.array_contains(T.at(F.col("_paths"), b), F.col("src")),
    )
    dests = cut.withColumn("_dests", outside)
    return dests.select(*columns, F.explode_outer("_dests").alias("dest")).filter("dest IS NOT NULL")


def _regraft(tree: Column) -> Column:
    """Edits of a move: close the gap, then split the destination branch."""
    return F.array(
        T.edit(F.col("sis"), T.at(tree, F.col("up"))),
        T.edit(F.col("up"), T.at(tree, F.col("dest"))),
        T.edit(F.col("dest"), F.col("up")),
    )


def spr_edits(trees: DataFrame, keep: list[str]) -> DataFrame:
    """Prune-and-regraft moves ``src, dest``, with the tree as ``_old`` and ``_edits``."""
    moved = _graft_points(_cut_points(trees, keep), [*keep, "_old", "_paths", "src", "up", "sis"])
    return moved.withColumn("_edits", _regraft(F.col("_old"))).select(*keep, "_old", "src", "dest", "_edits")


def spr_neighbours(trees: DataFrame, keep: list[str], full: bool = False) -> DataFrame:
    """Trees after every legal prune-and-regraft move: ``src, dest, parent``.

    Moves of subtrees away from the root miss part of the unrooted neighbourhood;
    ``full`` adds the rest: moves onto the root taxon's branch, of the root's children and of
    the part that holds the root. A topology may come up several times and should then be reduced by key.
    """
    return _moved(trees, keep, "spr_full" if full else "spr", ["src", "dest"])


def tbr_neighbours(trees: DataFrame, keep: list[str]) -> DataFrame:
    """Prune-and-regraft with the moved subtree turned around: ``src, dest, leaf, parent``.

    A moved subtree of more than two taxa is re-rooted at each of its taxa that
    is not a child of the moved branch (``leaf``); smaller ones move as they are
    (``leaf`` -1).
    """
    return _moved(trees, keep, "tbr", ["src", "dest", "leaf"])


def propose_moves(trees: DataFrame, keep: list[str], shares: DataFrame, k: int, draw: Callable[..., Column]) -> DataFrame:
    """``k`` proposals for each tree: ``slot, move`` (NNI, SPR or TBR), the numbers ``a, b, c`` of the move and the new ``parent``.

    ``shares(keep, p_nni, p_spr)`` has one row per tree; ``draw(columns...)`` gives a reproducible value in [0, 1). Slot j takes the kind its
    first draw falls on, ``draw(keep, j)``, and of that kind's moves the one whose number its second draw gives, ``draw(keep, k + j)``; numbers are in
    the order of (branch, side), (src, dest) and (src, leaf, dest), as ``a, b`` and for TBR ``a, c, b``. Moves are counted and not listed, so a proposal costs no more
    than its tree is wide. A slot whose kind the tree has no move of has NULL numbers and the tree unchanged.
    """
    ids = [F.col(c) for c in keep]
    joined = trees.select(*keep, "parent").join(shares.select(*keep, "p_nni", "p_spr"), keep)
    kinds, draws = [], []
    for j in range(k):
        u = draw(*ids, F.lit(j))
        kinds.append(F.when(u < F.col("p_nni"), 0).when(u < F.col("p_nni") + F.col("p_spr"), 1).otherwise(2))
        draws.append(draw(*ids, F.lit(k + j)))
    rows = joined.select(*keep, "parent", F.array(*kinds).alias("kinds"), F.array(*draws).alias("draws"))
    numbers = [types.StructField(c, types.IntegerType()) for c in ("slot", "kind", "a", "b", "c")]
    schema = types.StructType([*[rows.schema[c] for c in keep], *numbers, rows.schema["parent"]])
    picked = rows.mapInArrow(lambda b: R.draw_batches(b, keep), schema)
    names = F.array(F.lit("NNI"), F.lit("SPR"), F.lit("TBR"))
    return picked.select(*keep, "slot", F.get(names, F.col("kind")).alias("move"), "a", "b", "c", "parent")
