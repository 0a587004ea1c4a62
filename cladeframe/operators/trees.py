"""Operators over tables of trees (``parent ARRAY<INT>``, see ``functions.trees``).

Every tree is one row and is worked on inside that row, so these operators
never shuffle; tables in long form come from a final explode. Intermediate
arrays are columns of their own (prefix ``_``) because lambdas would otherwise
evaluate them once per element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.functions import trees as T
from cladeframe.functions.binding import pinned
from cladeframe.functions.rearrange import split_keys


def with_merges(trees: DataFrame, parent: str = "parent", name: str = "_plan") -> DataFrame:
    """Add the upward merge plan of each tree."""
    kids, order = f"{name}_kids", f"{name}_order"
    return (
        trees.withColumn(kids, T.child_list(F.col(parent)))
        .withColumn(order, T.upward_order(F.col(parent), F.col(kids)))
        .withColumn(name, pinned(T.merges(F.col(kids), F.col(order))))
        .drop(kids, order)
    )


def with_clades(trees: DataFrame, parent: str = "parent", name: str = "clades") -> DataFrame:
    """Add the clades of each tree as ``ARRAY<STRUCT<branch, size, members>>``."""
    return (
        with_merges(trees, parent)
        .withColumn("_members", T.slot_members(F.col("_plan")))
        .withColumn(name, pinned(T.clades(F.col("_plan"), F.col("_members"))))
        .drop("_plan", "_members")
    )


def with_topology_key(
    trees: DataFrame, parent: str = "parent", name: str = "key", algorithm: str = "splits"
) -> DataFrame:
    """Add the key that two trees on the same taxa share exactly when they have the same splits.

    ``splits`` is a 128-bit sum of hashed splits, linear in the size of the tree; ``md5`` and ``sha2`` are digests of the
    canonical text of all clades, which other engines can work out as well. Trees must be rooted at taxon 0; see ``reroot`` for others.
    """
    if algorithm == "splits":
        return trees.withColumn(name, F.arrow_udf(split_keys, "string")(F.col(parent)))
    text = T.canonical_text(F.col("_sorted"))
    digest = F.md5(text) if algorithm == "md5" else F.sha2(text, 256)
    return (
        with_clades(trees, parent, "_clades")
        .withColumn("_sorted", T.sorted_clades(F.col("_clades")))
        .withColumn(name, pinned(digest))
        .drop("_clades", "_sorted")
    )


def with_newick(trees: DataFrame, names: Column, parent: str = "parent", name: str = "newick") -> DataFrame:
    """Add the bracketed unrooted text; ``names`` is an array of taxon names, trailing blanks cut."""
    return (
        with_merges(trees, parent)
        .withColumn("_labels", F.transform(names, lambda s: F.rtrim(s)))
        .withColumn(
            "_text",
            T.upward_fold(
                F.col("_plan"),
                F.col("_labels"),
                lambda a, b: F.concat(F.lit("("), a, F.lit(","), b, F.lit(")")),
            ),
        )
        .withColumn(name, pinned(T.bracketed(F.col("_plan"), F.col("_text"))))
        .drop("_plan", "_labels", "_text")
    )


def reroot(trees: DataFrame, new_root: Column, parent: str = "parent") -> DataFrame:
    """The same unrooted trees with another taxon as root."""
    tree = F.col(parent)
    return (
        trees.withColumn("_path", T.root_path(tree, new_root))
        .withColumn("_edits", T.reroot_edits(tree, F.col("_path")))
        .withColumn(parent, pinned(F.when(F.size("_path") == 1, tree).otherwise(T.rewire(tree, F.col("_edits")))))
        .drop("_path", "_edits")
    )


def branch_table(trees: DataFrame, keep: list[str]) -> DataFrame:
    """Trees in long form: ``branch, parent, left, right`` (-1 where there is none)."""
    t = trees.withColumn("_kids", T.child_list(F.col("parent"))).withColumn("_n", T.taxa(F.col("parent")))
    rows = t.select(*keep, "_kids", "_n", F.posexplode("parent").alias("branch", "parent"))
    has_children = (F.col("branch") >= F.col("_n")) | (F.col("parent") < 0)
    start = T.child_offset(F.col("branch"), F.col("_n"))
    return rows.select(
        *keep,
        "branch",
        "parent",
        F.when(has_children, T.at(F.col("_kids"), start)).otherwise(-1).alias("left"),
        F.when(has_children, T.at(F.col("_kids"), start + 1)).otherwise(-1).alias("right"),
    )


def sisters(trees: DataFrame, keep: list[str]) -> DataFrame:
    """``branch, sister`` of every branch but the root."""
    rows = trees.select(*keep, F.col("parent").alias("_p"), F.posexplode("parent").alias("branch", "_up"))
    return rows.filter("_up >= 0").select(*keep, "branch", T.sister(F.col("_p"), F.col("branch")).alias("sister"))


def descendants(trees: DataFrame, keep: list[str]) -> DataFrame:
    """All pairs ``ancestor, descendant, depth`` with depth at least 1."""
    rows = trees.select(*keep, F.col("parent").alias("_p"), F.posexplode("parent").alias("descendant", "_up"))
    paths = rows.select(
        *keep, "descendant", F.posexplode(T.root_path(F.col("_p"), F.col("descendant"))).alias("depth", "ancestor")
    )
    return paths.filter("depth > 0").select(*keep, "ancestor", "descendant", "depth")


def clade_sets(trees: DataFrame, keep: list[str]) -> DataFrame:
    """Sorted taxa below every inner branch: ``branch, size, members``."""
    return with_clades(trees).select(*keep, F.inline("clades"))


def clade_sizes(trees: DataFrame, keep: list[str]) -> DataFrame:
    """Number of taxa below every branch but the root; a taxon counts itself."""
    sized = (
        with_merges(trees)
        .withColumn("_ones", F.transform(F.sequence(F.lit(0), F.size("_plan") + 1), lambda i: F.lit(1)))
        .withColumn("_sizes", T.upward_fold(F.col("_plan"), F.col("_ones"), lambda a, b: a + b))
        .withColumn(
            "_branches",
            F.concat(
                F.sequence(F.lit(0), F.size("_plan") + 1),
                F.transform(F.slice("_plan", F.lit(1), F.size("_plan") - 1), lambda m: m["node"]),
            ),
        )
        .withColumn("_root", T.root_of(F.col("parent")))
    )
    return (
        sized.select(*keep, "_root", F.inline(F.arrays_zip(F.col("_branches").alias("branch"), F.col("_sizes").alias("size"))))
        .filter("branch <> _root")
        .drop("_root")
    )
