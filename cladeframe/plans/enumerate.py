"""Build trees by adding taxa one at a time.

A partial tree already has the full parent array; branches that do not exist
yet have parent -2. Taxon x enters together with inner branch n + x - 3, on one
of the 2x - 3 branches of the tree so far; 0 stands for the branch of the root
taxon itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.functions import sequences as S
from cladeframe.functions import trees as T

ABSENT = -2


def first_three(n: int) -> Column:
    """The only tree of taxa 0, 1, 2, with room for n."""
    return F.array(F.lit(-1), F.lit(0), F.lit(0), *[F.lit(ABSENT)] * (2 * n - 6))


def insertion_points(parent: Column) -> Column:
    """Branches a further taxon can go to."""
    return F.filter(F.sequence(F.lit(0), F.size(parent) - 1), lambda b: T.at(parent, b) != ABSENT)


def insert(parent: Column, taxon: Column, dest: Column) -> Column:
    """Tree with ``taxon`` added on branch ``dest``."""
    inner = T.taxa(parent) + taxon - 3
    return F.transform(
        parent,
        lambda p, i: F.when(i == taxon, F.when(dest == 0, F.lit(0)).otherwise(inner))
        .when(i == inner, F.when(dest == 0, F.lit(0)).otherwise(T.at(parent, dest)))
        .when((dest == 0) & (p == 0), inner)
        .when((dest != 0) & (i == dest), inner)
        .otherwise(p)
        .cast("int"),
    )


def extend(trees: DataFrame, taxon: Column) -> DataFrame:
    """Every tree with one more taxon, in every place."""
    keep = [c for c in trees.columns if c != "parent"]
    grown = trees.withColumn("_dest", F.explode(insertion_points(F.col("parent"))))
    return grown.withColumn("parent", insert(F.col("parent"), taxon, F.col("_dest"))).select(*keep, "parent")


def enumerate_topologies(sets: DataFrame, n: int) -> DataFrame:
    """All (2n-5)!! unrooted trees of n taxa for each row of ``sets``; meant for n up to 9.

    Pure explodes: rows stay on the partition they start on, spread first
    because the number of rows grows so much.
    """
    if not 3 <= n <= 9:
        raise ValueError("enumeration is for 3 to 9 taxa")
    trees = sets.withColumn("parent", first_three(n))
    for taxon in range(3, n):
        trees = extend(trees, F.lit(taxon))
    return trees


def random_trees(runs: DataFrame, seed: int) -> DataFrame:
    """A random start tree for each row of ``runs(run_id, n, ...)``, rooted at taxon 0.

    Taxa enter in a random order (labels are drawn, then each takes a random
    place), all from draws on (seed, run, step), so a run always gets the same tree.
    """
    def draw(step: Column) -> Column:
        return S.uniform_draw(seed, F.col("run_id"), step)

    sized = runs.withColumn(
        "_start",
        F.concat(F.array(F.lit(-1), F.lit(0), F.lit(0)), F.array_repeat(F.lit(ABSENT), (2 * F.col("n") - 6).cast("int"))),
    ).withColumn(
        "_labels",
        F.concat(
            F.array(F.lit(0)),
            F.transform(
                F.array_sort(
                    F.transform(
                        F.sequence(F.lit(1), F.col("n").cast("int") - 1),
                        lambda i: F.struct(draw(i + 1_000_000).alias("u"), i.alias("i")),
                    )
                ),
                lambda s: s["i"],
            ),
        ),
    )
    shaped = sized.withColumn(
        "_shape",
        F.aggregate(
            F.sequence(F.lit(3), F.col("n").cast("int") - 1),
            F.col("_start"),
            lambda tree, taxon: insert(
                tree,
                taxon,
                # branch number r of those present: 0..taxon-1, then inner ones from n on
                _present(F.floor(draw(taxon) * (2 * taxon - 3)).cast("int"), taxon, F.col("n").cast("int")),
            ),
        ),
    )
    # shape position -> taxon label; inner branches keep their number
    renamed = F.transform(
        F.array_sort(
            F.transform(
                F.col("_shape"),
                lambda p, i: F.struct(
                    F.when(i < F.col("n"), T.at(F.col("_labels"), i)).otherwise(i).alias("b"), p.alias("p")
                ),
            )
        ),
        lambda s: s["p"],
    )
    return shaped.withColumn("parent", renamed).drop("_start", "_labels", "_shape")


def _present(r: Column, taxon: Column, n: Column) -> Column:
    return F.when(r < taxon, r).otherwise(n + r - taxon)
