"""Sets of trees: identity, new trees, best trees, caps and picks.

``group`` names the columns of one set (a run or an alignment). No operator
gathers a set in one task: duplicates, minima and picks are plain aggregates
with map-side combining, and membership is a hash join on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.operators.groups import with_group_value
from cladeframe.operators.trees import with_topology_key


def topology_classes(trees: DataFrame, group: list[str], order: str) -> DataFrame:
    """Trees of the same topology put together: ``key, trees, first``."""
    return trees.groupBy(*group, "key").agg(F.count(F.lit(1)).alias("trees"), F.min(order).alias("first"))


def push_new(offered: DataFrame, known: DataFrame, group: list[str], order: str) -> DataFrame:
    """First offered tree of every topology that is not known yet."""
    rest = [c for c in offered.columns if c not in (*group, "key")]
    first = (
        offered.groupBy(*group, "key")
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
        .select(*group, "key", "_row.*")
    )
    return first.join(known.select(*group, "key").distinct(), [*group, "key"], "left_anti")


def best_set(scored: DataFrame, group: list[str]) -> DataFrame:
    """All trees of least ``length`` in their set.

    ``scored`` is read twice, once for its lengths only; ``scoring.tree_length`` has written them, so nothing is scored again.
    """
    least = scored.groupBy(*group).agg(F.min("length").alias("_least"))
    return with_group_value(scored, least, group).filter(F.col("length") == F.col("_least")).select(*scored.columns)


def count_best(scored: DataFrame, group: list[str]) -> DataFrame:
    """Least length and number of distinct topologies that reach it.

    Only the shortest trees get a key, unless ``scored`` has one.
    """
    best = best_set(scored, group)
    keyed = best if "key" in scored.columns else with_topology_key(best)
    per_topology = keyed.groupBy(*group, "key").agg(F.min("length").alias("length"))
    return per_topology.groupBy(*group).agg(F.min("length").alias("length"), F.count(F.lit(1)).alias("topologies"))


def cap_trees(trees: DataFrame, group: list[str], order: str, limit: int, bucket: int = 4096) -> DataFrame:
    """The first ``limit`` trees of every set; 0 keeps them all.

    A set is first cut down inside buckets of its rows, then as a whole, so no
    task sorts a large set alone.
    """
    if limit == 0:
        return trees
    part = F.pmod(F.xxhash64(F.col(order)), F.lit(bucket))
    local = Window.partitionBy(*group, "_part").orderBy(order)
    whole = Window.partitionBy(*group).orderBy(order)
    return (
        trees.withColumn("_part", part)
        .withColumn("_rn", F.row_number().over(local))
        .filter(F.col("_rn") <= limit)
        .withColumn("_rn", F.row_number().over(whole))
        .filter(F.col("_rn") <= limit)
        .drop("_part", "_rn")
    )


def latest(trees: DataFrame, group: list[str], order: str) -> DataFrame:
    """The tree pushed last."""
    rest = [c for c in trees.columns if c not in group]
    return trees.groupBy(*group).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(*group, "_row.*")


def one_random(trees: DataFrame, group: list[str], draw: Column) -> DataFrame:
    """One member of every set, the one with the least draw."""
    rest = [c for c in trees.columns if c not in group]
    return trees.groupBy(*group).agg(F.min_by(F.struct(*rest), draw).alias("_row")).select(*group, "_row.*")
