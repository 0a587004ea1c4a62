"""Fitch parsimony of tables of trees against tables of site patterns.

``trees(alignment_id, <ids>, parent)``, rooted at taxon 0, and
``patterns(alignment_id, pattern, weight)`` as made by ``sites.site_patterns``.

Trees become packs and patterns blocks of bounded size, first inside the tasks that have
them, then once more where an alignment's packs are small. Both are written to the
shared folder, so trees and patterns are worked out once, and a short table of the
packs and blocks of each alignment says how much work it is. Packs meet blocks on a grid
(alignment, part of its packs, part of its blocks): an alignment with much work has many
cells, on which the smaller side is repeated, so that one alignment keeps all tasks busy.
Only a tree's place in its pack and its numbers leave the task; sums are put to the trees
afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.functions import kernels as K
from cladeframe.functions import rearrange as R
from cladeframe.session import materialise

TREE_PACK = 32768  # integers of parent arrays in one pack
PATTERN_PACK = 32768  # pattern bytes in one block


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def packed(df: DataFrame, units: Column, budget: int, label: str) -> DataFrame:
    """Rows of an alignment in packs of about ``budget`` units: ``alignment_id, _units, _rows, _pack``, written to the shared folder.

    Tasks pack what they have. Packs that are full are dealt out by number, the others meet by alignment, where there are at most as many as tasks before.
    """
    rest = [c for c in df.columns if c != "alignment_id"]
    rows = df.select("alignment_id", units.cast("bigint").alias("_units"), F.struct(*rest).alias("_row"))
    schema = T.StructType(
        [df.schema["alignment_id"], T.StructField("_units", T.LongType()), T.StructField("_rows", T.ArrayType(rows.schema["_row"].dataType))]
    )
    # the same order each time, so that a task that is run again after a lost executor makes the same packs
    own = [F.col("_row")[f.name] for f in rows.schema["_row"].dataType.fields if not isinstance(f.dataType, T.MapType)]
    ordered = rows.sortWithinPartitions("alignment_id", F.xxhash64(*own))
    parts = ordered.mapInArrow(lambda b: K.pack_batches(b, "alignment_id", budget, False), schema)
    full = F.col("_units") >= budget // 2
    dealt = parts.withColumn("_deal", F.when(full, F.spark_partition_id() * F.lit(1 << 32) + F.monotonically_increasing_id() % (1 << 32)).otherwise(-1))
    met = dealt.repartition(_tasks(df), "alignment_id", "_deal").drop("_deal")
    packs = met.mapInArrow(lambda b: K.pack_batches(b, "alignment_id", budget, True), schema)
    return materialise(packs.withColumn("_pack", F.monotonically_increasing_id()), label)


def pattern_packs(patterns: DataFrame) -> DataFrame:
    """Patterns of an alignment in blocks: ``alignment_id, _block, _patterns, _weights``."""
    blocks = packed(patterns.select("alignment_id", "pattern", "weight"), F.length("pattern"), PATTERN_PACK, "blocks")
    return blocks.select(
        "alignment_id",
        F.col("_pack").alias("_block"),
        F.transform("_rows", lambda p: p["pattern"]).alias("_patterns"),
        F.transform("_rows", lambda p: p["weight"]).alias("_weights"),
    )


def _work(packs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Packs, blocks and pairs of each alignment."""
    a = packs.groupBy("alignment_id").agg(F.count(F.lit(1)).alias("_packs"))
    b = blocks.groupBy("alignment_id").agg(F.count(F.lit(1)).alias("_blocks"))
    return a.join(b, "alignment_id").withColumn("_pairs", F.col("_packs") * F.col("_blocks"))


def grid(packs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every pack with every block of its alignment, dealt over the session's number of shuffle partitions.

    An alignment with more than its share of all pairs (a quarter of a task's) is put on several cells, about one for each share. There are
    at most four such alignments a task, so their table is sent to all tasks.
    """
    tasks = _tasks(packs)
    work = _work(packs, blocks)
    total, most = work.agg(F.sum("_pairs"), F.max("_pairs")).first()
    share = max(1, (total or 0) // (4 * tasks))
    one = F.lit(1).cast("bigint")
    if (most or 0) > share:
        cells = F.ceil(F.col("_pairs") / share)
        across = F.least(F.col("_packs"), cells)
        shape = work.where(F.col("_pairs") > share).select(
            "alignment_id", across.alias("_s"), F.least(F.col("_blocks"), F.ceil(cells / across)).alias("_r")
        )
        shape = F.broadcast(shape)
        packs, blocks = (
            df.join(shape, "alignment_id", "left").withColumns({"_s": F.coalesce("_s", one), "_r": F.coalesce("_r", one)}) for df in (packs, blocks)
        )
    else:
        packs, blocks = (df.withColumns({"_s": one, "_r": one}) for df in (packs, blocks))
    left = packs.withColumns(
        {"_x": F.pmod(F.xxhash64("_pack"), F.col("_s")), "_y": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_r") - 1))}
    )
    right = blocks.withColumns(
        {"_y": F.pmod(F.xxhash64("_block"), F.col("_r")), "_x": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_s") - 1))}
    )
    cell = ["alignment_id", "_x", "_y"]
    # an explicit number of partitions is not put together again by bytes: few bytes are much work here
    return left.drop("_s", "_r").repartition(tasks, *cell).join(right.drop("_s", "_r").repartition(tasks, *cell), cell)


def tree_packs(trees: DataFrame) -> DataFrame:
    """Trees of an alignment in packs: ``alignment_id, _pack, _rows`` (all other columns)."""
    return packed(trees, F.size("parent"), TREE_PACK, "packs").drop("_units")


def _measured(
    packs: DataFrame, blocks: DataFrame, measure, ids: list[str] = (), keep_patterns: bool = False, moves: bool = False
) -> DataFrame:
    """One row per tree, block and slice: ``alignment_id, _pack, _at`` (place of the tree), ``_ids, _patterns, _weights, v``.

    With ``moves`` a pack holds trees with moves of each, and the task makes the trees it measures.
    """
    own = F.transform("_rows", lambda r: F.struct(r["parent"].alias("parent"), F.transform(
        r["moves"], lambda m: F.struct(*[m[c].alias(c) for c in ("code", "a", "b", "c")])).alias("moves"))) if moves else F.transform(
        "_rows", lambda r: r["parent"])
    lean = packs.select(
        "alignment_id", "_pack", own.alias("_parents"),
        F.transform("_rows", lambda r: F.struct(*[r[c].alias(c) for c in ids], F.lit(0).alias("_none"))).alias("_ids"),
    )
    if not ids:
        lean = lean.withColumn("_ids", F.array().cast(lean.schema["_ids"].dataType))
    pairs = grid(lean, blocks)
    pairs = pairs.select(
        "alignment_id", "_pack", "_ids", "_parents", F.array_join("_patterns", "").cast("binary").alias("_bytes"),
        (F.col("_patterns") if keep_patterns else F.array().cast("array<string>")).alias("_patterns"), "_weights",
    )
    passed = ["alignment_id", "_pack", "_ids", *(["_patterns", "_weights"] if keep_patterns else [])]
    schema = T.StructType(
        [
            *[pairs.schema[c] for c in passed],
            T.StructField("_first", T.IntegerType()),
            T.StructField("_values", T.ArrayType(T.ArrayType(T.LongType()))),
        ]
    )
    out = pairs.mapInArrow(K.scoring_batches(measure, passed, R.grouped_parents if moves else K.listed_parents), schema)
    return out.select(*passed, "_first", F.posexplode("_values").alias("_i", "v")).withColumn("_at", F.col("_first") + F.col("_i")).drop("_first", "_i")


def _named(rows: DataFrame, ids: list[str]) -> DataFrame:
    """Put the ids of its tree to each row."""
    own = F.get("_ids", F.col("_at"))
    return rows.withColumns({c: own[c] for c in ids}).drop("_ids", "_at", "_pack")


def tree_length(trees: DataFrame, patterns: DataFrame, ids: list[str]) -> DataFrame:
    """Add ``length``: changes over all sites. ``ids`` name a tree inside its alignment.

    Partial trees (branches with parent -2) are scored over the taxa they have;
    all partial trees of one alignment must have the same taxa. Trees and lengths are written to the shared folder: nothing is scored
    again, however often the result is read. An alignment without patterns has nothing to change.
    """
    return score_packs(trees, pattern_packs(patterns))


def score_packs(trees: DataFrame, blocks: DataFrame) -> DataFrame:
    """``tree_length`` on patterns that are in blocks already, as searches do once per search."""
    packs = tree_packs(trees)
    parts = _measured(packs, blocks, K.lengths_of)
    sums = materialise(parts.groupBy("_pack", "_at").agg(F.sum(F.col("v")[0]).alias("length")), "lengths")
    rows = packs.select("alignment_id", "_pack", F.posexplode("_rows").alias("_at", "r"))
    scored = rows.join(sums, ["_pack", "_at"], "left")
    return scored.select(
        *[F.col("r")[c].alias(c) if c != "alignment_id" else F.col(c) for c in trees.columns], F.coalesce("length", F.lit(0).cast("bigint")).alias("length")
    )


def score_moves(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lengths of trees that are given as moves: ``groups(alignment_id, <ids>, parent, moves)``, ``moves`` being structs ``code, a, b, c, ...``.

    One row per move: ``alignment_id``, the ids, the fields of the move and ``length``. The new trees exist in the scoring task only; what is
    written is the old tree once for each group, the moves and the lengths.
    """
    ids = [c for c in groups.columns if c not in ("alignment_id", "parent", "moves")]
    packs = packed(groups, F.size("parent") * F.size("moves"), TREE_PACK, "moves").drop("_units")
    parts = _measured(packs, blocks, K.lengths_of, moves=True)
    sums = materialise(parts.groupBy("_pack", "_at").agg(F.sum(F.col("v")[0]).alias("length")), "lengths")
    flat = F.flatten(F.transform("_rows", lambda r: F.transform(r["moves"], lambda m: F.struct(*[r[c].alias(c) for c in ids], m.alias("m")))))
    rows = packs.select("alignment_id", "_pack", F.posexplode(flat).alias("_at", "r"))
    scored = rows.join(sums, ["_pack", "_at"], "left")
    return scored.select("alignment_id", *[F.col("r")[c].alias(c) for c in ids], "r.m.*", F.coalesce("length", F.lit(0).cast("bigint")).alias("length"))


def fitch_site_length(trees: DataFrame, patterns: DataFrame, ids: list[str]) -> DataFrame:
    """Changes of every pattern on every tree: ``pattern, weight, changes``."""
    rows = _named(_measured(tree_packs(trees), pattern_packs(patterns), K.site_changes_of, ids, keep_patterns=True), ids)
    return rows.select(
        "alignment_id",
        *ids,
        F.inline(F.arrays_zip(F.col("_patterns").alias("pattern"), F.col("_weights").alias("weight"), F.col("v").alias("changes"))),
    )


def branch_changes(trees: DataFrame, patterns: DataFrame, ids: list[str]) -> DataFrame:
    """Changes on every inner branch and the root, over all sites: ``branch, changes``."""
    rows = _named(_measured(tree_packs(trees), pattern_packs(patterns), K.branch_changes_of, ids), ids)
    parts = rows.select("alignment_id", *ids, F.posexplode("v").alias("branch", "c"))
    return parts.filter("c >= 0").groupBy("alignment_id", *ids, "branch").agg(F.sum("c").alias("changes"))


def ancestral_states(trees: DataFrame, patterns: DataFrame, ids: list[str]) -> DataFrame:
    """State set of every inner branch for every pattern: ``pattern, branch, state``."""
    rows = _named(_measured(tree_packs(trees), pattern_packs(patterns), K.inner_states_of, ids, keep_patterns=True), ids)
    cells = rows.select("alignment_id", *ids, "_patterns", F.posexplode("v").alias("at", "state"))
    width = F.size("_patterns")
    return cells.select(
        "alignment_id", *ids,
        F.get("_patterns", F.col("at") % width).alias("pattern"),
        (F.length(F.get("_patterns", F.lit(0))) + F.floor(F.col("at") / width)).cast("int").alias("branch"),
        "state",
    )


def consistency_index(lengths: DataFrame, minimum: DataFrame) -> DataFrame:
    """Add consistency index (least possible / actual changes) and homoplasy index, 2 decimals.

    An alignment without a minimum has no variable columns: its minimum is 0. Trees of length 0 have NULL indices.
    """
    ci = F.when(F.col("length") > 0, F.col("min_len") / F.col("length"))
    return lengths.join(minimum, "alignment_id", "left").fillna(0, ["min_len"]).withColumns(
        {"ci": F.round(ci, 2), "hi": F.round(1 - ci, 2)}
    )
