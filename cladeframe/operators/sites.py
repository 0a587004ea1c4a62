"""Aggregations over alignment columns.

Input is ``sequences(alignment_id, taxon_id, name, seq)`` with upper-case text.
Everything about a column follows from which characters occur in it, so all
operators start from one small shuffle: a bit mask of characters per column,
combined over all rows of an Arrow batch, then over the partition, before it
moves. Sequences are never taken apart into cells for a shuffle; where columns
are needed as a whole, blocks of text move instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.functions import sequences as S
from cladeframe.functions.kernels import cut_batches, cut_whole_batches, mask_batches, merged_masks, pattern_batches, piece_batches
from cladeframe.operators.groups import with_group_value
from cladeframe.session import materialise

PIECE = 4096  # sites of one piece of a long sequence
BLOCK = 1 << 20  # characters of one block of columns
WHOLE = 1 << 23  # bytes of an alignment that meets in one task
TOGETHER = 1 << 20  # bytes of small alignments worked on at once


def explode_sites(sequences: DataFrame) -> DataFrame:
    """One row per cell: ``alignment_id, taxon_id, site, base, state``."""
    pairs = F.arrays_zip(F.split("seq", "").alias("base"), F.split(S.hex_states(F.col("seq")), "").alias("digit"))
    cells = sequences.select("alignment_id", "taxon_id", F.posexplode_outer(pairs).alias("site", "c"))
    return cells.select(
        "alignment_id", "taxon_id", "site", F.col("c")["base"].alias("base"), S.digit_state(F.col("c")["digit"]).alias("state")
    )


def _pieces(sequences: DataFrame, width: Column, keep: list[str]) -> DataFrame:
    """Sequences cut every ``width`` sites: ``keep``, ``first`` (site) and ``piece``; most are one piece."""
    rows = sequences.select(*keep, "seq", width.cast("int").alias("_w"))
    fields = [sequences.schema[c] for c in keep] + [T.StructField("first", T.IntegerType()), T.StructField("piece", T.StringType())]
    return rows.mapInArrow(lambda batches: piece_batches(batches, keep), T.StructType(fields))


def site_blocks(sequences: DataFrame) -> DataFrame:
    """Masks of ``PIECE`` columns at a time: ``alignment_id, first, masks``, one row per block, however long the alignment."""
    accepted, width = S.ACCEPTED, PIECE
    schema = "alignment_id string, first int, masks array<int>"
    partial = sequences.select("alignment_id", "seq").mapInArrow(lambda batches: mask_batches(batches, accepted, width), schema)
    tasks = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = partial.repartition(tasks, "alignment_id", "first").sortWithinPartitions("alignment_id", "first")
    return dealt.mapInArrow(merged_masks, schema)


def site_masks(sequences: DataFrame) -> DataFrame:
    """``alignment_id, site, mask``: one bit per character that occurs in the column."""
    cells = site_blocks(sequences).select("alignment_id", "first", F.posexplode("masks").alias("i", "mask"))
    return cells.select("alignment_id", (F.col("first") + F.col("i")).alias("site"), "mask")


def site_states(sequences: DataFrame) -> DataFrame:
    """Distinct informative characters per column: ``n_states`` (at most 5) and ``states``.

    Columns with more than five have a NULL list.
    """
    informative = F.col("mask").bitwiseAND(F.lit(S.INFORMATIVE_MASK))
    k = F.bit_count(informative)
    return site_masks(sequences).select(
        "alignment_id",
        "site",
        F.least(k, F.lit(S.MAX_STATES)).alias("n_states"),
        F.when(k <= S.MAX_STATES, S.mask_letters(informative)).alias("states"),
    )


def variable_sites(sequences: DataFrame) -> DataFrame:
    """Columns with more than one raw character; a gap or ``N`` counts as a character here."""
    return site_masks(sequences).filter(F.bit_count("mask") > 1).select("alignment_id", "site")


def kept_columns(sequences: DataFrame) -> DataFrame:
    """One row per block of columns: ``keep`` (a flag per column), ``cut_before`` (columns cut in earlier blocks), ``original_m`` and ``m``.

    An alignment of any length is rows of at most ``PIECE`` flags; sums over its blocks are over one short row each.
    """
    flags = site_blocks(sequences).select("alignment_id", "first", F.transform("masks", lambda m: F.bit_count(m) > 1).alias("keep"))
    counted = flags.withColumns({"_c": F.size("keep"), "_k": F.size(F.filter("keep", lambda k: k))})
    whole = Window.partitionBy("alignment_id")
    before = whole.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(
        "alignment_id", "first", "keep",
        F.coalesce(F.sum(F.col("_c") - F.col("_k")).over(before), F.lit(0)).alias("cut_before"),
        F.sum("_c").over(whole).cast("int").alias("original_m"),
        F.sum("_k").over(whole).cast("int").alias("m"),
    )


def cut_constant_sites(sequences: DataFrame) -> DataFrame:
    """Sequences without their constant columns, with ``original_m`` and ``m``.

    ``alignment_id, taxon_id, name`` name a row. An alignment of at most ``WHOLE`` bytes and of rows of one piece meets in one task, which
    finds its columns and cuts them. Of larger ones, pieces meet the flags of their block and are put together again afterwards.
    """
    length = F.coalesce(F.octet_length("seq"), F.lit(0))
    size = sequences.groupBy("alignment_id").agg(F.sum(length + 1).alias("_s"), F.max(length).alias("_l"))
    large = materialise(size.where((F.col("_s") > WHOLE) | (F.col("_l") > PIECE)).select("alignment_id"), "large")
    some = not large.isEmpty()
    schema = T.StructType([
        *[sequences.schema[c] for c in ("alignment_id", "taxon_id", "name")], T.StructField("seq", T.StringType()),
        T.StructField("original_m", T.IntegerType()), T.StructField("m", T.IntegerType()),
    ])
    named = F.coalesce("alignment_id", F.raise_error(F.lit("a sequence without an alignment_id")).cast("string"))
    small = sequences.select(named.alias("alignment_id"), "taxon_id", "name", "seq")
    if some:
        small = small.join(large, "alignment_id", "left_anti")
    accepted, together = S.ACCEPTED, TOGETHER
    met = small.repartition("alignment_id").sortWithinPartitions("alignment_id", "taxon_id", "name")
    whole = met.mapInArrow(lambda batches: cut_whole_batches(batches, accepted, together), schema)
    return whole.unionByName(_cut_pieces(sequences.join(large, "alignment_id", "left_semi"))) if some else whole


def _cut_pieces(sequences: DataFrame) -> DataFrame:
    """``cut_constant_sites`` of alignments of any size, by blocks of columns."""
    # the name travels with the first piece only
    rows = _pieces(sequences, F.lit(PIECE), ["alignment_id", "taxon_id", "name"])
    rows = rows.join(kept_columns(sequences).drop("cut_before"), ["alignment_id", "first"])
    passed = ["alignment_id", "taxon_id", "name", "first", "original_m", "m"]
    cut = rows.mapInArrow(lambda batches: cut_batches(batches, passed), T.StructType([*[rows.schema[c] for c in passed], rows.schema["piece"]]))
    whole = cut.groupBy("alignment_id", "taxon_id", "name").agg(
        F.array_sort(F.collect_list(F.struct("first", "piece"))).alias("p"), F.max("original_m").alias("original_m"), F.max("m").alias("m")
    )
    missing = F.get("p", F.lit(0))["piece"].isNull()
    seq = F.when(~missing, F.array_join(F.transform("p", lambda x: x["piece"]), ""))
    return whole.select("alignment_id", "taxon_id", "name", seq.alias("seq"), "original_m", "m")


def excluded_sites(sequences: DataFrame, per_line: int = 8) -> DataFrame:
    """1-based numbers of the cut columns, eight to a line: ``line, columns, n_excluded``.

    A column's line follows from its place among the cut ones: those of earlier blocks and those before it in its own.
    """
    blocks = kept_columns(sequences).withColumn("n_excluded", F.col("original_m") - F.col("m"))
    here = F.filter(F.transform("keep", lambda k, i: F.when(~k, F.col("first") + i + 1)), lambda i: i.isNotNull())
    cut = blocks.select("alignment_id", "n_excluded", "cut_before", F.posexplode(here).alias("i", "site"))
    line = F.floor((F.col("cut_before") + F.col("i")) / per_line).cast("int")
    lines = cut.groupBy("alignment_id", line.alias("line")).agg(
        F.array_sort(F.collect_list("site")).alias("sites"), F.max("n_excluded").alias("n_excluded")
    )
    return lines.select("alignment_id", "line", F.array_join(F.col("sites").cast("array<string>"), "\t").alias("columns"), "n_excluded")


def minimum_tree_length(sequences: DataFrame) -> DataFrame:
    """Least number of changes any tree needs: sum over variable columns of states - 1.

    Distinct characters other than ``- ? N X`` are counted: ``U`` and ``T`` and
    ambiguity codes count as states of their own, more than five states add 5,
    and a variable column of missing characters only adds -1. The result may
    exceed the length of a real tree.
    """
    variable = site_masks(sequences).filter(F.bit_count("mask") > 1)
    k = F.bit_count(F.col("mask").bitwiseAND(F.lit(S.INFORMATIVE_MASK)))
    least = F.when(k > S.MAX_STATES, S.MAX_STATES).otherwise(k - 1)
    return variable.groupBy("alignment_id").agg(F.sum(least).cast("bigint").alias("min_len"))


def alignment_dims(sequences: DataFrame) -> DataFrame:
    """Taxa, columns and longest name per alignment."""
    return sequences.groupBy("alignment_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.length("seq")).alias("m"),
        F.max(F.length("name")).alias("max_name"),
    )


def alignment_shape(dims: DataFrame) -> DataFrame:
    """Sizes that follow from n and m: branches, clade sets, largest clade, words of 16 sites."""
    return (
        dims.withColumn("n_branches", 2 * F.col("n") - 3)
        .withColumn("n_sets", F.col("n") - 3)
        .withColumn("max_set", F.col("n") - 2)
        .withColumn("words", F.ceil(F.col("m") / 16).cast("bigint"))
    )


def site_patterns(sequences: DataFrame) -> DataFrame:
    """Identical columns collapsed: ``alignment_id, pattern, weight``.

    A pattern is one hex digit (the nucleotide set) per taxon in taxon order.
    Blocks of columns, as text and about ``BLOCK`` characters in all, are brought
    together by (alignment, block), turned inside the task and counted there
    before the counts of equal patterns are added up. Sequences of unequal length and
    characters without a nucleotide set are errors; ``validate.gate`` sorts them out.
    """
    dims = sequences.groupBy("alignment_id").agg(F.count(F.lit(1)).alias("_n"))
    width = F.least(F.greatest(F.floor(F.lit(BLOCK) / F.col("_n")), F.lit(1)), F.lit(PIECE))
    coded = sequences.select("alignment_id", "taxon_id", S.hex_states(F.col("seq")).alias("seq"))
    pieces = _pieces(with_group_value(coded, dims, ["alignment_id"]), width, ["alignment_id", "taxon_id", "_n"])
    blocks = pieces.groupBy("alignment_id", "first").agg(
        F.array_sort(F.collect_list(F.struct("taxon_id", "piece"))).alias("_t"),
        F.max("_n").alias("_n"), F.min(F.length("piece")).alias("_lo"), F.max(F.length("piece")).alias("_hi"),
    )
    even = (F.size("_t") == F.col("_n")) & (F.col("_lo") == F.col("_hi"))
    uneven = F.raise_error(F.concat(F.lit("alignment "), "alignment_id", F.lit(": sequences of unequal length")))
    joined = blocks.select(
        "alignment_id",
        F.size("_t").alias("n"),
        F.when(even, F.array_join(F.transform("_t", lambda t: t["piece"]), "")).otherwise(uneven).alias("block"),
    ).filter("block <> ''")
    counted = joined.mapInArrow(
        pattern_batches, "alignment_id string, patterns array<string>, weights array<bigint>"
    )
    rows = counted.select(
        "alignment_id", F.inline_outer(F.arrays_zip(F.col("patterns").alias("pattern"), F.col("weights").alias("w")))
    )
    return rows.groupBy("alignment_id", "pattern").agg(F.sum("w").alias("weight"))
