"""Rules that return violations as rows ``alignment_id, rule, detail``."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions import sequences as S
from cladeframe.operators import sites
from cladeframe.sources.paths import alignment_of

# Smallest and largest alignments, length of a PHYLIP name.
MIN_TAXA, MAX_TAXA = 5, 1_000_000
MIN_SITES, MAX_SITES = 1, 5_000_000
PHYLIP_NAME = 10

_ILLEGAL = "[^" + S.ACCEPTED.replace("-", "") + "-]"


def _found(df: DataFrame, rule: str, detail: Column) -> DataFrame:
    return df.select("alignment_id", F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def _broken(df: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """One row per row of ``df`` and rule that it breaks, in one pass."""
    found = [
        F.when(broken, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))
        for rule, broken, detail in rules
    ]
    rows = df.select("alignment_id", F.explode(F.filter(F.array(*found), lambda r: r.isNotNull())).alias("v"))
    return rows.select("alignment_id", "v.rule", "v.detail")


def row_rules(sequences: DataFrame) -> DataFrame:
    """Rows with a character outside the accepted alphabet (the first one), or with ``O``, which has no nucleotide set."""
    seq = F.col("seq")
    return _broken(
        sequences,
        [
            (
                "illegal_character", seq.rlike(_ILLEGAL),
                F.concat("name", F.lit(": "), F.regexp_extract(seq, _ILLEGAL, 0)),
            ),
            ("unencodable_base", seq.contains("O"), F.col("name")),
        ],
    )


def alignment_rules(sequences: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Rules on the sizes of an alignment, from one aggregate; ``headers(alignment_id, n, m)`` are what its file declares."""
    per = sequences.groupBy("alignment_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.length("seq") == 0, 1)).alias("empty"),
        F.min(F.length("seq")).alias("lo"), F.max(F.length("seq")).alias("hi"),
    )
    if headers is None:
        declared = per.withColumns({"header_n": F.lit(None).cast("bigint"), "header_m": F.lit(None).cast("bigint")})
    else:
        sizes = headers.select("alignment_id", F.col("n").alias("header_n"), F.col("m").alias("header_m"))
        declared = per.join(sizes, "alignment_id", "full")
    n, lo, hi = F.col("n"), F.col("lo"), F.col("hi")
    span = F.concat(lo.cast("string"), F.lit(".."), hi.cast("string"))
    return _broken(
        declared,
        [
            ("unequal_lengths", lo != hi, span),
            ("length_differs_from_header", (lo != F.col("header_m")) | (hi != F.col("header_m")), span),
            ("no_sequences", n.isNull(), F.lit("0")),
            ("fewer_than_two_sequences", n < 2, n),
            ("name_without_sequence", F.col("empty") > 0, F.col("empty")),
            (
                "count_differs_from_header", n != F.col("header_n"),
                F.concat(n.cast("string"), F.lit(" of "), F.col("header_n").cast("string")),
            ),
            ("taxa_out_of_range", ~n.between(MIN_TAXA, MAX_TAXA), n),
            ("sites_out_of_range", ~hi.between(MIN_SITES, MAX_SITES), hi),
        ],
    )


def alphabet(sequences: DataFrame) -> DataFrame:
    """Rows with a character outside the accepted alphabet, with the first one."""
    return row_rules(sequences).filter("rule = 'illegal_character'")


def unencodable(sequences: DataFrame) -> DataFrame:
    """Rows with ``O``: accepted as text but without a nucleotide set."""
    return row_rules(sequences).filter("rule = 'unencodable_base'")


def lengths(sequences: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Alignments whose sequences differ in length, or differ from the header's ``m``."""
    found = alignment_rules(sequences, headers)
    return found.filter(F.col("rule").isin("unequal_lengths", "length_differs_from_header"))


def counts(sequences: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Alignments with one sequence or none, without a sequence for a name, or not of the header's ``n``."""
    found = alignment_rules(sequences, headers)
    return found.filter(
        F.col("rule").isin(
            "no_sequences", "fewer_than_two_sequences", "name_without_sequence", "count_differs_from_header"
        )
    )


def short_name_lines(lines: DataFrame) -> DataFrame:
    """Name lines (``alignment_id, line, text``) too short to hold a PHYLIP name."""
    short = lines.filter(F.length("text") < PHYLIP_NAME)
    return _found(short, "short_name_line", F.col("line"))


def limits(sequences: DataFrame) -> DataFrame:
    """Alignments with too few or too many taxa or columns."""
    return alignment_rules(sequences).filter(F.col("rule").isin("taxa_out_of_range", "sites_out_of_range"))


def variable(sequences: DataFrame) -> DataFrame:
    """Alignments without any variable column."""
    ids = sequences.select("alignment_id").distinct()
    none = ids.join(sites.variable_sites(sequences), "alignment_id", "left_anti")
    return _found(none, "no_variable_sites", F.lit("0"))


def sources(spark: SparkSession, path: str, sequences: DataFrame) -> DataFrame:
    """Alignments with files below ``path`` from which no sequence, or no base, was read.

    A path without files raises Spark's own error. Only names and sizes of the
    files are looked at.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ids = files.select(alignment_of(F.col("path")).alias("alignment_id"), "length")
    ids = ids.groupBy("alignment_id").agg(F.sum("length").alias("bytes"))
    none = ids.join(sequences.filter("seq <> ''").select("alignment_id").distinct(), "alignment_id", "left_anti")
    return _found(none, "no_sequences", F.concat(F.col("bytes").cast("string"), F.lit(" bytes")))


def validate(
    sequences: DataFrame, headers: DataFrame | None = None, name_lines: DataFrame | None = None
) -> DataFrame:
    """All rules on parsed sequences, and on the lines a PHYLIP taxon starts on where they are given."""
    found = [row_rules(sequences), alignment_rules(sequences, headers), variable(sequences)]
    if name_lines is not None:
        found.append(short_name_lines(name_lines))
    return reduce(DataFrame.unionByName, found)


def gate(sequences: DataFrame, violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences of alignments that break no rule, and of those that do, with ``rules`` (distinct, sorted).

    ``violations`` is what ``validate`` found; write it to a table first where both results are used.
    """
    broken = violations.groupBy("alignment_id").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    return sequences.join(broken, "alignment_id", "left_anti"), sequences.join(broken, "alignment_id")


# exp() of more overflows a double, of less underflows to zero.
EXP_OVERFLOW = math.log(1.7976931348623157e308)
EXP_UNDERFLOW = -745.13321910194122


def math_domain(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """Flag rows on which exp(x), ln(x) or x**y leaves its domain or range.

    Adds ``exp_flag``, ``log_flag``, ``pow_flag`` (NULL when fine) and the values
    ``exp_x``, ``ln_x``, ``pow_xy`` (NULL when flagged). A negative base with an
    integer exponent is fine and gives the true power.
    """
    exp_flag = F.when(x > EXP_OVERFLOW, "overflow").when(x < EXP_UNDERFLOW, "underflow")
    log_flag = F.when(x <= 0, "domain")
    size = y * F.ln(F.abs(x))
    pow_flag = (
        F.when((x == 0) & (y <= 0), "domain")
        .when((x < 0) & (y != F.floor(y)), "domain")
        .when((x != 0) & (size > EXP_OVERFLOW), "overflow")
        .when((x != 0) & (size < EXP_UNDERFLOW), "underflow")
    )
    flagged = df.select("*", exp_flag.alias("exp_flag"), log_flag.alias("log_flag"), pow_flag.alias("pow_flag"))
    return flagged.select(
        "*",
        F.when(F.col("exp_flag").isNull(), F.exp(x)).alias("exp_x"),
        F.when(F.col("log_flag").isNull(), F.ln(x)).alias("ln_x"),
        F.when(F.col("pow_flag").isNull(), F.pow(x, y)).alias("pow_xy"),
    )
