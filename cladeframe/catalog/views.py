"""Alignments, trees and search traces derived from the given tables.

Every view uses all rows of its table and whole vectors or texts. The same
views are written as SQL text in ``oracle_views.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators.trace import positions
from cladeframe.session import spread

LINE_WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_of(x: Column) -> Column:
    """Nucleotide of a vector component; the cuts are near the quartiles."""
    return (
        F.when(x < -0.085, "A").when(x < 0, "C").when(x < 0.085, "G").otherwise("T")
    )


def vector_groups(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """One row per k consecutive vectors, the vectors as an array of k (NULL where missing)."""
    vec = table(spark, sf_dir, "embeddings").select(
        F.expr(f"vec_id div {k}").alias("gid"), (F.col("vec_id") % k).alias("taxon"), "embedding"
    )
    return vec.groupBy("gid").agg(
        F.array(*[F.max(F.when(F.col("taxon") == i, F.col("embedding"))) for i in range(k)]).alias("vectors")
    )


def vector_alignments(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Alignments of k taxa and 64 sites from consecutive vectors.

    A last group with fewer vectors is filled up with all-missing sequences.
    """
    rows = vector_groups(spark, sf_dir, k).select("gid", F.posexplode("vectors").alias("taxon_id", "v"))
    return rows.select(
        F.col("gid").cast("string").alias("alignment_id"),
        "taxon_id",
        F.concat(F.lit("v"), (F.col("gid") * k + F.col("taxon_id")).cast("string")).alias("name"),
        F.coalesce(
            F.array_join(F.transform("v", base_of), ""), F.lit("?" * 64)
        ).alias("seq"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of every whole document, upper-cased, in lines of 64: ``doc_id, line, letters``."""
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    lines = F.regexp_extract_all(letters, F.lit(f".{{1,{LINE_WIDTH}}}"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("line", "letters"))


def raw_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as they are: illegal letters, ``O`` and a short last line."""
    return document_lines(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("alignment_id"),
        F.col("line").alias("taxon_id"),
        F.concat(F.lit("line"), F.col("line").cast("string")).alias("name"),
        F.col("letters").alias("seq"),
    )


def document_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an alignment: its lines, recoded to nucleotides, are the taxa."""
    recoded = F.translate("seq", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTNACGTACRYTACGT-GTA")
    return raw_alignments(spark, sf_dir).withColumn("seq", F.rpad(recoded, LINE_WIDTH, "?"))


def leaf_orders(spark: SparkSession, sf_dir: str, k: int = 6) -> DataFrame:
    """Taxa 1..k-1 of each vector group ordered by one vector component, for all 64 components."""
    groups = spread(vector_groups(spark, sf_dir, k), "gid")
    component = groups.select("gid", "vectors", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("t"))
    ranked = F.array_sort(
        F.array(
            *[
                F.struct(
                    F.coalesce(F.get(F.get("vectors", F.lit(i)), F.col("t")), F.lit(0).cast("float")).alias("x"),
                    F.lit(i).alias("taxon"),
                )
                for i in range(1, k)
            ]
        )
    )
    return component.select(
        F.col("gid").cast("string").alias("alignment_id"),
        (F.col("gid") * 64 + F.col("t")).alias("tree_id"),
        "t",
        F.transform(ranked, lambda s: s["taxon"]).alias("leaf_order"),
    )


# Parents of the inner branches 6, 7, 8 and of the five ordered
# leaves, in the two tree shapes used for six taxa.
SHAPES6 = {
    "comb": {"inner": [0, 6, 7], "leaves": [0, 6, 7, 8, 8]},
    "split": {"inner": [0, 0, 7], "leaves": [6, 6, 7, 8, 8]},
}


def trees6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 six-taxon trees per alignment: a comb for even components, else ((1,2),(3,(4,5)))."""
    def parents(shape: dict) -> Column:
        slot = F.array(*[F.lit(p) for p in shape["leaves"]])
        leaves = [
            F.get(slot, (F.array_position("leaf_order", F.lit(i)) - 1).cast("int")) for i in range(1, 6)
        ]
        return F.array(F.lit(-1), *leaves, *[F.lit(p) for p in shape["inner"]])

    return leaf_orders(spark, sf_dir, 6).select(
        "alignment_id",
        "tree_id",
        "t",
        F.when(F.col("t") % 2 == 0, parents(SHAPES6["comb"])).otherwise(parents(SHAPES6["split"])).alias("parent"),
    )


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search trace: a run per user, an iteration per event."""
    events = table(spark, sf_dir, "events")
    numbered = positions(events, "user_id", "event_id", "iter")
    return numbered.select(
        F.col("user_id").alias("run_id"),
        "iter",
        F.col("ts").cast("timestamp").alias("ts"),
        F.element_at(F.array(F.lit("NNI"), F.lit("SPR"), F.lit("TBR")), (F.col("event_id") % 3 + 1).cast("int")).alias("move"),
        ((F.col("event_id") * 7919 + 13) % 1000 < 300).cast("int").alias("accepted"),
        (100 + F.floor("value") % 50).cast("bigint").alias("length"),
        (F.col("user_id") % 3).cast("int").alias("algorithm"),
        F.when(F.col("user_id") % 2 == 0, "G").otherwise("L").alias("cooling"),
        (((F.col("event_id") * 7919 + 13) % 1000) / F.lit(1000.0)).alias("u"),
        F.col("event_id").alias("seq"),
    )


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed moves: current and proposed length, minimum length, temperature, draw."""
    events = table(spark, sf_dir, "events")
    current = 100 + F.floor("value") % 50
    return events.select(
        F.col("event_id").alias("proposal_id"),
        F.col("user_id").alias("run_id"),
        current.cast("bigint").alias("current_length"),
        (current + F.col("event_id") % 11 - 3).cast("bigint").alias("proposed_length"),
        F.lit(90).cast("bigint").alias("min_length"),
        ((F.col("event_id") % 97 + 1) / F.lit(1000.0)).alias("temperature"),
        (((F.col("event_id") * 7919 + 13) % 1000) / F.lit(1000.0)).alias("u"),
    )


def scored_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored topologies: a run per user, keys shared by events of one type and value."""
    return scored_trees_of(table(spark, sf_dir, "events"))


def scored_trees_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.md5(F.concat_ws("-", F.col("event_type"), F.floor("value").cast("string"))).alias("key"),
        (100 + F.floor("value") % 50).cast("bigint").alias("length"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
