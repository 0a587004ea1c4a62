"""One entry for all alignment formats, and the tables written out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cladeframe.functions import sequences as S
from cladeframe.operators.trees import with_newick
from cladeframe.sources.blocks import read_clustal, read_nexus, read_phylip
from cladeframe.sources.fasta import read_fasta

READERS = {"fasta": read_fasta, "phylip": read_phylip, "nexus": read_nexus, "clustal": read_clustal}


def read_alignments(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Upper-cased ``alignment_id, taxon_id, name, seq`` of all files below ``path``.

    A path without files raises Spark's own error. Check the result with
    ``operators.validate``.
    """
    if fmt not in READERS:
        raise ValueError(f"unknown alignment format {fmt!r}; one of {sorted(READERS)}")
    return READERS[fmt](spark, path).withColumn("seq", S.normalise(F.col("seq")))


def write_trees(trees: DataFrame, names: Column, path: str, ids: Sequence[str] = ()) -> None:
    """One bracketed unrooted tree per line, after the columns ``ids`` (run, alignment, ...), tab separated."""
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in ids], "newick")
    with_newick(trees, names).select(line.alias("value")).write.text(path)


def taxon_names(sequences: DataFrame) -> DataFrame:
    """Names of each alignment's taxa in order: ``alignment_id, names``, as ``write_trees`` takes them."""
    rows = sequences.groupBy("alignment_id").agg(F.array_sort(F.collect_list(F.struct("taxon_id", "name"))).alias("t"))
    return rows.select("alignment_id", F.transform("t", lambda t: t["name"]).alias("names"))


def log_rows(summary: DataFrame, implementation: str, runtime: Column) -> DataFrame:
    """Run log rows: implementation, rearrangements, topologies, score, runtime (2 decimals)."""
    return summary.select(
        F.lit(implementation).alias("Implementation"),
        F.col("rearrangements").alias("Rearrangements"),
        F.col("topologies").alias("Topologies"),
        F.col("score").alias("Score"),
        F.round(runtime, 2).alias("Runtime"),
    )


def append_run_log(rows: DataFrame, path: str) -> None:
    """Append to the run log, every file with its header."""
    rows.write.mode("append").option("sep", "\t").option("header", True).csv(path)


def trace_rows(trace: DataFrame) -> DataFrame:
    """Search trace as it is written: temperature times 10000.

    ``trace(run_id, iter, move, accepted, length, t, best_set_size)``.
    """
    return trace.select(
        "run_id",
        F.col("iter").alias("Iteration"),
        F.col("move").alias("Algorithm"),
        F.col("accepted").alias("Accepted"),
        F.col("length").alias("Length"),
        F.round(F.col("t") * 10000, 6).alias("Temperature"),
        F.col("best_set_size").alias("Treestack Size"),
    )


def write_trace(rows: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Append trace rows; ``by`` (such as ``run_id``) gives a folder for each value."""
    rows.write.partitionBy(*by).mode("append").option("sep", "\t").option("header", True).csv(path)


def stream_trace(rows: DataFrame, path: str, checkpoint: str, by: Sequence[str] = ()) -> StreamingQuery:
    """``write_trace`` of a stream: all rows that are there, each once, also after a restart."""
    sink = rows.writeStream.format("csv").option("sep", "\t").option("header", True)
    if by:
        sink = sink.partitionBy(*by)
    return sink.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
