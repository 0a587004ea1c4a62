"""FASTA files, read one record per row and written in lines of 60."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.functions import sequences as S
from cladeframe.sources.paths import alignment_of, write_files

LINE = 60


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``alignment_id, taxon_id, name, seq`` of all FASTA files below ``path``.

    Large files are split across tasks. Taxa are numbered in file order without
    moving the records: a short table of the records per block of a file gives
    every block its first number, and a record adds its place in the block. A
    header without sequence has an empty ``seq``. Text before the first header of a
    file is not a record.
    """
    records = (
        spark.read.option("lineSep", "\n>")
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"),
        )
    )
    # only the first record of a file still has its own header mark, or none at all
    headed = F.ltrim("value").startswith(">")
    junk = F.when((F.col("block") == 0) & ~F.min_by(headed, F.col("at")), 1).otherwise(0)
    blocks = records.groupBy("path", "block").agg(
        (F.min("at") + junk).alias("lo"), (F.count(F.lit(1)) - junk).alias("c")
    )
    ordered = Window.partitionBy("alignment_id").orderBy("path", "block")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocks.withColumn("alignment_id", alignment_of(F.col("path")))
        .withColumn("offset", F.coalesce(F.sum("c").over(before), F.lit(0)))
        .drop("c")
    )
    placed = records.join(offsets, ["path", "block"]).filter(F.col("at") >= F.col("lo"))
    is_first = (F.col("block") == 0) & (F.col("at") == F.col("lo"))
    text = F.when(is_first & headed, F.substring(F.ltrim("value"), 2, 2**31 - 1)).otherwise(F.col("value"))
    placed = placed.withColumn("text", text).withColumn("cut", F.locate("\n", F.col("text")))
    body = F.when(F.col("cut") > 0, F.substring("text", F.col("cut") + 1, F.length("text"))).otherwise("")
    return placed.select(
        "alignment_id",
        (F.col("offset") + F.col("at") - F.col("lo")).cast("int").alias("taxon_id"),
        S.trim_chars(F.substring_index("text", "\n", 1)).alias("name"),
        S.trim_chars(F.regexp_replace(body, "[ \r]*\n[ \r\n]*", "")).alias("seq"),
    )


def fasta_record(name: Column, seq: Column) -> Column:
    """One record: header and sequence in lines of 60."""
    wrapped = F.regexp_replace(seq, f"(.{{{LINE}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), name, F.lit("\n"), wrapped)


def write_fasta(sequences: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder ``alignment_id=x`` per alignment, records in taxon order.

    A large alignment is cut into several files whose names sort in taxon order.
    """
    # a file costs much more than its bytes, so the number of tasks is not left to their size
    tasks = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        sequences.select("alignment_id", "taxon_id", fasta_record(F.col("name"), F.col("seq")).alias("value"))
        .repartitionByRange(tasks, "alignment_id", "taxon_id")
        .sortWithinPartitions("alignment_id", "taxon_id")
        .select("alignment_id", "value")
    )
    write_files(rows, path, mode)
