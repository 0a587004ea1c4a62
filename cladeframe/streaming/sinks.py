"""Run a stream over all data that is there, into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cladeframe.session import scratch_path


def drain(stream: DataFrame, label: str) -> str:
    """Process everything available and append it to a table of its own; gives the table's path."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", scratch_path(spark, f"{label}-state"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return path


def upsert(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of the newest row of every key of an aggregated stream, up to all data that is there.

    Each batch writes the rows it changed to a folder of its own, named by the batch's number. A batch that is run again after a
    failure or restart overwrites its folder, so nothing counts twice. A key has one row per batch that changed it; with a
    watermark these are the batches while its window was open. ``newest`` reads the table.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def newest(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The table of ``upsert``: the row of the last batch for each key."""
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*keys, "_row.*")
