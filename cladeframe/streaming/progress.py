"""Live progress of searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def progress(trace: DataFrame, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Moves, best length and acceptance per run and tumbling window.

    ``trace(run_id, ts, length, accepted)``; rows later than ``delay`` are dropped
    by the watermark. Write the stream with ``sinks.upsert``, whose table has every window, those that are still open, too. Partial aggregates run before the shuffle, so a busy run
    sends one row per task and window. Works on batch tables as well.
    """
    return (
        trace.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"), "run_id")
        .agg(
            F.count(F.lit(1)).alias("moves"),
            F.min("length").alias("best_length"),
            (F.sum("accepted") / F.count(F.lit(1))).alias("accept_ratio"),
        )
        .select(F.col("w.start").alias("window_start"), "run_id", "moves", "best_length", "accept_ratio")
    )
