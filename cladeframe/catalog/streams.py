"""Registered streaming queries, each with the SQL of its final table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.catalog import oracle_views as O
from cladeframe.catalog import views as V
from cladeframe.catalog.registry import Registry
from cladeframe.operators.topology import best_set
from cladeframe.session import scratch_path
from cladeframe.streaming import best, progress
from cladeframe.streaming.sinks import drain, newest, upsert

registry = Registry()
query = registry.query
#: Groups of runs that share a state value, for any number of runs.
GROUPS = 256


def event_stream(spark, sf_dir) -> DataFrame:
    schema = V.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")


@query(
    "stream_progress",
    O.sql(
        O.TRACE,
        query="""SELECT strftime(time_bucket(INTERVAL '10 minutes', ts), '%Y-%m-%d %H:%M:%S') AS window_start, run_id,
                        count(*) AS moves, min(length) AS best_length,
                        round(sum(accepted) / count(*), 9) AS accept_ratio
                 FROM trace GROUP BY time_bucket(INTERVAL '10 minutes', ts), run_id""",
    ),
)
def stream_progress(spark, sf_dir):
    """Every window of every run, by a stream that writes the windows each batch changed."""
    trace = event_stream(spark, sf_dir).select(
        F.col("user_id").alias("run_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        (100 + F.floor("value") % 50).cast("bigint").alias("length"),
        ((F.col("event_id") * 7919 + 13) % 1000 < 300).cast("int").alias("accepted"),
    )
    path = scratch_path(spark, "progress")
    rows = progress.progress(trace)
    upsert(rows, path, scratch_path(spark, "progress-state")).awaitTermination()
    schema = "window_start timestamp, run_id bigint, moves bigint, best_length bigint, accept_ratio double"
    return newest(spark, path, schema, ["window_start", "run_id"]).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "run_id", "moves", "best_length", F.round("accept_ratio", 9).alias("accept_ratio"),
    )


@query(
    "stream_best",
    O.sql(
        O.SCORED,
        query="""SELECT DISTINCT run_id, key, length FROM (
                   SELECT *, rank() OVER (PARTITION BY run_id ORDER BY length) AS r FROM scored) WHERE r = 1""",
    ),
)
def stream_best(spark, sf_dir):
    scored = V.scored_trees_of(event_stream(best.stream_session(spark), sf_dir))
    path = drain(best.best_trees(scored, parts=8, groups=GROUPS), "best")
    return best_set(spark.read.schema("run_id bigint, key string, length bigint").parquet(path), ["run_id"])
