"""Streams over several batches and restarts."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cladeframe.operators.topology import best_set
from cladeframe.session import scratch_path
from cladeframe.streaming import best, progress
from cladeframe.streaming.sinks import drain, newest, upsert

SCHEMA = "run_id bigint, ts timestamp, length bigint, accepted int"
TABLE = "window_start timestamp, run_id bigint, moves bigint, best_length bigint, accept_ratio double"
T0 = datetime(2024, 1, 1)


def rows(part):
    """Three parts an hour and a half apart; the last two overlap their forerunners' windows."""
    return [(i % 3, T0 + timedelta(minutes=25 * part + i), 100 - i % 7 - part, int(i % 4 == 0)) for i in range(60)]


def test_every_window_comes_out_also_after_a_restart(spark):
    source, path, state = (scratch_path(spark, x) for x in ("trace-in", "trace-out", "trace-state"))
    seen = []
    for part in range(3):
        spark.createDataFrame(rows(part), SCHEMA).coalesce(1).write.mode("append").parquet(source)
        seen += rows(part)
        # a new query on the same checkpoint goes on where the last one ended
        upsert(progress.progress(spark.readStream.schema(SCHEMA).parquet(source)), path, state).awaitTermination()
        got = newest(spark, path, TABLE, ["window_start", "run_id"])
        want = progress.progress(spark.createDataFrame(seen, SCHEMA))
        assert got.select(want.columns).exceptAll(want).count() == want.exceptAll(got.select(want.columns)).count() == 0
    assert got.count() == len({(r[0], (r[1] - T0) // timedelta(minutes=10)) for r in seen})
    # a batch that is written again changes nothing
    again = [tuple(r) for r in spark.read.parquet(f"{path}/batch=1").collect()]
    spark.createDataFrame(again, TABLE).write.mode("overwrite").parquet(f"{path}/batch=1")
    assert newest(spark, path, TABLE, ["window_start", "run_id"]).exceptAll(got).count() == 0


class Value:
    def __init__(self):
        self.value, self.reads, self.writes = None, 0, 0

    def exists(self):
        return self.value is not None

    def get(self):
        self.reads += 1
        return self.value

    def update(self, value):
        self.writes += 1
        self.value = value


def test_one_round_trip_a_batch():
    processor, state = best.BestTrees(), Value()
    processor.state = state
    first = pd.DataFrame({"key": [f"k{i % 50}" for i in range(500)], "length": [9] * 500})
    out = pd.concat(processor.handleInputRows((1, 0), iter([first, first]), None))
    assert sorted(out["key"]) == sorted({f"k{i}" for i in range(50)}) and (state.reads, state.writes) == (0, 1)
    assert list(processor.handleInputRows((1, 0), iter([first]), None)) == [] and (state.reads, state.writes) == (1, 1)
    better = pd.DataFrame({"key": ["a", "b", "a"], "length": [9, 8, 8]})
    (out,) = processor.handleInputRows((1, 0), iter([first, better]), None)
    assert out["key"].tolist() == ["b", "a"] and state.value == (8, ["b", "a"]) and (state.reads, state.writes) == (2, 2)


def test_best_trees_over_batches(spark):
    source, schema = scratch_path(spark, "scored"), "run_id bigint, key string, length bigint"
    data = [(i % 2, f"k{i * 7 % 40}", 20 - i % 11 if i < 200 else 9 + i % 3) for i in range(400)]
    for k in range(4):
        spark.createDataFrame(data[k::4], schema).coalesce(1).write.mode("append").parquet(source)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    session = best.stream_session(spark)
    stream = session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    path = drain(best.best_trees(stream, parts=3), "entered")
    assert spark.conf.get(provider) == before
    entered = spark.read.schema(schema).parquet(path)
    least = {r: min(x[2] for x in data if x[0] == r) for r in (0, 1)}
    assert {tuple(r) for r in best_set(entered, ["run_id"]).collect()} == {x for x in data if x[2] == least[x[0]]}
    assert entered.groupBy("run_id", "key", "length").agg(F.count(F.lit(1)).alias("c")).where("c > 1").count() == 0


@pytest.mark.parametrize("name", ["stream_progress", "stream_best"])
def test_registered_streams(spark, sf_dir, name):
    from cladeframe.catalog import all_queries

    assert all_queries()[name](spark, sf_dir).count() > 0


def test_state_values_do_not_grow_with_runs(spark):
    source, schema = scratch_path(spark, "many-runs"), "run_id bigint, key string, length bigint"
    big = 1 << 60
    data = [(None if i % 50 == 0 else big + i % 50, f"k{i * 7 % 40}", None if i % 13 == 0 else 30 - i * 11 % 17) for i in range(600)]
    for k in range(3):
        spark.createDataFrame(data[k::3] * 2, schema).coalesce(1).write.mode("append").parquet(source)
    stream = best.stream_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    path, state = scratch_path(spark, "many-out"), scratch_path(spark, "many-state")
    query = (
        best.best_trees(stream, parts=2, groups=3).writeStream.format("parquet")
        .option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    # 50 runs, but no more state values than groups and parts
    assert len(query.recentProgress) >= 3
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 6
    entered = spark.read.schema(schema).parquet(path)
    full = [x for x in data if x[2] is not None]
    least = {r: min(x[2] for x in full if x[0] == r) for r in {x[0] for x in full}}
    assert entered.groupBy("run_id", "key", "length").agg(F.count(F.lit(1)).alias("c")).where("c > 1").count() == 0
    found = {tuple(r) for r in entered.collect()}
    assert {x for x in full if x[2] == least[x[0]]} == {x for x in found if x[2] == least[x[0]]}


def test_many_runs_share_a_round_trip():
    processor, state = best.BestTreesOfRuns(), Value()
    processor.state = state
    part = pd.DataFrame({"run_id": [1, 2, 1, 1], "unnamed": [False] * 4, "key": ["a", "b", "c", "a"], "length": [5, 7, 5, 5]})
    (out,) = processor.handleInputRows((0, 0), iter([part, part]), None)
    assert out[["run_id", "key", "length"]].values.tolist() == [[1, "a", 5], [2, "b", 7], [1, "c", 5]] and (state.reads, state.writes) == (0, 1)
    assert list(processor.handleInputRows((0, 0), iter([part]), None)) == [] and (state.reads, state.writes) == (1, 1)
    (out,) = processor.handleInputRows((0, 0), iter([part.assign(length=[9, 6, 9, 9])]), None)
    assert out[["run_id", "key", "length"]].values.tolist() == [[2, "b", 6]] and (state.reads, state.writes) == (2, 2)
