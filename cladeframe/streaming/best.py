"""Best trees so far, kept as streaming state."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state in RocksDB; options of the given session stay as they are."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return session


class BestTrees(StatefulProcessor):
    """State of one part of a run: its least length and the topologies that have it, as one value.

    It is read once a batch and written once where it changed, however many trees come. A topology is emitted when it enters the state. A
    strictly shorter tree empties the state first. What remains does not depend on arrival order.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "length bigint, keys array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, keys = self.state.get() if self.state.exists() else (None, [])
        known, fresh = set(keys), {}
        for part in rows:
            least = int(part["length"].min())
            if best is not None and least > best:
                continue
            if best is None or least < best:
                best, known, fresh = least, set(), {}
            for tree in part.loc[part["length"] == best, "key"]:
                if tree not in known:
                    fresh[tree] = None
        new = list(fresh)
        if new:
            self.state.update((best, sorted(known) + new))
            yield pd.DataFrame({"run_id": key[0], "key": new, "length": best})

    def close(self) -> None:
        pass


class BestTreesOfRuns(StatefulProcessor):
    """``BestTrees`` for one part of many runs: a single state value has a row for each tree kept of any of them.

    Runs without an id (``unnamed``) are one run. What a batch costs goes by its rows and not by the number of runs.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "run_id array<bigint>, unnamed array<boolean>, key array<string>, length array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = ["run_id", "unnamed", "key", "length"]
        values = self.state.get() if self.state.exists() else ([], [], [], [])
        kinds = {"run_id": "int64", "unnamed": "bool", "key": "object", "length": "int64"}
        held = pd.DataFrame(dict(zip(columns, values)), columns=columns).astype(kinds).assign(_old=True)
        for part in rows:
            # what is held comes first, so a tree that is known stays as it is
            held = pd.concat([held, part[columns].astype(kinds).assign(_old=False)], ignore_index=True)
            least = held.groupby(["run_id", "unnamed"])["length"].transform("min")
            held = held[held["length"] == least].drop_duplicates(["run_id", "unnamed", "key"])
        new = held.loc[~held["_old"], columns]
        if len(new):
            self.state.update(tuple(held[c].tolist() for c in columns))
            yield new.reset_index(drop=True)

    def close(self) -> None:
        pass


def best_trees(scored: DataFrame, parts: int = 64, groups: int | None = None) -> DataFrame:
    """Stream of trees that entered the best set of their part of a run.

    ``scored(run_id, key, length)``. Runs are cut into ``parts`` by topology, so a
    busy run is spread over many tasks and no topology is kept twice. Rows that
    were overtaken later stay in the output: reduce it with ``topology.best_set``.
    Needs the RocksDB state store (``stream_session``).

    Every state value costs a few milliseconds a batch. For many runs name a number of ``groups``: all runs of a group share a value for
    each part, which is written as a whole when one of them changed, and rows without a length are left out. A value grows with the runs of its group.
    """
    if groups is not None:
        schema = "run_id bigint, unnamed boolean, key string, length bigint"
        known = scored.where("length IS NOT NULL").select(
            F.pmod(F.xxhash64("run_id"), F.lit(groups)).alias("group"), F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"),
            F.coalesce("run_id", F.lit(0).cast("bigint")).alias("run_id"), F.col("run_id").isNull().alias("unnamed"), "key", "length",
        )
        entered = known.groupBy("group", "part").transformWithStateInPandas(
            statefulProcessor=BestTreesOfRuns(), outputStructType=schema, outputMode="append", timeMode="none"
        )
        return entered.select(F.when(~F.col("unnamed"), F.col("run_id")).alias("run_id"), "key", "length")
    return (
        scored.select("run_id", F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"), "key", "length")
        .groupBy("run_id", "part")
        .transformWithStateInPandas(
            statefulProcessor=BestTrees(),
            outputStructType="run_id bigint, key string, length bigint",
            outputMode="append",
            timeMode="none",
        )
    )
