"""Sharding over fixed virtual slots.

Records hash into a fixed number of slots that never changes. A small table, the
slot map, says which shard holds each slot. Rebalancing edits that table: slots
move from full shards to empty ones, all others stay. Each edit is stored as a
new version next to the older ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladeframe.llm.common import id_hash
from cladeframe.session import materialise, scratch_path

SLOTS = 4096
#: Each slot's records are numbered in this many cells, so that no task numbers a whole slot.
CELLS = 16


def cell_of(key: Column, slots: int = SLOTS) -> Column:
    """Cell of a record; its slot is ``cell div CELLS``."""
    return F.pmod(id_hash(key), F.lit(slots * CELLS)).cast("int")


def edit_map(load: np.ndarray, shard_of: np.ndarray, shards: int) -> np.ndarray:
    """Edit a slot map until no move or swap between the fullest and the emptiest shard helps.

    ``load`` is the size of each slot. Shards beyond the map's own start empty, so growing moves about a fair share of the slots. The work is
    bounded by the number of slots, whatever the data.
    """
    shard_of = shard_of.copy()
    total = np.bincount(shard_of, weights=load, minlength=shards)
    for _ in range(8 * len(load)):
        full, empty = int(total.argmax()), int(total.argmin())
        half = (total[full] - total[empty]) / 2
        there = np.flatnonzero((shard_of == full) & (load > 0))
        if half <= 0 or not len(there):
            break
        here = np.flatnonzero(shard_of == empty)
        # moving slot i and taking back slot j shifts load[i] - load[j]; j = -1 takes nothing back
        back = np.append(load[here], 0)
        ids = np.append(here, -1)
        order = np.argsort(back, kind="stable")
        back, ids = back[order], ids[order]
        at = np.searchsorted(back, load[there] - half)
        best, pick = half, None
        for d in (-1, 0):
            k = np.clip(at + d, 0, len(back) - 1)
            miss = np.abs(load[there] - back[k] - half)
            i = int(miss.argmin())
            if miss[i] < best - 1e-9:
                best, pick = miss[i], (int(there[i]), int(ids[k[i]]))
        if pick is None:
            break
        i, j = pick
        shard_of[i] = empty
        total[full] -= load[i]
        total[empty] += load[i]
        if j >= 0:
            shard_of[j] = full
            total[empty] -= load[j]
            total[full] += load[j]
    return shard_of


def map_rows(spark: SparkSession, shard_of: np.ndarray, version: int) -> DataFrame:
    """``version, virtual_slot, shard`` from a map of bounded size, as a literal."""
    text = ",".join(map(str, shard_of.tolist()))
    shards = F.split(F.lit(text), ",").cast("array<int>")
    return spark.range(1).select(F.lit(version).alias("version"), F.posexplode(shards).alias("virtual_slot", "shard"))


class SlotMap:
    """Versions of a slot map, kept as a table in the shared folder."""

    def __init__(self, spark: SparkSession, slots: int = SLOTS, path: str | None = None) -> None:
        self.spark, self.slots = spark, slots
        self.path = path or scratch_path(spark, "slot-map")
        self.version = -1

    def store(self, shard_of: np.ndarray) -> int:
        self.version += 1
        map_rows(self.spark, shard_of, self.version).coalesce(1).write.mode("append").parquet(self.path)
        return self.version

    def read(self, version: int | None = None) -> DataFrame:
        rows = self.spark.read.schema("version int, virtual_slot int, shard int").parquet(self.path)
        return rows.where(F.col("version") == (self.version if version is None else version))

    def shards(self, version: int | None = None) -> np.ndarray:
        rows = self.read(version).orderBy("virtual_slot").collect()
        return np.array([r.shard for r in rows])


def measure(records: DataFrame) -> DataFrame:
    """Bytes and rows of each cell, from ``cell`` and ``size``: at most SLOTS * CELLS rows."""
    return records.groupBy("cell").agg(F.sum("size").alias("cell_bytes"), F.count(F.lit(1)).alias("cell_rows"))


def slot_loads(cells: DataFrame, slots: int = SLOTS) -> np.ndarray:
    load = np.zeros(slots)
    for r in cells.groupBy(F.expr(f"cell div {CELLS}").alias("s")).agg(F.sum("cell_bytes").alias("b")).collect():
        load[r.s] = r.b
    return load


def place(records: DataFrame, cells: DataFrame, slot_map: DataFrame, order: list[Column]) -> DataFrame:
    """Shard of each record and its place there, gapless from 0, with one shuffle on the cell."""
    info = cells.join(
        slot_map.select(F.col("virtual_slot").cast("long").alias("virtual_slot"), "shard", "version"),
        F.expr(f"cell div {CELLS} = virtual_slot"),
    )
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    info = info.select(
        F.col("cell").alias("info_cell"), "virtual_slot", "shard", "version", F.coalesce(F.sum("cell_rows").over(before), F.lit(0)).alias("offset")
    )
    number = F.row_number().over(W.partitionBy("cell").orderBy(*order))
    joined = records.withColumn("number", number).join(info, F.col("cell") == F.col("info_cell"))
    return joined.withColumn("slot", F.col("offset") + F.col("number") - 1).drop("info_cell", "number", "offset")


def shard_documents(docs: DataFrame, shards: int = 8, slot_map: SlotMap | None = None) -> DataFrame:
    """Shards of near equal bytes: ``doc_id, size, text_crc32, virtual_slot, version, shard, slot``.

    ``size`` is the UTF-8 length of the text plus 1. The map starts as slot modulo shards and is edited by the bytes
    in each slot. NULL text counts as empty; a NULL doc_id hashes as the empty text; repeated rows share a slot and
    get places of their own; an empty table gives no rows. Only id, size and checksum are moved. Where one cell holds more than a 16th of a
    shard's fair share, as with an id that very many rows have (or NULL), its rows are dealt over all cells by their number. A slot is never
    split, so a single record larger than a fair share makes its shard the largest.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    records = materialise(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            cell_of(F.col("doc_id")).alias("cell"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "records",
    )
    cells = materialise(measure(records), "cells")
    # at most 16 cells a shard
    total = cells.agg(F.sum("cell_bytes")).first()[0] or 0
    hot = [r.cell for r in cells.where(F.col("cell_bytes") * shards * 16 > total).where("cell_rows > 1").select("cell").collect()]
    if hot:
        spread = F.pmod(F.xxhash64("row"), F.lit(SLOTS * CELLS))
        records = records.withColumn("cell", F.when(F.col("cell").isin(hot), spread).otherwise(F.col("cell")))
        cells = materialise(measure(records), "cells")
    slot_map = slot_map or SlotMap(spark)
    if slot_map.version < 0:
        slot_map.store(np.arange(slot_map.slots) % shards)
    slot_map.store(edit_map(slot_loads(cells, slot_map.slots), slot_map.shards(), shards))
    return place(records, cells, slot_map.read(), [F.col("doc_id"), F.col("text_crc32")]).drop("cell", "row")
