"""Mixing sources to target weights by hash thresholds.

Each document has a fixed hash. A source that should give more than it has gives
whole copies of itself first. For the rest, tokens are summed by source and hash bucket,
the bucket in which the budget ends is cut into finer buckets, and so on until it holds one hash value. The
documents below that value are the sample: larger budgets contain smaller ones, and no row is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladeframe.llm.common import WORD, id_hash, same
from cladeframe.session import materialise

HASH_BITS = 60
BUCKET_BITS = 12
#: A document too long for what is left of a budget is passed over, and the rest filled from later hashes, this often.
SKIPS = 4
MOST = 3


def size_of(text: str | Column) -> Column:
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, weights 1, 2, 3 repeating by source, NULL last.

    The targets add up to the total size; none is above ``most`` times its source's size. Sources in the order of
    size per weight are full up to a level and take a common amount per weight beyond it; that amount is
    the largest one over all cuts of that order. One row per source goes through one window.
    """
    everything = W.partitionBy()
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    s = sizes.withColumn("rank", rank).withColumn("weight", (F.col("rank") % 3 + 1).cast("double"))
    by_ratio = W.orderBy(most * F.col("source_size") / F.col("weight"), "rank")
    s = s.select(
        "source", "source_size", "weight",
        F.sum("source_size").over(everything).cast("double").alias("total"),
        F.coalesce(F.sum(most * F.col("source_size")).over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("double").alias("before"),
        F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)).alias("after"),
    )
    level = F.max((F.col("total") - F.col("before")) / F.col("after")).over(everything)
    return s.withColumn("level", level).select(
        "source", "source_size", F.least((most * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")).alias("target")
    )


def _refine(records: DataFrame, state: DataFrame) -> DataFrame:
    """One finer look at every source whose budget's end isn't known to the single hash value.

    ``state`` has, by source, the range ``lo`` (inclusive), ``hi`` (exclusive) that holds the end, and what is left of the budget at lo.
    Adds ``end_lo, end_hi``: the bucket where the budget ends, as its smallest and largest hash (NULL: it doesn't end),
    ``end_size``: tokens there, ``spent``: tokens before it.
    """
    r = records.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    r = r.where((F.col("h") >= F.col("lo")) & (F.col("h") < F.col("hi")))
    bucket = F.expr(f"(h - lo) div greatest(1L, (hi - lo + {2**BUCKET_BITS - 1}) div {2**BUCKET_BITS})")
    buckets = r.groupBy("source", "budget", bucket.alias("bucket")).agg(
        F.sum("size").alias("n"), F.min("h").alias("first"), F.max("h").alias("last")
    )
    upto = W.partitionBy("source").orderBy("first").rowsBetween(W.unboundedPreceding, 0)
    over = buckets.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") > F.col("budget"))
    return over.groupBy("source").agg(
        F.min(F.struct("first", "last", "n", (F.col("upto") - F.col("n")).alias("spent"))).alias("end")
    )


def thresholds(records: DataFrame, skips: int = SKIPS) -> DataFrame:
    """``source, source_size, target, copies, spans`` from ``source, size, h``.

    A document is taken ``copies`` times, and once more if its hash lies in one of the ``spans`` (from, to exclusive).
    """
    total = records.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(total)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = plan.withColumn("copies", copies).select(
        "source", "source_size", "target", "copies",
        (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"),
        F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("lo"), F.lit(2**HASH_BITS).cast("long").alias("hi"),
        F.lit(0).alias("skipped"), F.expr("cast(array() as array<struct<from: bigint, to: bigint>>)").alias("spans"),
        (F.col("target") <= F.col("copies") * F.col("source_size")).alias("done"),
    )
    state = materialise(state, "mix-state")
    while state.where(~F.col("done")).limit(1).count():
        ends = _refine(records, state.where(~F.col("done")).select("source", "budget", "lo", "hi"))
        ends = ends.withColumnRenamed("source", "s")
        j = state.join(ends, state.source.eqNullSafe(ends.s), "left").drop("s")
        live = ~F.col("done")
        none = live & F.col("end").isNull()  # everything that is left fits
        single = live & F.col("end").isNotNull() & (F.col("end.first") == F.col("end.last"))
        coarse = live & F.col("end").isNotNull() & (F.col("end.first") < F.col("end.last"))
        left = F.col("budget") - F.col("end.spent")
        last = single & (F.col("skipped") >= skips)
        nearer = F.col("end.n") - left < left
        skip = single & (F.col("skipped") < skips)

        def span(to: Column) -> Column:
            return F.concat("spans", F.array(F.struct(F.col("start").alias("from"), to.cast("long").alias("to"))))

        state = materialise(
            j.select(
                "source", "source_size", "target", "copies",
                F.when(coarse | single, left).otherwise(F.col("budget")).alias("budget"),
                F.when(skip, F.col("end.first") + 1).otherwise(F.col("start")).alias("start"),
                F.when(coarse, F.col("end.first")).when(skip, F.col("end.first") + 1).otherwise(F.col("lo")).alias("lo"),
                F.when(coarse, F.col("end.last") + 1).when(skip, F.lit(2**HASH_BITS)).otherwise(F.col("hi")).cast("long").alias("hi"),
                F.when(skip, F.col("skipped") + 1).otherwise(F.col("skipped")).alias("skipped"),
                F.when(none, span(F.lit(2**HASH_BITS)))
                .when(last, span(F.col("end.first") + F.when(nearer, 1).otherwise(0)))
                .when(skip, span(F.col("end.first")))
                .otherwise(F.col("spans")).alias("spans"),
                (F.col("done") | none | last).alias("done"),
            ),
            "mix-state",
        )
    return state.select("source", "source_size", "target", "copies", "spans")


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, h`` of every document, as a table."""
    return materialise(docs.select("doc_id", "source", size_of("text").alias("size"), id_hash("doc_id").alias("h")), "mix-records")


def times_taken(h: Column) -> Column:
    return F.col("copies") + F.when(F.exists("spans", lambda s: (s["from"] <= h) & (h < s["to"])), 1).otherwise(0)


def mix(docs: DataFrame, skips: int = SKIPS) -> DataFrame:
    """How often each document is taken: ``doc_id, source, size, source_size, target, times, taken``.

    NULL text has size 0, NULL source is a source of its own, documents with equal ids (or none) have one hash and go together; an empty
    table gives no rows. A source's taken words miss its target by at most half of the last document looked at. The
    result depends on ids, sources and sizes only, so reruns agree.
    """
    records = measured(docs)
    plan = thresholds(records, skips).withColumnRenamed("source", "s")
    r = records.join(plan, records.source.eqNullSafe(plan.s), "left")
    times = times_taken(F.col("h"))
    return r.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, skips: int = SKIPS) -> DataFrame:
    """The mix itself: all columns of the documents, each row as often as it is taken."""
    plan = thresholds(measured(docs), skips)
    plan = plan.select(F.struct("source", "copies", "spans").alias("__mix"))
    r = docs.join(plan, docs.source.eqNullSafe(F.col("__mix.source")))
    h = id_hash(docs.doc_id)
    more = F.exists("__mix.spans", lambda s: (s["from"] <= h) & (h < s["to"]))
    times = (F.col("__mix.copies") + F.when(more, 1).otherwise(0)).cast("int")
    copies = F.when(times > 0, F.sequence(F.lit(1), times))
    return r.withColumn("__copy", F.explode(copies)).select(*[docs[c] for c in docs.columns])
