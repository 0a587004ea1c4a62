"""Window queries over search traces.

Trace columns: ``run_id, iter, move, accepted, length`` and others as needed;
``iter`` counts 1, 2, ... inside a run. One run may hold a large share of all
rows, so running values are never computed in a single window per run: the rows
of a run are cut into segments of consecutive iterations, each segment gets a
summary, the short table of summaries is scanned per run, and rows then combine
what was carried into their segment with a window inside it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.kernels import epoch_numbers, epoch_scan, epoch_tables, epoch_tables_composed
from cladeframe.session import spread

SEGMENT = 65536

# Fixed values of the cooling rules.
MAX_ACCEPT = 5
MAX_PROPOSE = 2000
MAX_FAIL = 40
FROZEN_T = 1e-4
EPS = 1e-11
GRAD_GEOM = 0.99
GRAD_LINEAR = 1e-10
GRID_STEP = 1e-5
START_RATIO = 0.65


def _segmented(df: DataFrame, order: str, size: int) -> DataFrame:
    return df.withColumn("_seg", F.floor(F.col(order) / F.lit(size)))


def positions(df: DataFrame, run: str, order: str, name: str, size: int = SEGMENT) -> DataFrame:
    """Number the rows of each run 1, 2, ... by a unique integer ``order`` column."""
    seg = _segmented(df, order, size)
    before = Window.partitionBy(run).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        seg.groupBy(run, "_seg")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(run, "_seg", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(run, "_seg").orderBy(order)
    return (
        seg.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [run, "_seg"])
        .withColumn(name, (F.col("_offset") + F.col("_rn")).cast("bigint"))
        .drop("_seg", "_rn", "_offset")
    )


def running_best(trace: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Per row: best length so far, whether it is a strictly new best, and the best set's size.

    The best set counts accepted rows at the best length since it was first
    reached; a strictly better length starts it again with that row.
    """
    seg = _segmented(trace, "iter", size)
    inside = Window.partitionBy("run_id", "_seg").orderBy("iter")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = seg.withColumn("_min", F.min("length").over(inside)).withColumn(
        "_min_before", F.min("length").over(earlier)
    )

    # Summary of a segment: its minimum, and the set members at that minimum when
    # the minimum is new (first row always counts) or already known (accepted rows).
    least = seg.groupBy("run_id", "_seg", "length").agg(
        F.sum("accepted").alias("_acc"), F.min(F.struct("iter", "accepted")).alias("_first")
    )
    summary = least.groupBy("run_id", "_seg").agg(
        F.min(F.struct("length", "_acc", F.col("_first")["accepted"].alias("first"))).alias("m")
    )
    prior = Window.partitionBy("run_id").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    chain = (
        summary.withColumn("_before", F.min(F.col("m")["length"]).over(prior))
        .withColumn("_after", F.least(F.col("m")["length"], F.col("_before")))
        # members this segment adds to the set at its closing minimum
        .withColumn(
            "_adds",
            F.when(
                F.col("_before").isNull() | (F.col("m")["length"] < F.col("_before")),
                F.col("m")["_acc"] + 1 - F.col("m")["first"],
            ).when(F.col("m")["length"] == F.col("_before"), F.col("m")["_acc"]).otherwise(0),
        )
    )
    level = Window.partitionBy("run_id", "_after").orderBy("_seg")
    carried = Window.partitionBy("run_id").orderBy("_seg")
    carry = (
        chain.withColumn("_set", F.sum("_adds").over(level))
        .withColumn("_carry_set", F.lag("_set").over(carried))
        .select("run_id", "_seg", F.col("_before").alias("_carry_min"), "_carry_set")
    )

    joined = (
        rows.join(carry, ["run_id", "_seg"])
        .withColumn("running_best", F.least("_min", "_carry_min"))
        .withColumn("_best_before", F.least("_min_before", "_carry_min"))
        .withColumn(
            "is_new_best", F.coalesce(F.col("length") < F.col("_best_before"), F.lit(True)).cast("int")
        )
    )
    plateau = Window.partitionBy("run_id", "_seg", "running_best").orderBy("iter")
    member = F.when(F.col("is_new_best") == 1, 1).when(
        F.col("length") == F.col("running_best"), F.col("accepted")
    ).otherwise(0)
    in_segment = F.sum(member).over(plateau)
    size_col = in_segment + F.when(
        F.col("running_best") == F.col("_carry_min"), F.col("_carry_set")
    ).otherwise(0)
    return joined.withColumn("best_set_size", size_col.cast("bigint")).drop(
        "_seg", "_min", "_min_before", "_carry_min", "_carry_set", "_best_before"
    )


def progress_samples(trace: DataFrame, interval: int) -> DataFrame:
    """Rows at a fixed iteration interval."""
    return trace.filter(F.col("iter") % interval == 0)


def acceptance_ratio(trace: DataFrame) -> DataFrame:
    """Accepted and proposed moves by run and move, with subtotals."""
    return trace.rollup("run_id", "move").agg(
        F.count(F.lit(1)).alias("proposed"),
        F.sum("accepted").cast("bigint").alias("accepted"),
        (F.sum("accepted") / F.count(F.lit(1))).alias("ratio"),
    )


def metropolis_accept(current: Column, proposed: Column, minimum: Column, t: Column, u: Column) -> Column:
    """Whether a proposal is taken: never worse, or worse with probability e^(-delta/T)."""
    delta = energy_delta(current, proposed, minimum)
    p = F.when(-delta < t * math.log(EPS), F.lit(0.0)).otherwise(F.exp(-delta / t))
    return F.when(proposed <= current, F.lit(1)).otherwise((u < p).cast("int"))


def energy_delta(current: Column, proposed: Column, minimum: Column) -> Column:
    """Increase of the homoplasy index, at most 1."""
    return F.least(F.lit(1.0), minimum / current - minimum / proposed)


def temperature(t0: Column, epoch: Column, cooling: Column) -> Column:
    """Temperature of a cooling epoch, geometric (``G``) or linear, never below the floor."""
    geometric = t0 * F.pow(F.lit(GRAD_GEOM), epoch)
    linear = t0 - F.lit(GRAD_LINEAR) * epoch
    return F.greatest(F.lit(EPS), F.when(cooling == "G", geometric).otherwise(linear))


def move_probabilities(algorithm: Column, iteration: Column, epoch: Column, cooling: Column, t: Column, t0: Column) -> Column:
    """Expected shares of NNI, SPR and TBR for algorithms 0 and 1 as ``struct(nni, spr, tbr)``.

    Algorithm 0 alternates NNI (even) and SPR (odd, 0-based). Algorithm 1 only
    does TBR before the first cooling and under linear cooling, else TBR with T/t0.
    Shares of other algorithms depend on their history and are NULL here.
    """
    hot = t / t0
    fresh = (epoch == 0) | (cooling != "G")
    tbr = F.when(algorithm == 0, 0.0).when(fresh, 1.0).otherwise(hot)
    nni = F.when(algorithm == 0, F.when(iteration % 2 == 0, 1.0).otherwise(0.0)).when(fresh, 0.0).otherwise((1 - hot) / 2)
    spr = F.when(algorithm == 0, F.when(iteration % 2 == 0, 0.0).otherwise(1.0)).when(fresh, 0.0).otherwise((1 - hot) / 2)
    known = algorithm < 2
    return F.struct(*[F.when(known, p).alias(m) for m, p in (("nni", nni), ("spr", spr), ("tbr", tbr))])


def pseudocount_moves(trace: DataFrame, credit: Column, size: int = SEGMENT) -> DataFrame:
    """Adaptive move probabilities before each step.

    Three counters start at 1. A step with ``credit`` raises its own move by 1,
    any other step raises the two other moves by 0.5. The total is cut to an
    integer before dividing. Sums are kept in halves, so they are exact.
    """
    gains = {
        m: F.when(credit, F.when(F.col("move") == m, 2).otherwise(0)).otherwise(
            F.when(F.col("move") == m, 0).otherwise(1)
        )
        for m in ("NNI", "SPR", "TBR")
    }
    seg = _segmented(trace, "iter", size)
    for m, gain in gains.items():
        seg = seg.withColumn(f"_g{m}", gain.cast("bigint"))
    prior = Window.partitionBy("run_id").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = seg.groupBy("run_id", "_seg").agg(*[F.sum(f"_g{m}").alias(f"_s{m}") for m in gains])
    carry = carry.select(
        "run_id", "_seg", *[F.coalesce(F.sum(f"_s{m}").over(prior), F.lit(0)).alias(f"_c{m}") for m in gains]
    )
    inside = Window.partitionBy("run_id", "_seg").orderBy("iter").rowsBetween(Window.unboundedPreceding, -1)
    rows = seg.select(
        "*", *[F.coalesce(F.sum(f"_g{m}").over(inside), F.lit(0)).alias(f"_w{m}") for m in gains]
    ).join(carry, ["run_id", "_seg"])
    for m in gains:
        rows = rows.withColumn(f"count_{m.lower()}", 1 + (F.col(f"_c{m}") + F.col(f"_w{m}")) / 2)
    rows = rows.withColumn("total", F.floor(F.col("count_nni") + F.col("count_spr") + F.col("count_tbr")))
    for m in gains:
        rows = rows.withColumn(f"p_{m.lower()}", F.col(f"count_{m.lower()}") / F.col("total"))
    return rows.drop("_seg", *[f"_{x}{m}" for m in gains for x in "gcw"])


def starting_temperature(sample: DataFrame, min_length: Column) -> DataFrame:
    """Lowest grid temperature at which more than 65 % of the worse moves are accepted.

    ``sample(run_id, current_length, proposed_length, u)``. A worse move is
    accepted at T exactly when T exceeds a threshold of that move, so each move
    is reduced to a grid cell and cells are counted; the grid itself is never
    joined. Without any worse move the first grid value is kept. Never above 1.
    """
    delta = energy_delta(F.col("current_length"), F.col("proposed_length"), min_length)
    threshold = F.greatest(delta / -F.ln("u"), delta / F.lit(-math.log(EPS)))
    cell = (
        F.when(F.col("u") <= 0, delta / F.lit(-math.log(EPS))).otherwise(threshold) - F.lit(EPS)
    ) / F.lit(GRID_STEP)
    cells = int(1 / GRID_STEP)
    worse = sample.filter(F.col("proposed_length") > F.col("current_length"))
    counted = (
        worse.select("run_id", F.least(F.floor(cell) + 1, F.lit(cells)).alias("k"))
        .groupBy("run_id", "k")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    up_to = Window.partitionBy("run_id").orderBy("k")
    whole = Window.partitionBy("run_id")
    reached = (
        counted.withColumn("cum", F.sum("c").over(up_to))
        .withColumn("total", F.sum("c").over(whole))
        .filter(F.col("cum") / F.col("total") > START_RATIO)
        .groupBy("run_id")
        .agg(F.min("k").alias("k"))
    )
    runs = sample.select("run_id").distinct()
    return runs.join(reached, "run_id", "left").select(
        "run_id",
        F.least(F.lit(1.0), F.lit(EPS) + F.lit(GRID_STEP) * F.coalesce("k", F.lit(0))).alias("t0"),
    )


def running_max(df: DataFrame, value: Column, order: str, name: str, size: int = SEGMENT) -> DataFrame:
    """Add the largest ``value`` so far in each run (NULLs are skipped), segment by segment."""
    seg = _segmented(df.withColumn("_v", value), order, size)
    prior = Window.partitionBy("run_id").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        seg.groupBy("run_id", "_seg")
        .agg(F.max("_v").alias("_m"))
        .select("run_id", "_seg", F.max("_m").over(prior).alias("_carry"))
    )
    inside = Window.partitionBy("run_id", "_seg").orderBy(order)
    return (
        seg.withColumn("_w", F.max("_v").over(inside))
        .join(carry, ["run_id", "_seg"])
        .withColumn(name, F.greatest("_w", "_carry"))
        .drop("_seg", "_v", "_w", "_carry")
    )


# --- cooling epochs ----------------------------------------------------------

FAN = 256
LEVELS = 2


def cooling_epochs(
    trace: DataFrame,
    max_accept: int = MAX_ACCEPT,
    max_propose: int = MAX_PROPOSE,
    size: int = SEGMENT,
) -> DataFrame:
    """Number the cooling epochs 0, 1, ... of each run: ``run_id, iter, accepted, epoch``.

    An epoch ends with the row that brings its accepted moves to ``max_accept``
    or its proposals to ``max_propose``. That depends on all rows before, but the
    state between two rows is small (accepted, proposed), so a segment of rows
    acts as a table from entry state to exit state and epochs ended. Tables are
    made per segment, chained over the segments of a run in groups, level by
    level, and then each segment numbers its own rows. The plan is the same at every
    size; ``LEVELS`` levels of ``FAN`` keep groups small up to 10^12 rows a run, beyond
    which the uppermost group grows by one table for each further 4 billion rows.
    A first segment starts in a known state, so its table has one entry.
    """
    rows = spread(_segmented(trace.select("run_id", "iter", "accepted"), "iter", size), "run_id", "_seg")
    limits = (max_accept, max_propose)
    schema = "run_id bigint, iter bigint, accepted int, epoch bigint"
    first, later = rows.filter("_seg = 0"), rows.filter("_seg > 0")
    # a run of one segment needs no tables, and a first segment has few rows to look its run up with
    chained = first.join(later.select("run_id").distinct(), "run_id", "left_semi").unionByName(later)
    tables = chained.groupBy("run_id", "_seg").applyInPandas(
        lambda pdf: epoch_tables(pdf, *limits), "run_id bigint, _seg bigint, exits binary, ended binary"
    )
    known = first.withColumns({"entry": F.lit(0), "before": F.lit(0).cast("bigint")})
    entered = known.unionByName(later.join(_entry_states(tables, LEVELS), ["run_id", "_seg"]))
    return entered.groupBy("run_id", "_seg").applyInPandas(lambda pdf: epoch_numbers(pdf, *limits), schema)


def _entry_states(tables: DataFrame, levels: int) -> DataFrame:
    """State and epochs before each segment: ``run_id, _seg, entry, before``."""
    schema = "run_id bigint, _seg bigint, entry int, before bigint"
    if levels == 0:
        start = tables.withColumn("entry0", F.lit(0)).withColumn("before0", F.lit(0).cast("bigint"))
        return start.groupBy("run_id").applyInPandas(epoch_scan, schema)
    grouped = tables.withColumn("_group", F.floor(F.col("_seg") / FAN))
    upper = grouped.groupBy("run_id", "_group").applyInPandas(
        epoch_tables_composed, "run_id bigint, _seg bigint, exits binary, ended binary"
    )
    above = _entry_states(upper, levels - 1).select(
        "run_id", F.col("_seg").alias("_group"), F.col("entry").alias("entry0"), F.col("before").alias("before0")
    )
    return grouped.join(above, ["run_id", "_group"]).groupBy("run_id", "_group").applyInPandas(epoch_scan, schema)


def epoch_table(
    epochs: DataFrame, max_accept: int = MAX_ACCEPT, max_propose: int = MAX_PROPOSE
) -> DataFrame:
    """One row per epoch: ``proposed, accepted, outcome`` (accepted, limited or open)."""
    return (
        epochs.groupBy("run_id", "epoch")
        .agg(F.count(F.lit(1)).alias("proposed"), F.sum("accepted").alias("accepted"))
        .withColumn(
            "outcome",
            F.when(F.col("accepted") >= max_accept, "accepted")
            .when(F.col("proposed") >= max_propose, "limited")
            .otherwise("open"),
        )
    )


def frozen_runs(
    epoch_rows: DataFrame, max_fail: int = MAX_FAIL, frozen_t: float = FROZEN_T, size: int = SEGMENT
) -> DataFrame:
    """Runs that freeze, with the first epoch at which they do.

    ``epoch_rows(run_id, epoch, outcome, t)``. Frozen means: the last ``max_fail``
    epochs in a row ended by the proposal limit and the temperature is below
    ``frozen_t``.
    """
    ended = epoch_rows.filter("outcome <> 'open'")
    marked = running_max(ended, F.when(F.col("outcome") == "accepted", F.col("epoch")), "epoch", "_last_ok", size)
    streak = F.col("epoch") - F.coalesce("_last_ok", F.lit(-1))
    return (
        marked.filter((streak >= max_fail) & (F.col("t") < frozen_t))
        .groupBy("run_id")
        .agg(F.min("epoch").alias("frozen_epoch"))
    )


def run_summary(trace: DataFrame, min_length: Column) -> DataFrame:
    """Per run: rearrangements, distinct best trees, score, consistency and homoplasy index."""
    best = running_best(trace)
    score = F.min("length")
    return best.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rearrangements"),
        F.max_by("best_set_size", "iter").alias("topologies"),
        score.alias("score"),
        F.round(F.first(min_length) / score, 2).alias("ci"),
        F.round(1 - F.first(min_length) / score, 2).alias("hi"),
    )


def run_outputs(trace: DataFrame) -> DataFrame:
    """Per run: initial length, best length, when it was first reached, trees kept, iterations."""
    best = running_best(trace)
    return best.groupBy("run_id").agg(
        F.min_by("length", "iter").alias("initial_length"),
        F.min("length").alias("best_length"),
        F.max(F.when(F.col("is_new_best") == 1, F.col("iter"))).alias("best_iter"),
        F.max_by("best_set_size", "iter").alias("trees"),
        F.count(F.lit(1)).alias("iterations"),
    )
