"""Registered queries over search traces, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.catalog import oracle_views as O
from cladeframe.catalog import views as V
from cladeframe.catalog.registry import Registry
from cladeframe.operators import trace as R

registry = Registry()
query = registry.query

T0 = 0.001

_BEST = """
best AS (SELECT *, min(length) OVER w AS running_best, min(length) OVER (PARTITION BY run_id ORDER BY iter
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before
         FROM trace WINDOW w AS (PARTITION BY run_id ORDER BY iter)),
flagged AS (SELECT *, CASE WHEN best_before IS NULL OR length < best_before THEN 1 ELSE 0 END AS is_new_best FROM best),
spans AS (SELECT *, sum(is_new_best) OVER (PARTITION BY run_id ORDER BY iter) AS span FROM flagged),
sized AS (SELECT *, CAST(sum(CASE WHEN is_new_best = 1 THEN 1 WHEN length = running_best THEN accepted ELSE 0 END)
                OVER (PARTITION BY run_id, span ORDER BY iter) AS BIGINT) AS best_set_size FROM spans)"""


@query("running_best", O.sql(O.TRACE, _BEST, query="SELECT run_id, iter, length, running_best FROM sized"))
def running_best(spark, sf_dir):
    return R.running_best(V.trace(spark, sf_dir)).select("run_id", "iter", "length", "running_best")


@query("new_best_flag", O.sql(O.TRACE, _BEST, query="SELECT run_id, iter, length, is_new_best FROM sized"))
def new_best_flag(spark, sf_dir):
    return R.running_best(V.trace(spark, sf_dir)).select("run_id", "iter", "length", "is_new_best")


@query("best_set_size", O.sql(O.TRACE, _BEST, query="SELECT run_id, iter, best_set_size FROM sized"))
def best_set_size(spark, sf_dir):
    return R.running_best(V.trace(spark, sf_dir)).select("run_id", "iter", "best_set_size")


@query("progress_samples", O.sql(O.TRACE, query="SELECT run_id, iter, length FROM trace WHERE iter % 10 = 0"))
def progress_samples(spark, sf_dir):
    return R.progress_samples(V.trace(spark, sf_dir), 10).select("run_id", "iter", "length")


@query(
    "acceptance_ratio",
    O.sql(
        O.TRACE,
        query="""SELECT run_id, move, count(*) AS proposed, CAST(sum(accepted) AS BIGINT) AS accepted,
                        round(sum(accepted) / count(*), 9) AS ratio
                 FROM trace GROUP BY ROLLUP (run_id, move)""",
    ),
)
def acceptance_ratio(spark, sf_dir):
    return R.acceptance_ratio(V.trace(spark, sf_dir)).withColumn("ratio", F.round("ratio", 9))


@query(
    "metropolis_accept",
    O.sql(
        O.PROPOSALS,
        query="""SELECT proposal_id, CASE WHEN proposed_length <= current_length THEN 1
                        WHEN -d < temperature * ln(1e-11) THEN CASE WHEN u < 0 THEN 1 ELSE 0 END
                        WHEN u < exp(-d / temperature) THEN 1 ELSE 0 END AS accepted
                 FROM (SELECT *, least(1.0, min_length / current_length - min_length / proposed_length) AS d
                       FROM proposals)""",
    ),
)
def metropolis_accept(spark, sf_dir):
    taken = R.metropolis_accept(
        F.col("current_length"), F.col("proposed_length"), F.col("min_length"), F.col("temperature"), F.col("u")
    )
    return V.proposals(spark, sf_dir).select("proposal_id", taken.alias("accepted"))


def epochs_sql(max_accept: int, max_propose: int) -> str:
    """Epochs by walking every run one iteration at a time."""
    return f"""
walk AS (SELECT run_id, iter, accepted, 0::BIGINT AS epoch, accepted AS a, 1 AS p FROM trace WHERE iter = 1
         UNION ALL
         SELECT t.run_id, t.iter, t.accepted, w.epoch + CASE WHEN w.a >= {max_accept} OR w.p >= {max_propose} THEN 1 ELSE 0 END,
                CASE WHEN w.a >= {max_accept} OR w.p >= {max_propose} THEN 0 ELSE w.a END + t.accepted,
                CASE WHEN w.a >= {max_accept} OR w.p >= {max_propose} THEN 0 ELSE w.p END + 1
         FROM walk w JOIN trace t ON t.run_id = w.run_id AND t.iter = w.iter + 1)"""


_TRACE_ONCE = O.TRACE.replace("trace AS (", "trace AS MATERIALIZED (")
_TEMPERATURE = f"""greatest(1e-11, CASE WHEN cooling = 'G' THEN {T0} * pow(0.99, epoch) ELSE {T0} - 1e-10 * epoch END)"""


@query(
    "cooling_epochs",
    O.sql(
        _TRACE_ONCE, epochs_sql(R.MAX_ACCEPT, R.MAX_PROPOSE), recursive=True,
        query="SELECT run_id, iter, accepted, epoch FROM walk",
    ),
)
def cooling_epochs(spark, sf_dir):
    return R.cooling_epochs(V.trace(spark, sf_dir))


def with_temperature(spark, sf_dir):
    """Trace rows with their epoch and temperature."""
    trace = V.trace(spark, sf_dir)
    epochs = R.cooling_epochs(trace).drop("accepted")
    t = R.temperature(F.lit(T0), F.col("epoch"), F.col("cooling"))
    return trace.join(epochs, ["run_id", "iter"]).withColumn("t", t)


@query(
    "cooling_schedule",
    O.sql(
        _TRACE_ONCE, epochs_sql(R.MAX_ACCEPT, R.MAX_PROPOSE), recursive=True,
        query=f"""SELECT run_id, iter, epoch, cooling, round({_TEMPERATURE}, 14) AS t
                  FROM walk JOIN trace USING (run_id, iter)""",
    ),
)
def cooling_schedule(spark, sf_dir):
    return with_temperature(spark, sf_dir).select("run_id", "iter", "epoch", "cooling", F.round("t", 14).alias("t"))


_HOT = f"({_TEMPERATURE} / {T0})"


@query(
    "move_probabilities",
    O.sql(
        _TRACE_ONCE, epochs_sql(R.MAX_ACCEPT, R.MAX_PROPOSE),
        f"""rows_ AS (SELECT run_id, iter, move, algorithm, cooling, epoch, {_HOT} AS hot
                      FROM walk JOIN trace USING (run_id, iter)),
            probs AS (SELECT *, CAST(floor(hot * 10) AS BIGINT) AS band,
                  CASE WHEN algorithm = 2 THEN NULL
                       WHEN algorithm = 0 THEN CASE WHEN iter % 2 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
                       WHEN epoch = 0 OR cooling <> 'G' THEN 0.0::DOUBLE ELSE (1 - hot) / 2 END AS nni,
                  CASE WHEN algorithm = 2 THEN NULL WHEN algorithm = 0 THEN 0.0::DOUBLE
                       WHEN epoch = 0 OR cooling <> 'G' THEN 1.0::DOUBLE ELSE hot END AS tbr FROM rows_)""",
        recursive=True,
        query="""SELECT run_id, band, round(avg(nni), 9) AS expected_nni, round(avg(tbr), 9) AS expected_tbr,
                        round(avg(CASE WHEN move = 'NNI' THEN 1.0::DOUBLE ELSE 0 END), 9) AS observed_nni,
                        round(avg(CASE WHEN move = 'TBR' THEN 1.0::DOUBLE ELSE 0 END), 9) AS observed_tbr
                 FROM probs GROUP BY run_id, band""",
    ),
)
def move_probabilities(spark, sf_dir):
    rows = with_temperature(spark, sf_dir)
    p = R.move_probabilities(
        F.col("algorithm"), F.col("iter") - 1, F.col("epoch"), F.col("cooling"), F.col("t"), F.lit(T0)
    )
    rows = rows.withColumn("p", p).withColumn("band", F.floor(F.col("t") / T0 * 10))
    return rows.groupBy("run_id", "band").agg(
        F.round(F.avg(F.col("p")["nni"]), 9).alias("expected_nni"),
        F.round(F.avg(F.col("p")["tbr"]), 9).alias("expected_tbr"),
        F.round(F.avg((F.col("move") == "NNI").cast("double")), 9).alias("observed_nni"),
        F.round(F.avg((F.col("move") == "TBR").cast("double")), 9).alias("observed_tbr"),
    )


_GAIN = "CASE WHEN accepted = 1 THEN CASE WHEN move = '{m}' THEN 1.0 ELSE 0 END ELSE CASE WHEN move = '{m}' THEN 0 ELSE 0.5 END END"
_COUNTERS = ", ".join(
    f"CAST(1 + coalesce(sum({_GAIN.format(m=m)}) OVER w, 0) AS DOUBLE) AS count_{m.lower()}" for m in ("NNI", "SPR", "TBR")
)


@query(
    "pseudocount_moves",
    O.sql(
        O.TRACE,
        f"""counters AS (SELECT run_id, iter, {_COUNTERS} FROM trace
            WINDOW w AS (PARTITION BY run_id ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            totals AS (SELECT *, CAST(floor(count_nni + count_spr + count_tbr) AS BIGINT) AS total FROM counters)""",
        query="""SELECT run_id, iter, count_nni, count_spr, count_tbr, total, round(count_nni / total, 9) AS p_nni,
                        round(count_spr / total, 9) AS p_spr, round(count_tbr / total, 9) AS p_tbr FROM totals""",
    ),
)
def pseudocount_moves(spark, sf_dir):
    out = R.pseudocount_moves(V.trace(spark, sf_dir), F.col("accepted") == 1)
    return out.select(
        "run_id", "iter", "count_nni", "count_spr", "count_tbr", "total",
        *[F.round(p, 9).alias(p) for p in ("p_nni", "p_spr", "p_tbr")],
    )


@query(
    "starting_temperature",
    O.sql(
        O.PROPOSALS,
        """worse AS (SELECT run_id, least(1.0, min_length / current_length - min_length / proposed_length) AS d, u
                     FROM proposals WHERE proposed_length > current_length),
           cells AS (SELECT run_id, least(CAST(floor((greatest(CASE WHEN u > 0 THEN d / -ln(u) ELSE 0 END, d / -ln(1e-11))
                                                     - 1e-11) / 1e-5) AS BIGINT) + 1, 100000) AS k FROM worse),
           ordered AS (SELECT run_id, k, row_number() OVER (PARTITION BY run_id ORDER BY k) AS r,
                              count(*) OVER (PARTITION BY run_id) AS n FROM cells)""",
        query="""SELECT a.run_id, round(least(1.0, 1e-11 + 1e-5 * coalesce(b.k, 0)), 12) AS t0
                 FROM (SELECT DISTINCT run_id FROM proposals) a
                 LEFT JOIN (SELECT run_id, min(k) AS k FROM ordered WHERE r / n > 0.65 GROUP BY run_id) b USING (run_id)""",
    ),
)
def starting_temperature(spark, sf_dir):
    out = R.starting_temperature(V.proposals(spark, sf_dir), F.col("min_length"))
    return out.select("run_id", F.round("t0", 12).alias("t0"))


FROZEN = {"max_accept": 3, "max_propose": 6}


@query(
    "frozen_runs",
    O.sql(
        _TRACE_ONCE, epochs_sql(**FROZEN),
        f"""per AS (SELECT run_id, epoch, count(*) AS proposed, sum(accepted) AS accepted FROM walk GROUP BY 1, 2),
            ended AS (SELECT *, accepted >= {FROZEN['max_accept']} AS ok FROM per
                      WHERE accepted >= {FROZEN['max_accept']} OR proposed >= {FROZEN['max_propose']}),
            isles AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY run_id ORDER BY epoch) AS isle FROM ended),
            runs_ AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, isle ORDER BY epoch) AS fails
                      FROM isles)""",
        recursive=True,
        query=f"""SELECT run_id, min(epoch) AS frozen_epoch FROM runs_
                  WHERE fails >= 4 AND {T0} * pow(0.99, epoch) < 0.00095 GROUP BY run_id""",
    ),
)
def frozen_runs(spark, sf_dir):
    epochs = R.epoch_table(R.cooling_epochs(V.trace(spark, sf_dir), **FROZEN), **FROZEN)
    rows = epochs.withColumn("t", R.temperature(F.lit(T0), F.col("epoch"), F.lit("G")))
    return R.frozen_runs(rows, max_fail=4, frozen_t=0.00095)


@query(
    "run_summary",
    O.sql(
        O.TRACE, _BEST,
        query="""SELECT run_id, count(*) AS rearrangements, arg_max(best_set_size, iter) AS topologies,
                        min(length) AS score, round(90 / min(length), 2) AS ci, round(1 - 90 / min(length), 2) AS hi
                 FROM sized GROUP BY run_id""",
    ),
)
def run_summary(spark, sf_dir):
    return R.run_summary(V.trace(spark, sf_dir), F.lit(90))


@query(
    "run_outputs",
    O.sql(
        O.TRACE, _BEST,
        query="""SELECT run_id, arg_min(length, iter) AS initial_length, min(length) AS best_length,
                        max(CASE WHEN is_new_best = 1 THEN iter END) AS best_iter,
                        arg_max(best_set_size, iter) AS trees, count(*) AS iterations
                 FROM sized GROUP BY run_id""",
    ),
)
def run_outputs(spark, sf_dir):
    return R.run_outputs(V.trace(spark, sf_dir))
