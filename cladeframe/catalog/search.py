"""Registered searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.catalog import oracle_views as O
from cladeframe.catalog import views as V
from cladeframe.catalog.registry import Registry
from cladeframe.catalog.scoring import _STATE, _cost, _meet
from cladeframe.catalog.trees import joined
from cladeframe.operators import sites
from cladeframe.plans import search
from cladeframe.plans.enumerate import random_trees

registry = Registry()
query = registry.query
N = 10


def alignments(spark, sf_dir, n: int) -> DataFrame:
    return V.vector_groups(spark, sf_dir, n).select(F.col("gid").cast("string").alias("alignment_id"), F.lit(n).alias("n"))


def patterns(spark, sf_dir, n: int) -> DataFrame:
    return sites.site_patterns(V.vector_alignments(spark, sf_dir, n))


# Five taxa: a middle taxon and two pairs of the others, 15 trees.
_FIVE = ", ".join(
    f"({m}, {r[0]}, {r[i]}, {', '.join(str(x) for x in r[1:] if x != r[i])})"
    for m in range(5)
    for r in [[x for x in range(5) if x != m]]
    for i in (1, 2, 3)
)


@query(
    "exact_search",
    O.sql(
        O.vector_cells(5),
        f"""cols AS (SELECT alignment_id, site, list({_STATE} ORDER BY taxon_id) AS s FROM cells GROUP BY 1, 2),
            five(m, a, b, c, d) AS (VALUES {_FIVE}),
            x0 AS (SELECT alignment_id, m, a, b, c, d, s[a + 1] AS sa, s[b + 1] AS sb, s[c + 1] AS sc, s[d + 1] AS sd,
                          s[m + 1] AS sm FROM cols CROSS JOIN five),
            x1 AS (SELECT *, {_meet('sa', 'sb')} AS p, {_cost('sa', 'sb')} AS cp, {_meet('sc', 'sd')} AS q,
                          {_cost('sc', 'sd')} AS cq FROM x0),
            x2 AS (SELECT *, {_meet('p', 'q')} AS r, {_cost('p', 'q')} AS cr FROM x1),
            lens AS (SELECT alignment_id, m, a, b, c, d, CAST(sum(cp + cq + cr + {_cost('r', 'sm')}) AS BIGINT) AS length
                     FROM x2 GROUP BY ALL)""",
        query="""SELECT alignment_id, min(length) AS length, count(*) AS trees
                 FROM (SELECT *, rank() OVER (PARTITION BY alignment_id ORDER BY length) AS k FROM lens)
                 WHERE k = 1 GROUP BY alignment_id""",
    ),
)
def exact_search(spark, sf_dir):
    best = search.exact_search(alignments(spark, sf_dir, 5), patterns(spark, sf_dir, 5), 5)
    return best.groupBy("alignment_id").agg(F.min("length").alias("length"), F.count(F.lit(1)).alias("trees"))


@query("stepwise_trees")
def stepwise_trees(spark, sf_dir):
    best = search.stepwise_trees(alignments(spark, sf_dir, N), patterns(spark, sf_dir, N))
    return best.withColumn("parent", joined(F.col("parent")))


@query("hill_climb")
def hill_climb(spark, sf_dir):
    runs = alignments(spark, sf_dir, N).withColumn("run_id", F.col("alignment_id").cast("bigint"))
    starts = random_trees(runs, seed=3).select("run_id", "alignment_id", "parent")
    best = search.hill_climb(starts, patterns(spark, sf_dir, N), "spr")
    return best.withColumn("parent", joined(F.col("parent")))
