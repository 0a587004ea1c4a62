"""Registered queries over tree scores and best sets, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.catalog import oracle_views as O
from cladeframe.catalog import views as V
from cladeframe.catalog.registry import Registry
from cladeframe.catalog.trees import joined
from cladeframe.operators import scoring, sites, topology, trace, trees

registry = Registry()
query = registry.query
ID = ["tree_id"]

_STATE = "CASE base WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 ELSE 15 END"
_HEX = f"substr('0123456789ABCDEF', {_STATE} + 1, 1)"


def _meet(a: str, b: str) -> str:
    return f"CASE WHEN {a} & {b} <> 0 THEN {a} & {b} ELSE {a} | {b} END"


def _cost(a: str, b: str) -> str:
    return f"CASE WHEN {a} & {b} = 0 THEN 1 ELSE 0 END"


PATTERNS = O.vector_cells(6) + f""",
columns_ AS (SELECT alignment_id, site, string_agg({_HEX}, '' ORDER BY taxon_id) AS pattern,
                    list({_STATE} ORDER BY taxon_id) AS s FROM cells GROUP BY alignment_id, site),
patterns AS (SELECT alignment_id, pattern, any_value(s) AS s, count(*) AS weight
             FROM columns_ GROUP BY alignment_id, pattern)"""
_TREES = O.trees6()
# the two views share their first tables
_TREES_ONLY = _TREES[_TREES.index("ranked AS"):]

# One step after another: branch 8, 7, 6, the root's children, the root taxon.
FITCH = f"""
f0 AS (SELECT t.alignment_id, t.tree_id, t.t, p.pattern, p.weight, s[1] AS s0, s[l1 + 1] AS a1, s[l2 + 1] AS a2,
              s[l3 + 1] AS a3, s[l4 + 1] AS a4, s[l5 + 1] AS a5 FROM trees t JOIN patterns p USING (alignment_id)),
f8 AS (SELECT *, {_meet('a4', 'a5')} AS s8, {_cost('a4', 'a5')} AS c8 FROM f0),
f7 AS (SELECT *, {_meet('a3', 's8')} AS s7, {_cost('a3', 's8')} AS c7 FROM f8),
f6 AS (SELECT *, CASE WHEN t % 2 = 0 THEN {_meet('a2', 's7')} ELSE {_meet('a1', 'a2')} END AS s6,
              CASE WHEN t % 2 = 0 THEN {_cost('a2', 's7')} ELSE {_cost('a1', 'a2')} END AS c6 FROM f7),
fr AS (SELECT *, CASE WHEN t % 2 = 0 THEN {_meet('a1', 's6')} ELSE {_meet('s6', 's7')} END AS sr,
              CASE WHEN t % 2 = 0 THEN {_cost('a1', 's6')} ELSE {_cost('s6', 's7')} END AS cr FROM f6),
fitch AS (SELECT *, cr + {_cost('sr', 's0')} AS c0 FROM fr),
lengths AS (SELECT alignment_id, tree_id, CAST(sum(weight * (c8 + c7 + c6 + c0)) AS BIGINT) AS length
            FROM fitch GROUP BY alignment_id, tree_id)"""
MIN_LEN = """
least AS (SELECT alignment_id, CAST(sum(CASE WHEN k > 5 THEN 5 ELSE k - 1 END) AS BIGINT) AS min_len
          FROM (SELECT alignment_id, site, count(DISTINCT CASE WHEN base <> '?' THEN base END) AS k
                FROM cells GROUP BY alignment_id, site HAVING min(base) <> max(base)) GROUP BY alignment_id)"""


def patterns6(spark, sf_dir):
    return sites.site_patterns(V.vector_alignments(spark, sf_dir, 6))


def trees6(spark, sf_dir):
    return V.trees6(spark, sf_dir).drop("t")


def scored6(spark, sf_dir):
    return scoring.tree_length(trees6(spark, sf_dir), patterns6(spark, sf_dir), ID)


@query(
    "fitch_site_length",
    O.sql(
        PATTERNS, _TREES_ONLY, FITCH,
        query="SELECT alignment_id, tree_id, pattern, weight, c8 + c7 + c6 + c0 AS changes FROM fitch",
    ),
)
def fitch_site_length(spark, sf_dir):
    return scoring.fitch_site_length(trees6(spark, sf_dir), patterns6(spark, sf_dir), ID)


@query(
    "tree_length",
    O.sql(PATTERNS, _TREES_ONLY, FITCH, query="SELECT alignment_id, tree_id, length FROM lengths"),
)
def tree_length(spark, sf_dir):
    return scored6(spark, sf_dir).select("alignment_id", "tree_id", "length")


@query(
    "branch_changes",
    O.sql(
        PATTERNS, _TREES_ONLY, FITCH,
        query="""SELECT alignment_id, tree_id, branch, CAST(sum(c * weight) AS BIGINT) AS changes
                 FROM (SELECT alignment_id, tree_id, weight, unnest([0, 6, 7, 8]) AS branch, unnest([c0, c6, c7, c8]) AS c FROM fitch)
                 GROUP BY alignment_id, tree_id, branch""",
    ),
)
def branch_changes(spark, sf_dir):
    return scoring.branch_changes(trees6(spark, sf_dir), patterns6(spark, sf_dir), ID)


@query(
    "branch_table",
    O.sql(
        PATTERNS, _TREES_ONLY, FITCH,
        """changes AS (SELECT tree_id, branch, sum(c * weight) AS c FROM (
               SELECT tree_id, weight, unnest([0, 6, 7, 8]) AS branch, unnest([c0, c6, c7, c8]) AS c FROM fitch)
               GROUP BY tree_id, branch)""",
        query="""SELECT b.tree_id, b.branch, b.parent, coalesce(min(k.branch), -1) AS left,
                        coalesce(max(k.branch), -1) AS right, CAST(coalesce(any_value(c.c), 0) AS BIGINT) AS changes
                 FROM branches b LEFT JOIN branches k ON k.tree_id = b.tree_id AND k.parent = b.branch
                 LEFT JOIN changes c ON c.tree_id = b.tree_id AND c.branch = b.branch
                 GROUP BY b.tree_id, b.branch, b.parent""",
    ),
)
def branch_table(spark, sf_dir):
    rows = trees.branch_table(trees6(spark, sf_dir), ["alignment_id", *ID])
    changes = scoring.branch_changes(trees6(spark, sf_dir), patterns6(spark, sf_dir), ID)
    joined_rows = rows.join(changes, ["alignment_id", *ID, "branch"], "left").fillna(0, ["changes"])
    return joined_rows.drop("alignment_id")


@query(
    "ancestral_states",
    O.sql(
        PATTERNS, _TREES_ONLY, FITCH,
        query="""SELECT alignment_id, tree_id, pattern, unnest([6, 7, 8]) AS branch, unnest([s6, s7, s8]) AS state
                 FROM fitch""",
    ),
)
def ancestral_states(spark, sf_dir):
    return scoring.ancestral_states(trees6(spark, sf_dir), patterns6(spark, sf_dir), ID)


@query(
    "consistency_index",
    O.sql(
        PATTERNS, _TREES_ONLY, FITCH, MIN_LEN,
        query="""SELECT alignment_id, tree_id, length, min_len, round(min_len / length, 2) AS ci,
                        round(1 - min_len / length, 2) AS hi FROM lengths JOIN least USING (alignment_id)""",
    ),
)
def consistency_index(spark, sf_dir):
    scored = scored6(spark, sf_dir).select("alignment_id", "tree_id", "length")
    return scoring.consistency_index(scored, sites.minimum_tree_length(V.vector_alignments(spark, sf_dir, 6)))


@query(
    "best_set",
    O.sql(
        PATTERNS, _TREES_ONLY, O.TREE_ARRAYS, FITCH,
        query="""SELECT l.alignment_id, l.tree_id, l.length, array_to_string(a.parent, ',') AS parent
                 FROM (SELECT *, rank() OVER (PARTITION BY alignment_id ORDER BY length) AS r FROM lengths) l
                 JOIN tree_arrays a USING (tree_id) WHERE r = 1""",
    ),
)
def best_set(spark, sf_dir):
    best = topology.best_set(scored6(spark, sf_dir), ["alignment_id"])
    return best.withColumn("parent", joined(F.col("parent")))


@query(
    "count_best",
    O.sql(
        PATTERNS, _TREES_ONLY, O.CLOSURE, O.CLADES, O.keys(), FITCH, recursive=True,
        query="""SELECT alignment_id, length, count(DISTINCT key) AS topologies
                 FROM (SELECT *, rank() OVER (PARTITION BY alignment_id ORDER BY length) AS r FROM lengths)
                 JOIN keys USING (tree_id) WHERE r = 1 GROUP BY alignment_id, length""",
    ),
)
def count_best(spark, sf_dir):
    return topology.count_best(scored6(spark, sf_dir), ["alignment_id"])


@query(
    "cap_trees",
    O.sql(
        PATTERNS, _TREES_ONLY, FITCH,
        query="""SELECT alignment_id, tree_id FROM (
                   SELECT *, row_number() OVER (PARTITION BY alignment_id ORDER BY tree_id) AS n FROM (
                     SELECT *, rank() OVER (PARTITION BY alignment_id ORDER BY length) AS r FROM lengths) WHERE r = 1)
                 WHERE n <= 2""",
    ),
)
def cap_trees(spark, sf_dir):
    best = topology.best_set(scored6(spark, sf_dir), ["alignment_id"])
    return topology.cap_trees(best, ["alignment_id"], "tree_id", 2).select("alignment_id", "tree_id")


@query(
    "energy_delta",
    O.sql(
        O.PROPOSALS,
        query="""SELECT proposal_id, round(least(1.0, min_length / current_length - min_length / proposed_length), 12)
                        AS delta FROM proposals""",
    ),
)
def energy_delta(spark, sf_dir):
    delta = trace.energy_delta(F.col("current_length"), F.col("proposed_length"), F.col("min_length"))
    return V.proposals(spark, sf_dir).select("proposal_id", F.round(delta, 12).alias("delta"))
