"""Registered queries over trees and rearrangements, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.catalog import oracle_views as O
from cladeframe.catalog import views as V
from cladeframe.catalog.registry import Registry
from cladeframe.functions import sequences as S
from cladeframe.functions import trees as T
from cladeframe.operators import moves, topology, trees
from cladeframe.operators.groups import with_group_value
from cladeframe.plans import enumerate as enum

registry = Registry()
query = registry.query
ID = ["tree_id"]


def joined(array) -> F.Column:
    return F.array_join(array.cast("array<string>"), ",")


def names6() -> F.Column:
    return F.array(*[F.lit(f"t{i}  ") for i in range(6)])


TREES = O.trees6()


@query(
    "sister",
    O.sql(
        TREES,
        query="""SELECT a.tree_id, a.branch, b.branch AS sister FROM branches a
                 JOIN branches b ON a.tree_id = b.tree_id AND a.parent = b.parent AND a.branch <> b.branch""",
    ),
)
def sister(spark, sf_dir):
    return trees.sisters(V.trees6(spark, sf_dir), ID)


@query(
    "descendants",
    O.sql(TREES, O.CLOSURE, recursive=True, query="SELECT tree_id, ancestor, descendant, depth FROM closure"),
)
def descendants(spark, sf_dir):
    return trees.descendants(V.trees6(spark, sf_dir), ID)


@query(
    "clade_sets",
    O.sql(
        TREES, O.CLOSURE, O.CLADES, recursive=True,
        query="SELECT tree_id, branch, size, array_to_string(members, ',') AS members FROM clades",
    ),
)
def clade_sets(spark, sf_dir):
    return trees.clade_sets(V.trees6(spark, sf_dir), ID).withColumn("members", joined(F.col("members")))


@query(
    "clade_sizes",
    O.sql(
        TREES, O.CLOSURE, recursive=True,
        query="""SELECT tree_id, ancestor AS branch, count(*) AS size FROM closure
                 WHERE descendant < 6 AND ancestor <> 0 GROUP BY 1, 2
                 UNION ALL SELECT tree_id, branch, 1 FROM branches WHERE branch BETWEEN 1 AND 5""",
    ),
)
def clade_sizes(spark, sf_dir):
    return trees.clade_sizes(V.trees6(spark, sf_dir), ID)


@query(
    "sort_clades",
    O.sql(
        TREES, O.CLOSURE, O.CLADES, recursive=True,
        query="""SELECT tree_id, string_agg(array_to_string(members, ','), '|' ORDER BY size, members) AS clades
                 FROM clades GROUP BY tree_id""",
    ),
)
def sort_clades(spark, sf_dir):
    t = trees.with_clades(V.trees6(spark, sf_dir))
    text = F.transform(T.sorted_clades(F.col("clades")), lambda c: joined(c["members"]))
    return t.select("tree_id", F.array_join(text, "|").alias("clades"))


@query(
    "topology_key",
    O.sql(TREES, O.CLOSURE, O.CLADES, O.keys(), recursive=True, query="SELECT tree_id, key FROM keys"),
)
def topology_key(spark, sf_dir):
    return trees.with_topology_key(V.trees6(spark, sf_dir), algorithm="md5").select("tree_id", "key")


@query(
    "same_topology",
    O.sql(
        TREES, O.CLOSURE, O.CLADES, O.keys(), recursive=True,
        query="""SELECT t.alignment_id, k.key, count(*) AS trees, min(t.tree_id) AS first_tree
                 FROM trees t JOIN keys k USING (tree_id) GROUP BY 1, 2""",
    ),
)
def same_topology(spark, sf_dir):
    t = trees.with_topology_key(V.trees6(spark, sf_dir), algorithm="md5")
    return topology.topology_classes(t, ["alignment_id"], "tree_id").withColumnRenamed("first", "first_tree")


@query("newick")
def newick(spark, sf_dir):
    return trees.with_newick(V.trees6(spark, sf_dir), names6()).select("tree_id", "newick")


def _newick_sql() -> str:
    """Text of the two shapes written out, children in branch order."""
    def pair(a: str, ka: str, b: str, kb: str) -> str:
        return f"CASE WHEN {ka} < {kb} THEN {a} || ',' || {b} ELSE {b} || ',' || {a} END"

    leaf = {i: f"'t' || l{i}" for i in range(1, 6)}
    u8 = f"('(' || {pair(leaf[4], 'l4', leaf[5], 'l5')} || ')')"
    u7 = f"('(' || {leaf[3]} || ',' || u8 || ')')"
    comb = f"'(t0,' || {leaf[1]} || ',(' || {leaf[2]} || ',' || u7 || '));'"
    split = f"'(t0,(' || {pair(leaf[1], 'l1', leaf[2], 'l2')} || '),' || u7 || ');'"
    return O.sql(
        TREES,
        f"a AS (SELECT *, {u8} AS u8 FROM trees)",
        f"b AS (SELECT *, {u7} AS u7 FROM a)",
        query=f"SELECT tree_id, CASE WHEN t % 2 = 0 THEN {comb} ELSE {split} END AS newick FROM b",
    )


registry.sql["newick"] = _newick_sql()


@query(
    "reroot",
    O.sql(
        TREES, O.CLOSURE,
        """path AS (SELECT tree_id, 3::BIGINT AS b, 0 AS k FROM trees UNION ALL
                    SELECT p.tree_id, b.parent, p.k + 1 FROM path p JOIN branches b ON b.tree_id = p.tree_id AND b.branch = p.b
                    WHERE b.parent >= 0),
           up AS (SELECT a.tree_id, a.b AS branch, coalesce(z.b, -1) AS parent
                  FROM path a LEFT JOIN path z ON z.tree_id = a.tree_id AND z.k = a.k - 1),
           sis AS (SELECT s.tree_id, s.branch, p.b AS parent FROM path p
                   JOIN branches o ON o.tree_id = p.tree_id AND o.branch = p.b
                   JOIN branches s ON s.tree_id = o.tree_id AND s.parent = o.parent AND s.branch <> o.branch),
           new AS (SELECT b.tree_id, b.branch, coalesce(u.parent, s.parent, b.parent) AS parent
                   FROM branches b LEFT JOIN up u USING (tree_id, branch) LEFT JOIN sis s USING (tree_id, branch))""",
        recursive=True,
        query="SELECT tree_id, string_agg(parent::VARCHAR, ',' ORDER BY branch) AS parent FROM new GROUP BY tree_id",
    ),
)
def reroot(spark, sf_dir):
    t = trees.reroot(V.trees6(spark, sf_dir), F.lit(3))
    return t.select("tree_id", joined(F.col("parent")).alias("parent"))


@query(
    "nni_neighbours",
    O.sql(
        TREES, O.TREE_ARRAYS,
        """kid AS (SELECT tree_id, parent AS branch, branch AS x,
                          row_number() OVER (PARTITION BY tree_id, parent ORDER BY branch) - 1 AS side
                   FROM branches WHERE parent >= 6),
           mv AS (SELECT k.tree_id, k.branch, k.side, k.x, u.parent AS v, c.branch AS c
                  FROM kid k JOIN branches u ON u.tree_id = k.tree_id AND u.branch = k.branch
                  JOIN branches c ON c.tree_id = k.tree_id AND c.parent = u.parent AND c.branch <> k.branch)""",
        query="""SELECT m.tree_id, m.branch, m.side,
                        string_agg((CASE b.branch WHEN m.x THEN m.v WHEN m.c THEN m.branch ELSE b.parent END)::VARCHAR,
                                   ',' ORDER BY b.branch) AS parent
                 FROM mv m JOIN branches b ON b.tree_id = m.tree_id GROUP BY m.tree_id, m.branch, m.side""",
    ),
)
def nni_neighbours(spark, sf_dir):
    return moves.nni_neighbours(V.trees6(spark, sf_dir), ID).withColumn("parent", joined(F.col("parent")))


SPR = """
mv AS (SELECT s.tree_id, s.branch AS src, s.parent AS up, z.branch AS sis, d.branch AS dest, d.parent AS dp, g.parent AS gp
       FROM branches s
       JOIN branches z ON z.tree_id = s.tree_id AND z.parent = s.parent AND z.branch <> s.branch
       JOIN branches g ON g.tree_id = s.tree_id AND g.branch = s.parent
       JOIN branches d ON d.tree_id = s.tree_id AND d.parent >= 0
       WHERE s.parent >= 6 AND d.branch NOT IN (s.branch, s.parent, z.branch)
         AND NOT EXISTS (SELECT 1 FROM closure c WHERE c.tree_id = s.tree_id AND c.ancestor = s.branch
                                                   AND c.descendant = d.branch))"""
# the destination is pruned with the old parent closed up first
SPR_CASE = "CASE b.branch WHEN m.dest THEN m.up WHEN m.up THEN m.dp WHEN m.sis THEN m.gp ELSE b.parent END"


@query("spr_moves", O.sql(TREES, O.CLOSURE, SPR, recursive=True, query="SELECT tree_id, src, dest FROM mv"))
def spr_moves(spark, sf_dir):
    return moves.spr_moves(V.trees6(spark, sf_dir), ID).select("tree_id", "src", "dest")


@query(
    "spr_neighbours",
    O.sql(
        TREES, O.CLOSURE, SPR, recursive=True,
        query=f"""SELECT m.tree_id, m.src, m.dest,
                         string_agg(({SPR_CASE})::VARCHAR, ',' ORDER BY b.branch) AS parent
                  FROM mv m JOIN branches b ON b.tree_id = m.tree_id GROUP BY m.tree_id, m.src, m.dest""",
    ),
)
def spr_neighbours(spark, sf_dir):
    return moves.spr_neighbours(V.trees6(spark, sf_dir), ID).withColumn("parent", joined(F.col("parent")))


# Re-rooting the moved subtree at a taxon: q(0) is that taxon, q(k) the moved branch.
TBR = """
below AS (SELECT tree_id, ancestor AS src, descendant AS leaf, depth FROM closure WHERE descendant < 6),
big AS (SELECT tree_id, src FROM below GROUP BY 1, 2 HAVING count(*) > 2),
tm AS (SELECT m.*, coalesce(w.leaf, -1) AS leaf, w.depth AS k
       FROM mv m LEFT JOIN big g ON g.tree_id = m.tree_id AND g.src = m.src
       LEFT JOIN below w ON w.tree_id = g.tree_id AND w.src = g.src AND w.depth > 1),
q AS (SELECT DISTINCT tree_id, src, leaf, leaf AS b, 0 AS j, k FROM tm WHERE leaf >= 0
      UNION ALL
      SELECT t.tree_id, t.src, t.leaf, c.ancestor, c.depth, t.k
      FROM (SELECT DISTINCT tree_id, src, leaf, k FROM tm WHERE leaf >= 0) t
      JOIN closure c ON c.tree_id = t.tree_id AND c.descendant = t.leaf AND c.depth <= t.k),
turn AS (SELECT a.tree_id, a.src, a.leaf, a.b AS branch, z.b AS parent FROM q a
         JOIN q z ON z.tree_id = a.tree_id AND z.src = a.src AND z.leaf = a.leaf AND z.j = a.j - 1 WHERE a.j >= 2
         UNION ALL
         SELECT a.tree_id, a.src, a.leaf, s.branch, z.b FROM q a
         JOIN branches o ON o.tree_id = a.tree_id AND o.branch = a.b
         JOIN branches s ON s.tree_id = o.tree_id AND s.parent = o.parent AND s.branch <> o.branch
         JOIN q z ON z.tree_id = a.tree_id AND z.src = a.src AND z.leaf = a.leaf AND z.j = a.j + 2
         WHERE a.j <= a.k - 2)"""


@query(
    "tbr_neighbours",
    O.sql(
        TREES, O.CLOSURE, SPR, TBR, recursive=True,
        query=f"""SELECT m.tree_id, m.src, m.dest, m.leaf,
                         string_agg((coalesce(u.parent, CASE WHEN f.b IS NOT NULL THEN m.up END, {SPR_CASE}))::VARCHAR, ','
                                    ORDER BY b.branch) AS parent
                  FROM tm m JOIN branches b ON b.tree_id = m.tree_id
                  LEFT JOIN turn u ON u.tree_id = m.tree_id AND u.src = m.src AND u.leaf = m.leaf AND u.branch = b.branch
                  LEFT JOIN q f ON f.tree_id = m.tree_id AND f.src = m.src AND f.leaf = m.leaf AND f.j = 1
                               AND f.b = b.branch
                  GROUP BY m.tree_id, m.src, m.dest, m.leaf""",
    ),
)
def tbr_neighbours(spark, sf_dir):
    return moves.tbr_neighbours(V.trees6(spark, sf_dir), ID).withColumn("parent", joined(F.col("parent")))


def portable_draw(*keys):
    """Draw in [0, 1) by integer arithmetic on up to two keys."""
    mixed = keys[0].cast("bigint") * 4099 + keys[1].cast("bigint")
    return S.congruential_draw(7, mixed)


_DRAW = """(((({0}) % 2147483648 * 1103515245 + 7 * 12345 + 12345) % 2147483648) * 48271 % 2147483647) / 2147483647.0::DOUBLE"""


def _slot_draw(add: int) -> str:
    return _DRAW.format(f"(tree_id * 4099 + slot + {add})")


@query(
    "propose_moves",
    O.sql(
        TREES, O.CLOSURE, SPR, TBR,
        f"""kid AS (SELECT tree_id, parent AS branch,
                           row_number() OVER (PARTITION BY tree_id, parent ORDER BY branch) - 1 AS side
                    FROM branches WHERE parent >= 6),
            offers AS (SELECT tree_id, 'NNI' AS move, branch AS a, side AS b, -1 AS c FROM kid
                       UNION ALL SELECT tree_id, 'SPR', src, dest, -1 FROM mv
                       UNION ALL SELECT tree_id, 'TBR', src, dest, leaf FROM tm),
            numbered AS (SELECT *, count(*) OVER (PARTITION BY tree_id, move) AS many,
                row_number() OVER (PARTITION BY tree_id, move ORDER BY a, CASE WHEN move = 'TBR' THEN c ELSE b END, b) - 1 AS number FROM offers),
            slots AS (SELECT tree_id, slot, CASE WHEN {_slot_draw(0)} < 0.4 THEN 'NNI' WHEN {_slot_draw(0)} < 0.7 THEN 'SPR' ELSE 'TBR' END AS move,
                      {_slot_draw(4)} AS u FROM trees CROSS JOIN (SELECT unnest(range(4)) AS slot))""",
        recursive=True,
        query="""SELECT s.tree_id, s.move, s.slot, n.a::INT AS a, n.b::INT AS b, n.c::INT AS c FROM slots s
                 JOIN numbered n ON n.tree_id = s.tree_id AND n.move = s.move AND n.number = floor(s.u * n.many)""",
    ),
)
def propose_moves(spark, sf_dir):
    t = V.trees6(spark, sf_dir)
    shares = t.select("tree_id", F.lit(0.4).alias("p_nni"), F.lit(0.3).alias("p_spr"))
    return moves.propose_moves(t, ID, shares, 4, portable_draw).drop("parent")


def _inserted(parent: str, taxon: int, dest: str, n: int) -> str:
    """SQL of a parent list with one more taxon on branch ``dest`` (0: the root taxon's)."""
    inner = n + taxon - 3
    return f"""list_transform({parent}, lambda p, i: CASE WHEN i - 1 = {taxon} THEN (CASE WHEN {dest} = 0 THEN 0 ELSE {inner} END)
        WHEN i - 1 = {inner} THEN (CASE WHEN {dest} = 0 THEN 0 ELSE {parent}[{dest} + 1] END)
        WHEN {dest} = 0 AND p = 0 THEN {inner} WHEN {dest} <> 0 AND i - 1 = {dest} THEN {inner} ELSE p END)"""


def _md5_draw(seed: int, *keys: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *(f"({k})::VARCHAR" for k in keys)])
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


_THREE = "[-1, 0, 0, -2, -2, -2, -2, -2, -2]"


def _random_sql(seed: int) -> list[str]:
    """Six taxa put in one by one, each on a drawn branch of those there; then labels in drawn order."""
    parts = [f"s2 AS (SELECT gid AS run_id, {_THREE} AS parent FROM grid GROUP BY gid)"]
    for taxon in (3, 4, 5):
        number = f"floor({_md5_draw(seed, 'run_id', str(taxon))} * {2 * taxon - 3})::INT"
        parts.append(f"d{taxon} AS (SELECT run_id, parent, {number} AS r FROM s{taxon - 1})")
        parts.append(f"e{taxon} AS (SELECT run_id, parent, CASE WHEN r < {taxon} THEN r ELSE 6 + r - {taxon} END AS dest FROM d{taxon})")
        parts.append(f"s{taxon} AS (SELECT run_id, {_inserted('parent', taxon, 'dest', 6)} AS parent FROM e{taxon})")
    parts.append(
        f"""drawn AS (SELECT run_id, i AS label, row_number() OVER (PARTITION BY run_id ORDER BY {_md5_draw(seed, 'run_id', 'i + 1000000')}, i) AS place
            FROM s5, (SELECT unnest(range(1, 6)) AS i))"""
    )
    parts.append(
        """cells AS (SELECT run_id, unnest(range(9)) AS place, unnest(parent) AS p FROM s5),
        named AS (SELECT c.run_id, coalesce(label, c.place) AS branch, p FROM cells c LEFT JOIN drawn USING (run_id, place))"""
    )
    return parts


@query(
    "random_topology",
    O.sql(
        O.vectors(6), *_random_sql(11),
        query="SELECT run_id, string_agg(p::VARCHAR, ',' ORDER BY branch) AS parent FROM named GROUP BY run_id",
    ),
)
def random_topology(spark, sf_dir):
    runs = V.vector_groups(spark, sf_dir, 6).select(F.col("gid").alias("run_id"), F.lit(6).alias("n"))
    t = enum.random_trees(runs, seed=11)
    return t.select("run_id", joined(F.col("parent")).alias("parent"))


def _every_sql() -> list[str]:
    """All trees of six taxa of every group: each taxon on each branch that is there."""
    parts = [f"t2 AS (SELECT gid::VARCHAR AS alignment_id, {_THREE} AS parent FROM grid GROUP BY gid)"]
    for taxon in (3, 4, 5):
        parts.append(
            f"""u{taxon} AS (SELECT alignment_id, parent, unnest(list_filter(range(9), lambda b: parent[b + 1] <> -2))::INT AS dest FROM t{taxon - 1}),
            t{taxon} AS (SELECT alignment_id, {_inserted('parent', taxon, 'dest', 6)} AS parent FROM u{taxon})"""
        )
    return parts


@query(
    "enumerate_topologies",
    O.sql(
        O.vectors(6), *_every_sql(),
        query="""SELECT alignment_id, array_to_string(parent, ',') AS parent, 105 AS topologies FROM t5""",
    ),
)
def enumerate_topologies(spark, sf_dir):
    """Every tree, and how many different topologies its group has by key."""
    runs = V.vector_groups(spark, sf_dir, 6).select(F.col("gid").cast("string").alias("alignment_id"))
    t = trees.with_topology_key(enum.enumerate_topologies(runs, 6))
    count = t.groupBy("alignment_id").agg(F.count_distinct("key").cast("int").alias("topologies"))
    return with_group_value(t, count, ["alignment_id"]).select("alignment_id", joined(F.col("parent")).alias("parent"), "topologies")


@query(
    "push_new_trees",
    O.sql(
        TREES, O.CLOSURE, O.CLADES, O.keys(), recursive=True,
        query="""SELECT t.alignment_id, k.key, min(t.tree_id) AS tree_id FROM trees t JOIN keys k USING (tree_id)
                 GROUP BY 1, 2 HAVING min(t.t % 2) = 1""",
    ),
)
def push_new_trees(spark, sf_dir):
    t = trees.with_topology_key(V.trees6(spark, sf_dir), algorithm="md5")
    known, offered = t.filter("t % 2 = 0"), t.filter("t % 2 = 1")
    fresh = topology.push_new(offered, known, ["alignment_id"], "tree_id")
    return fresh.select("alignment_id", "key", "tree_id")


@query(
    "latest_tree",
    O.sql(
        TREES, O.TREE_ARRAYS,
        query="""SELECT alignment_id, max(tree_id) AS tree_id, array_to_string(arg_max(parent, tree_id), ',') AS parent
                 FROM tree_arrays GROUP BY alignment_id""",
    ),
)
def latest_tree(spark, sf_dir):
    t = topology.latest(V.trees6(spark, sf_dir), ["alignment_id"], "tree_id")
    return t.select("alignment_id", "tree_id", joined(F.col("parent")).alias("parent"))


@query(
    "one_random_tree",
    O.sql(
        TREES,
        query=f"""SELECT alignment_id, arg_min(tree_id, {_DRAW.format('tree_id')}) AS tree_id
                  FROM trees GROUP BY alignment_id""",
    ),
)
def one_random_tree(spark, sf_dir):
    t = topology.one_random(V.trees6(spark, sf_dir), ["alignment_id"], S.congruential_draw(7, F.col("tree_id")))
    return t.select("alignment_id", "tree_id")
