"""The derived views as common table expressions for another SQL engine."""

from __future__ import annotations

from cladeframe.catalog.views import SHAPES6

BASE = "CASE WHEN x < -0.085 THEN 'A' WHEN x < 0 THEN 'C' WHEN x < 0.085 THEN 'G' ELSE 'T' END"


def vectors(k: int) -> str:
    """``grid(gid, taxon, embedding)``: all k places of every group."""
    return f"""
emb AS (SELECT vec_id // {k} AS gid, vec_id % {k} AS taxon, embedding FROM embeddings),
grid AS (SELECT g.gid, r.taxon, e.embedding
         FROM (SELECT DISTINCT gid FROM emb) g CROSS JOIN (SELECT unnest(range({k})) AS taxon) r
         LEFT JOIN emb e ON e.gid = g.gid AND e.taxon = r.taxon)"""


def vector_cells(k: int) -> str:
    """``cells(alignment_id, taxon_id, site, base)``."""
    return vectors(k) + f""",
cells AS (SELECT gid::VARCHAR AS alignment_id, taxon AS taxon_id, site,
                 CASE WHEN x IS NULL THEN '?' ELSE {BASE} END AS base
          FROM (SELECT gid, taxon, s.site AS site, embedding[s.site + 1] AS x
                FROM grid CROSS JOIN (SELECT unnest(range(64)) AS site) s))"""


def vector_alignments(k: int) -> str:
    """``aln(alignment_id, taxon_id, name, seq)``."""
    return vector_cells(k) + f""",
aln AS (SELECT alignment_id, taxon_id, 'v' || (alignment_id::BIGINT * {k} + taxon_id) AS name,
               string_agg(base, '' ORDER BY site) AS seq
        FROM cells GROUP BY alignment_id, taxon_id)"""


RAW = """
pieces AS (SELECT doc_id, regexp_extract_all(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '.{1,64}') AS p
           FROM documents),
raw AS (SELECT doc_id::VARCHAR AS alignment_id, i AS taxon_id, 'line' || i AS name, p[i + 1] AS seq
        FROM (SELECT doc_id, p, unnest(range(len(p))) AS i FROM pieces))"""

DOC = RAW + """,
doc AS (SELECT alignment_id, taxon_id, name,
               rpad(translate(seq, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTNACGTACRYTACGT-GTA'), 64, '?') AS seq
        FROM raw)"""

DOC_CELLS = DOC + """,
cells AS (SELECT alignment_id, taxon_id, s.site AS site, substr(seq, s.site + 1, 1) AS base
          FROM doc CROSS JOIN (SELECT unnest(range(64))::INTEGER AS site) s),
cols AS (SELECT alignment_id, site, min(base) <> max(base) AS variable,
                count(DISTINCT CASE WHEN base NOT IN ('-', '?', 'N', 'X') THEN base END) AS k
         FROM cells GROUP BY alignment_id, site)"""


def trees6() -> str:
    """``trees(alignment_id, tree_id, t, l1..l5)`` and ``branches(alignment_id, tree_id, branch, parent)``."""
    def rows(shape: str) -> str:
        inner, leaves = SHAPES6[shape]["inner"], SHAPES6[shape]["leaves"]
        pairs = [(f"l{i + 1}", p) for i, p in enumerate(leaves)] + [(str(6 + i), p) for i, p in enumerate(inner)]
        return "[{branch: 0, parent: -1}, " + ", ".join(f"{{branch: {b}, parent: {p}}}" for b, p in pairs) + "]"

    return vectors(6) + f""",
ranked AS (SELECT gid, s.t AS t, taxon,
                  row_number() OVER (PARTITION BY gid, s.t ORDER BY coalesce(embedding[s.t + 1], 0), taxon) AS rk
           FROM grid CROSS JOIN (SELECT unnest(range(64)) AS t) s WHERE taxon <> 0),
trees AS (SELECT gid::VARCHAR AS alignment_id, gid * 64 + t AS tree_id, t,
                 {', '.join(f'max(CASE WHEN rk = {i} THEN taxon END) AS l{i}' for i in range(1, 6))}
          FROM ranked GROUP BY gid, t),
branches AS (SELECT alignment_id, tree_id, t, b.branch AS branch, b.parent AS parent
             FROM (SELECT alignment_id, tree_id, t,
                          unnest(CASE WHEN t % 2 = 0 THEN {rows('comb')} ELSE {rows('split')} END) AS b FROM trees))"""


TREE_ARRAYS = """
tree_arrays AS (SELECT alignment_id, tree_id, t, list(parent ORDER BY branch) AS parent
                FROM branches GROUP BY alignment_id, tree_id, t)"""

CLOSURE = """
closure AS (SELECT tree_id, parent AS ancestor, branch AS descendant, 1 AS depth FROM branches WHERE parent >= 0
            UNION ALL
            SELECT c.tree_id, b.parent, c.descendant, c.depth + 1
            FROM closure c JOIN branches b ON b.tree_id = c.tree_id AND b.branch = c.ancestor WHERE b.parent >= 0)"""

CLADES = """
clades AS (SELECT tree_id, ancestor AS branch, count(*) AS size, list(descendant ORDER BY descendant) AS members
           FROM closure WHERE descendant < 6 AND ancestor >= 6 GROUP BY tree_id, ancestor)"""


def keys(clades: str = "clades", group: str = "tree_id") -> str:
    """``keys(<group>, key)``: md5 of the canonical clade text."""
    return f"""
numbered AS (SELECT {group}, size, members,
                    row_number() OVER (PARTITION BY {group} ORDER BY size, members) - 1 AS i FROM {clades}),
keys AS (SELECT {group},
                md5(string_agg(i || '    ' || size || '    '
                    || list_aggregate(list_transform(members, lambda m: m || '   '), 'string_agg', '') || chr(10),
                    '' ORDER BY i)) AS key
         FROM numbered GROUP BY {group})"""


TRACE = """
trace AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS iter, ts,
                 CASE event_id % 3 WHEN 0 THEN 'NNI' WHEN 1 THEN 'SPR' ELSE 'TBR' END AS move,
                 CAST((event_id * 7919 + 13) % 1000 < 300 AS INTEGER) AS accepted,
                 100 + CAST(floor(value) AS BIGINT) % 50 AS length,
                 CAST(user_id % 3 AS INTEGER) AS algorithm,
                 CASE WHEN user_id % 2 = 0 THEN 'G' ELSE 'L' END AS cooling,
                 ((event_id * 7919 + 13) % 1000) / 1000.0::DOUBLE AS u, event_id AS seq
          FROM events)"""

PROPOSALS = """
proposals AS (SELECT event_id AS proposal_id, user_id AS run_id,
                     100 + CAST(floor(value) AS BIGINT) % 50 AS current_length,
                     100 + CAST(floor(value) AS BIGINT) % 50 + event_id % 11 - 3 AS proposed_length,
                     90 AS min_length, (event_id % 97 + 1) / 1000.0::DOUBLE AS temperature,
                     ((event_id * 7919 + 13) % 1000) / 1000.0::DOUBLE AS u
              FROM events)"""

SCORED = """
scored AS (SELECT user_id AS run_id, event_id AS seq,
                  md5(event_type || '-' || CAST(floor(value) AS BIGINT)) AS key,
                  100 + CAST(floor(value) AS BIGINT) % 50 AS length, ts
           FROM events)"""


def sql(*views: str, query: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(v.strip() for v in views)}\n{query}"
