import duckdb
import pytest

import __spark_entry__ as entry
from cladeframe.catalog import all_queries, all_sql
from cladeframe.functions import sequences as S
from cladeframe.operators import moves, scoring, sites
from cladeframe.plans import search
from cladeframe.sources import alignments as A
from pyspark.sql import functions as F
from tests import helpers as H

TABLES = ("events", "documents", "embeddings")
QUICK = [
    "iupac_encode", "site_states", "excluded_sites", "minimum_tree_length", "site_patterns", "validate_counts",
    "random_topology", "enumerate_topologies", "read_alignments", "stream_best", "excluded_sites",
    "topology_key", "nni_neighbours", "tree_length", "ancestral_states", "count_best", "running_best",
    "starting_temperature", "stream_progress", "read_nexus", "branch_changes", "branch_table", "consistency_index",
    "propose_moves", "one_random_tree", "validate_all", "math_domain", "cut_constant_sites", "variable_sites", "cooling_epochs", "validate_lengths", "validate_limits",
    "validate_alphabet", "read_phylip", "write_trees", "uniform_draw", "best_set", "exact_search",
]


def test_every_query_but_searches_has_sql():
    queries, sql = all_queries(), all_sql()
    assert set(sql) <= set(queries)
    assert set(queries) - set(sql) == {"stepwise_trees", "hill_climb"}
    assert set(queries) <= set(entry.queries()) and set(sql) <= set(entry.oracle_sql())


def plain(value):
    return round(value, 8) if isinstance(value, float) else value


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    want = sorted(tuple(map(plain, r)) for r in want.fetchall())
    got = entry.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(map(plain, r)) for r in got.select(columns).collect()) == want


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5


def test_encoding(spark):
    letters = S.ACCEPTED + "EZ7 "
    df = spark.createDataFrame([("x", 0, "n", letters)], "alignment_id string, taxon_id int, name string, seq string")
    got = {r.base: r.state for r in sites.explode_sites(df).collect()}
    assert got == {c: H.STATE.get(c) for c in letters}


def test_draws(spark):
    df = spark.range(20000).select(S.uniform_draw(3, F.col("id")).alias("u"), S.integer_draw(S.congruential_draw(3, F.col("id")), 4).alias("k"))
    row = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= row[0] < 0.01 and 0.99 < row[1] < 1 and abs(row[2] - 0.5) < 0.02
    shares = {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    assert set(shares) == set(range(5)) and all(abs(v - 4000) < 400 for v in shares.values())


@pytest.fixture(scope="module")
def problem(spark):
    """Two alignments, of 6 and 7 taxa, and their shortest lengths by brute force."""
    texts = {
        "six": ["ACGTACGTAAC", "ACGAACCTAGC", "TCGTACGTNNC", "TTGTGCGTA-C", "GTGTGCGAARC", "GTCTGCGAAYC"],
        "seven": ["AACCGGTTAC", "AACCGGTTAG", "ATCCGATTAG", "ATCAGATCAG", "TTGAGATCTG", "TTGAGACCTT", "TAGAGACCTT"],
    }
    rows = [(k, i, f"t{i}", s) for k, v in texts.items() for i, s in enumerate(v)]
    seqs = spark.createDataFrame(rows, "alignment_id string, taxon_id int, name string, seq string")
    least = {}
    for k, v in texts.items():
        from cladeframe.plans.enumerate import enumerate_topologies
        every = enumerate_topologies(spark.range(1), len(v)).collect()
        least[k] = min(H.fitch(r.parent, H.columns_of(v)) for r in every)
    sizes = seqs.groupBy("alignment_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return seqs, sites.site_patterns(seqs), sizes, least


def test_searches_find_the_shortest(problem):
    seqs, patterns, sizes, least = problem
    runs = sizes.withColumn("run_id", F.length("alignment_id").cast("bigint"))
    steps = search.stepwise_trees(sizes, patterns)
    assert all(H.is_tree(r.parent) for r in steps.collect())
    starts = steps.join(runs, "alignment_id").select("run_id", "alignment_id", "parent")
    for neighbourhood in ("spr", "tbr"):
        climbed = search.hill_climb(starts, patterns, neighbourhood).collect()
        assert {r.alignment_id: r.length for r in climbed} == least
        assert len({(r.run_id, H.splits(r.parent)) for r in climbed}) == len(climbed)


def test_three_taxa_and_constant_alignments(spark):
    """An alignment of three taxa has its tree, one without variable columns has trees of length 0."""
    rows = [("three", i, f"t{i}", s) for i, s in enumerate(["ACG", "AGG", "TCG"])]
    rows += [("same", i, f"t{i}", "ACG") for i in range(4)]
    seqs = spark.createDataFrame(rows, "alignment_id string, taxon_id int, name string, seq string")
    sizes = seqs.groupBy("alignment_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    found = search.stepwise_trees(sizes, sites.site_patterns(sites.cut_constant_sites(seqs))).collect()
    assert {(r.alignment_id, r.length) for r in found} == {("three", 2), ("same", 0)}


def test_branch_changes_of_one_id_in_two_alignments(spark):
    rows = [(a, i, f"t{i}", s) for a in "xy" for i, s in enumerate(["AA", "AC", "CC", "CA"])]
    seqs = spark.createDataFrame(rows, "alignment_id string, taxon_id int, name string, seq string")
    trees = spark.createDataFrame([("x", 1, [-1, 4, 4, 0, 0]), ("y", 1, [-1, 4, 4, 0, 0])], "alignment_id string, tree_id long, parent array<int>")
    found = scoring.branch_changes(trees, sites.site_patterns(seqs), ["tree_id"]).collect()
    by = {a: sorted((r.branch, r.changes) for r in found if r.alignment_id == a) for a in "xy"}
    whole = {r.alignment_id: r.length for r in scoring.tree_length(trees, sites.site_patterns(seqs), ["tree_id"]).collect()}
    assert by["x"] == by["y"] and {a: sum(c for _, c in v) for a, v in by.items()} == whole


def test_draw_of_large_keys(spark):
    df = spark.createDataFrame([(2**31 + 5,), (2**62,), (5,)], "k long").select(S.congruential_draw(7, F.col("k")).alias("u"))
    a, b, c = [r.u for r in df.collect()]
    assert a == c and 0 <= b < 1


def test_trees_and_patterns_must_have_the_same_taxa(spark):
    seqs = spark.createDataFrame([("x", i, f"t{i}", s) for i, s in enumerate(["AA", "AC", "CC", "CA", "GA", "GC"])],
                                 "alignment_id string, taxon_id int, name string, seq string")
    trees = spark.createDataFrame([("x", 1, H.topologies(5)[0])], "alignment_id string, tree_id long, parent array<int>")
    for measure in (scoring.tree_length, scoring.fitch_site_length):
        with pytest.raises(Exception, match="differ in their taxa"):
            measure(trees, sites.site_patterns(seqs), ["tree_id"]).collect()


def test_slots_without_a_move_stay(spark):
    tree = spark.createDataFrame([(1, H.topologies(5)[3])], "tree_id long, parent array<int>")
    shares = tree.select("tree_id", F.lit(1.0).alias("p_nni"), F.lit(0.0).alias("p_spr"))
    draw = lambda *keys: S.uniform_draw(5, *keys)
    found = moves.propose_moves(tree, ["tree_id"], shares, 8, draw).collect()
    assert sorted(r.slot for r in found) == list(range(8)) and {r.move for r in found} == {"NNI"}
    near = {(r.branch, r.side): r.parent for r in moves.nni_neighbours(tree, ["tree_id"]).collect()}
    assert all(near[r.a, r.b] == r.parent for r in found)
    # three taxa have no moves, five no interchange beyond four
    three = spark.createDataFrame([(9, [-1, 0, 0])], "tree_id long, parent array<int>")
    none = moves.propose_moves(three, ["tree_id"], three.select("tree_id", F.lit(0.4).alias("p_nni"), F.lit(0.3).alias("p_spr")), 3, draw).collect()
    assert len(none) == 3 and all(r.a is None and r.parent == [-1, 0, 0] for r in none)


def test_trees_and_traces_are_written_by_run(spark, tmp_path):
    trees = spark.createDataFrame([(7, "x", H.topologies(4)[0]), (8, "x", H.topologies(4)[1])], "run_id long, alignment_id string, parent array<int>")
    seqs = spark.createDataFrame([("x", i, c, "A") for i, c in enumerate("abcd")], "alignment_id string, taxon_id int, name string, seq string")
    named = trees.join(A.taxon_names(seqs), "alignment_id")
    A.write_trees(named, F.col("names"), str(tmp_path / "trees"), ["run_id", "alignment_id"])
    lines = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "trees")).collect()]
    assert sorted(x[:2] for x in lines) == [["7", "x"], ["8", "x"]] and all(c in x[2] for x in lines for c in "abcd")
    rows = spark.createDataFrame([(r, i, r * i) for r in (1, 2) for i in range(3)], "run_id long, Iteration long, Length long")
    A.write_trace(rows, str(tmp_path / "trace"), ["run_id"])
    rows.write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows"))
    A.stream_trace(stream, str(tmp_path / "live"), str(tmp_path / "state"), ["run_id"]).awaitTermination()
    for place in ("trace", "live"):
        back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / place))
        assert sorted((int(r.run_id), int(r.Iteration), int(r.Length)) for r in back.collect()) == sorted(map(tuple, rows.collect()))
