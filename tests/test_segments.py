"""Long alignments as blocks of columns."""

import random

import pytest
from pyspark.sql import functions as F

from cladeframe.operators import sites


def alignment(seed, n, m, constant):
    draw = random.Random(seed)
    columns = [["A"] * n if draw.random() < constant else [draw.choice("ACGT-") for _ in range(n)] for _ in range(m)]
    return ["".join(c[i] for c in columns) for i in range(n)]


@pytest.fixture(scope="module")
def texts():
    return {"x": alignment(1, 7, 500, 0.6), "y": alignment(2, 30, 64, 0.2), "z": ["ACGT" * 30] * 5}


@pytest.fixture
def rows(spark, texts):
    return spark.createDataFrame(
        [(a, i, f"t{i}", s) for a, v in texts.items() for i, s in enumerate(v)], "alignment_id string, taxon_id int, name string, seq string"
    ).repartition(3)


@pytest.fixture(params=[sites.PIECE, 16, 1])
def piece(request, monkeypatch, spark):
    monkeypatch.setattr(sites, "PIECE", request.param)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    yield request.param
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def variable(v):
    return [j for j in range(len(v[0])) if len({s[j] for s in v}) > 1]


def test_blocks_are_bounded(rows, texts, piece):
    kept = sites.kept_columns(rows).collect()
    assert max(len(r.keep) for r in kept) <= piece
    for a, v in texts.items():
        own = sorted((r for r in kept if r.alignment_id == a), key=lambda r: r.first)
        assert [r.first for r in own] == list(range(0, len(v[0]), piece))
        assert {(r.original_m, r.m) for r in own} == {(len(v[0]), len(variable(v)))}
        assert [j for j, k in enumerate(k for r in own for k in r.keep) if k] == variable(v)


def test_cut(rows, texts, piece):
    got = {(r.alignment_id, r.taxon_id): r for r in sites.cut_constant_sites(rows).collect()}
    assert len(got) == sum(map(len, texts.values()))
    for a, v in texts.items():
        for i, s in enumerate(v):
            r = got[a, i]
            assert (r.seq, r.name, r.original_m, r.m) == ("".join(s[j] for j in variable(v)), f"t{i}", len(s), len(variable(v)))


def test_excluded(rows, texts, piece):
    got = {}
    for r in sites.excluded_sites(rows).orderBy("alignment_id", "line").collect():
        numbers = r.columns.split("\t")
        assert len(numbers) <= 8 and r.line == len(got.setdefault(r.alignment_id, [])) // 8
        got[r.alignment_id] += map(int, numbers)
        assert r.n_excluded == len(texts[r.alignment_id][0]) - len(variable(texts[r.alignment_id]))
    assert got == {a: [j + 1 for j in range(len(v[0])) if j not in set(variable(v))] for a, v in texts.items()}


def test_patterns_of_blocks(rows, texts, piece, monkeypatch):
    monkeypatch.setattr(sites, "BLOCK", 100)
    got = sites.site_patterns(rows).groupBy("alignment_id").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("c")).collect()
    want = {a: (len(v[0]), len({tuple(s[j] for s in v) for j in range(len(v[0]))})) for a, v in texts.items()}
    assert {r.alignment_id: (r.w, r.c) for r in got} == want


def test_ragged_rows(spark):
    rows = spark.createDataFrame(
        [("r", 0, "a", "ACGTT"), ("r", 1, "b", "ACC"), ("r", 2, "c", ""), ("e", 0, "a", "")], "alignment_id string, taxon_id int, name string, seq string"
    )
    got = {(r.alignment_id, r.taxon_id): r.seq for r in sites.cut_constant_sites(rows).collect()}
    assert got == {("r", 0): "G", ("r", 1): "C", ("r", 2): ""}


ROWS = "alignment_id string, taxon_id int, name string, seq string"


def odd_rows():
    draw = random.Random(4)
    rows = [(f"a{a}", i, f"n{i}", "".join(draw.choice("AC-T9é") for _ in range(draw.choice([0, 5, 9])))) for a in range(40) for i in range(a % 6)]
    rows += [("twice", 0, "n", "ACGT"), ("twice", 0, "n", "ACCT"), ("twice", 1, "n", "TCGT"), ("twice", 1, "n", None), ("gone", 0, "n", None)]
    rows += [("none", None, None, "AC"), ("none", None, None, "GC"), ("none", 0, None, "TT"), ("empty", 0, "n", "")]
    return rows


@pytest.mark.parametrize("together", [1, 40, 1 << 20])
def test_whole_alignments_are_cut_as_by_pieces(spark, monkeypatch, together):
    monkeypatch.setattr(sites, "TOGETHER", together)
    rows = spark.createDataFrame(odd_rows(), ROWS).repartition(3)
    want = sorted(map(repr, sites._cut_pieces(rows).collect()))
    for whole in (sites.WHOLE, 30, 0):
        monkeypatch.setattr(sites, "WHOLE", whole)
        assert sorted(map(repr, sites.cut_constant_sites(rows).collect())) == want


def test_sequences_need_an_alignment(spark):
    with pytest.raises(Exception, match="without an alignment_id"):
        sites.cut_constant_sites(spark.createDataFrame([*odd_rows(), (None, 0, "n", "AC")], ROWS)).collect()


def test_small_alignments_meet_once(spark):
    rows = spark.createDataFrame([r for r in odd_rows() if r[0] != "none"], ROWS)
    plan = sites.cut_constant_sites(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
