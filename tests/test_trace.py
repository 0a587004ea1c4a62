import random

import pytest
from pyspark.sql import functions as F

from cladeframe.operators import trace as R


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for run, count in ((1, 700), (2, 31), (3, 1)):
        length = 90
        for i in range(1, count + 1):
            length = max(40, length + rng.choice([-2, -1, 0, 0, 0, 1, 2]))
            out.append((run, i, rng.choice(["NNI", "SPR", "TBR"]), int(rng.random() < 0.2), length))
    return out


@pytest.fixture(scope="module")
def trace(spark, rows):
    return spark.createDataFrame(rows, "run_id bigint, iter bigint, move string, accepted int, length bigint").cache()


def walk(rows, fn):
    """Apply ``fn(state dict, row)`` to the rows of each run in order."""
    out, run, state = {}, None, {}
    for r in rows:
        if r[0] != run:
            run, state = r[0], {}
        out[r[0], r[1]] = fn(state, r)
    return out


@pytest.mark.parametrize("size", [10, 64, 65536])
def test_running_best(trace, rows, size):
    def step(s, r):
        new = "best" not in s or r[4] < s["best"]
        if new:
            s["best"], s["n"] = r[4], 1
        elif r[4] == s["best"]:
            s["n"] += r[3]
        return s["best"], int(new), s["n"]

    got = {(r.run_id, r.iter): (r.running_best, r.is_new_best, r.best_set_size) for r in R.running_best(trace, size).collect()}
    assert got == walk(rows, step)


@pytest.mark.parametrize("size,fan", [(7, 4), (50, 256), (65536, 256)])
@pytest.mark.parametrize("limits", [(5, 2000), (3, 9), (2, 12)])
def test_cooling_epochs(trace, rows, size, fan, limits, monkeypatch):
    monkeypatch.setattr(R, "FAN", fan)

    def step(s, r):
        if s.get("ended"):
            s.update(e=s["e"] + 1, a=0, p=0)
        s.setdefault("e", 0)
        s["a"], s["p"] = s.get("a", 0) + r[3], s.get("p", 0) + 1
        s["ended"] = s["a"] >= limits[0] or s["p"] >= limits[1]
        return s["e"]

    got = {(r.run_id, r.iter): r.epoch for r in R.cooling_epochs(trace, *limits, size=size).collect()}
    assert got == walk(rows, step)


def test_pseudocounts(trace, rows):
    def step(s, r):
        c = s.setdefault("c", {"NNI": 1.0, "SPR": 1.0, "TBR": 1.0})
        before = (c["NNI"], c["SPR"], c["TBR"], int(sum(c.values())))
        for m in c:
            c[m] += (m == r[2]) if r[3] else 0.5 * (m != r[2])
        return before

    out = R.pseudocount_moves(trace, F.col("accepted") == 1, size=16).collect()
    assert {(r.run_id, r.iter): (r.count_nni, r.count_spr, r.count_tbr, r.total) for r in out} == walk(rows, step)


def test_positions(spark):
    df = spark.createDataFrame([(i % 3, i * 5) for i in range(200)], "run bigint, at bigint")
    got = {(r["run"], r["at"]): r["pos"] for r in R.positions(df, "run", "at", "pos", size=37).collect()}
    assert got == {(i % 3, i * 5): i // 3 + 1 for i in range(200)}


def test_frozen_runs(spark):
    rows = [(1, e, "limited", 1e-5) for e in range(50)] + [(2, e, "accepted" if e % 30 == 0 else "limited", 1e-5) for e in range(90)]
    rows += [(3, e, "limited", 1e-5 if e >= 45 else 1e-2) for e in range(60)]
    df = spark.createDataFrame(rows, "run_id bigint, epoch bigint, outcome string, t double")
    for size in (8, 65536):
        assert {r.run_id: r.frozen_epoch for r in R.frozen_runs(df, size=size).collect()} == {1: 39, 3: 45}


def test_starting_temperature_is_lowest_grid_value(spark):
    import math

    rng = random.Random(9)
    sample = [(1, 100 + rng.randrange(5), 100 + rng.randrange(20), rng.random()) for _ in range(400)] + [(2, 100, 90, 0.5)]
    df = spark.createDataFrame(sample, "run_id bigint, current_length bigint, proposed_length bigint, u double")
    got = {r.run_id: r.t0 for r in R.starting_temperature(df, F.lit(80)).collect()}
    assert got[2] == pytest.approx(1e-11)

    def ratio(t):
        worse = [(c, p, u) for r, c, p, u in sample if r == 1 and p > c]
        taken = sum(u < math.exp(-(80 / c - 80 / p) / t) and (80 / c - 80 / p) <= -t * math.log(1e-11) for c, p, u in worse)
        return taken / len(worse)

    assert ratio(got[1]) > 0.65 >= ratio(got[1] - 1e-5)


def test_move_probabilities(spark):
    df = spark.createDataFrame(
        [(0, 0, 0, "G"), (0, 1, 0, "G"), (1, 5, 0, "G"), (1, 5, 3, "G"), (1, 5, 3, "L")],
        "algorithm int, i bigint, epoch bigint, cooling string",
    )
    t = R.temperature(F.lit(0.5), F.col("epoch"), F.col("cooling"))
    p = R.move_probabilities(F.col("algorithm"), F.col("i"), F.col("epoch"), F.col("cooling"), t, F.lit(0.5))
    got = [tuple(round(x, 6) for x in r[0]) for r in df.select(p).collect()]
    hot = round(0.99**3, 6)
    assert got == [(1, 0, 0), (0, 1, 0), (0, 0, 1), (round((1 - 0.99**3) / 2, 6),) * 2 + (hot,), (0, 0, 1)]


def test_move_rules(spark):
    df = spark.createDataFrame([(100, 99, 0.99), (100, 101, 0.0), (100, 101, 0.9999)], "c int, p int, u double")
    hot = [r[0] for r in df.select(R.metropolis_accept(F.col("c"), F.col("p"), F.lit(90), F.lit(1.0), F.col("u"))).collect()]
    cold = [r[0] for r in df.select(R.metropolis_accept(F.col("c"), F.col("p"), F.lit(90), F.lit(1e-9), F.col("u"))).collect()]
    assert hot == [1, 1, 0] and cold == [1, 0, 0]
