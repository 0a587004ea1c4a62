"""The filter audit against brute force over all orders."""

import math
import re
from fractions import Fraction
from itertools import combinations, permutations

import pytest

from cladeframe.llm import filter_audit as A

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fails int, part string, digest string"
GOOD = " ".join(f"w{i}" for i in range(120))
#: NULLs in every column, empty and very long texts, ties, repeated rows, a text in several parts, clashing names.
ROWS = [
    (1, GOOD, "en"), (2, GOOD, "de"), (2, GOOD, "de"), (3, GOOD, None), (4, None, "en"), (5, "", "en"), (6, "", None),
    (7, "ABC # x", "de"), (None, GOOD, "en"), (None, None, None), (8, "same " * 200, "fr"), (9, GOOD.upper() + " ü", "fr"),
    (10, "x| " * 150000, "fr"), (11, " ".join(f"ä{i}\t\n" for i in range(300)), ""), (0, GOOD, "fr"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (7, None, 1), (None, 1, 1), (8, 0, 1), (99, 1, 1), (9, 1, 0)]


def brute(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    documents = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t],
        }
        documents.append((lang or "", {c for c, f in fails.items() if f}, i in good, i in toxic))
    out = set()
    for part in {d[0] for d in documents}:
        mine = [d for d in documents if d[0] == part]
        removed_by, found = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            here = mine
            for step, c in enumerate(order, 1):
                gone, kept = [d for d in here if c in d[1]], [d for d in here if c not in d[1]]
                removed_by[c] += len(gone)
                found.append((
                    "".join(order), step, len(kept), len(gone), sum(c in d[1] for d in mine) - len(gone),
                    sum(d[1] == {c} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone), c,
                ))
                here = kept
        out |= {(part, *f[:-1], removed_by[f[-1]]) for f in found}
    return out


def test_audit_by_brute_force(spark):
    docs = spark.createDataFrame([(i, t, lang, None, None, 3, "mine", "mine") for i, t, lang in ROWS], SCHEMA)
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    got = A.audit(A.document_failures(docs, labels)).collect()
    assert len(got) == 600 * 4
    assert {tuple(r) for r in got} == brute(ROWS, LABELS)


def test_one_text_and_one_id_on_most_rows(spark):
    rows = [(7, GOOD, "en")] * 200 + [(i, GOOD, "en" if i % 2 else "de") for i in range(300)] + [(7, f"{GOOD} {i}", "en") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    assert {tuple(r) for r in A.audit(A.document_failures(docs, labels)).collect()} == brute(rows, LABELS)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang in ROWS], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    assert A.audit(A.document_failures(docs.limit(0), labels)).count() == 0
    assert {tuple(r) for r in A.audit(A.document_failures(docs, labels.limit(0))).collect()} == brute(ROWS, [])


@pytest.mark.parametrize("m", [2, 3, 5])
def test_least_squares_is_the_shapley_value(m):
    """Weights by the formula of marginal contributions."""
    for i, row in enumerate(A.shapley_weights(m)):
        want = [0] * (1 << m)
        others = [j for j in range(m) if j != i]
        for size in range(m):
            w = math.factorial(size) * math.factorial(m - size - 1)
            for s in combinations(others, size):
                mask = sum(1 << j for j in s)
                want[mask | 1 << i] += w
                want[mask] -= w
        # v of the empty coalition is 0 and carries no weight in the equations
        assert row[1:] == want[1:]
    assert isinstance(sum(map(Fraction, A.shapley_weights(m)[0])), Fraction)


def test_other_filters(spark):
    sets = spark.createDataFrame([("x", 3, 5, 1, 0), ("x", 1, 2, 0, 0), ("x", 0, 4, 1, 1), ("x", 3, 1, 0, 0)], "part string, fails int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): r for r in A.audit(sets, "PQ").collect()}
    assert got["PQ", 1].removed == 8 and got["PQ", 2].removed == 0 and got["PQ", 2].redundant == 6
    assert got["QP", 1].removed == 6 and got["QP", 2].unique_fails == 2 and got["QP", 2].kept == 4
    assert got["PQ", 1].shapley == 8 + 2 and got["PQ", 2].shapley == 6
    with pytest.raises(ValueError):
        A.audit(sets, "AAB")
