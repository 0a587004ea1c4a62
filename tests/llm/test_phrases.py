"""Phrases against brute force, and what the summaries promise."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cladeframe.llm import phrases as P

SCHEMA = "doc_id bigint, text string, lang string, words int, phrase string, part int"
ODD = [
    (1, "New York, new york! NEW YORK is big. Ünï cödé\tx y z", "en"), (1, "New York, new york! NEW YORK is big. Ünï cödé\tx y z", "en"),
    (2, None, None), (3, "", "en"), (4, "a b c. a b\nc a b c ... ;", None), (5, "a b c " * 30, "und"), (None, " \t\r\n\x0b,", "de"),
    (6, "x " * 3000 + "y z " * 500, "de"), (7, "one" * 5000 + " two", "fr"), (8, "ab cd ef. " * 40 + "ÀB ab cd", "en"),
]


def brute(rows, most=3, least=10, inside=50, top=2000):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, most + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            longer = [q for q in cand if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * cand[q] >= inside * a for q in longer):
                continue
            cuts = [(10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            found.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return out


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(*r, 1, "mine", 2) for r in ODD], SCHEMA)


@pytest.mark.parametrize("chunk, block", [(P.CHUNK, P.BLOCK), (50, 16)])
def test_phrases_by_brute_force(spark, odd, monkeypatch, chunk, block):
    monkeypatch.setattr(P, "CHUNK", chunk)
    monkeypatch.setattr(P, "BLOCK", block)
    assert {tuple(r) for r in P.collocations(odd).collect()} == brute(ODD)
    assert {tuple(r) for r in P.collocations(odd, most=2, least=2, inside=30, top=3).collect()} == brute(ODD, 2, 2, 30, 3)
    assert {tuple(r) for r in P.collocations(odd, most=4, least=3).collect()} == brute(ODD, 4, 3)


def test_empty_table(odd):
    assert P.collocations(odd.limit(0)).count() == 0


def test_a_small_filter_loses_nothing(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {tuple(r) for r in P.collocations(docs).collect()}
    monkeypatch.setattr(P, "MOST_BITS", 1 << 10)  # lets nearly everything through
    assert {tuple(r) for r in P.collocations(docs).collect()} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_summaries_keep_every_frequent_key(seed):
    draw, least = random.Random(seed), 10
    stream = [draw.getrandbits(8) ** 2 if draw.random() < 0.3 else draw.getrandbits(32) for _ in range(300_000)]
    true = Counter(stream)
    summary = P.Summary(len(stream) // least)
    for at in range(0, len(stream), 20_000):
        keys, counts = np.unique(np.array(stream[at : at + 20_000], np.uint32), return_counts=True)
        summary.add(*P.unpacked(P.packed(keys, counts), len(keys)))
    kept = set(summary.survivors(least).tolist())
    assert len(summary.keys) <= summary.capacity and 0 < summary.error < least
    assert {k for k, c in true.items() if c >= least} <= kept
    assert len(kept) < len(true) / 2  # most keys are ruled out


def test_capacity_is_needed_per_partition():
    """With fewer counters a frequent key can be lost: the bound is the reason for the capacity."""
    summary = P.Summary(2)
    for k in range(5):
        summary.add(np.array([k], np.uint32), np.array([4]))
    assert not len(summary.survivors(20)) and summary.error == 4
