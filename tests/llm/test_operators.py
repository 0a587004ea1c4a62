"""Small cases and brute force for the training-data operators."""

import dataclasses
import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cladeframe.llm import kneser_ney, mixing, nn_descent, packing, paragraph_sketch, rff_quality, sharding, simhash, tfidf_knn, url_cascade
from cladeframe.llm.common import components, isotonic
from cladeframe.llm.queries import registry

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: NULLs, empty and long texts, ties, repeated rows.
ODD = [
    (1, "one two three four five six", "en", "a", 27), (2, "one two three four five six", "en", "a", 27),
    (2, "one two three four five six", "en", "a", 27), (3, None, None, None, None), (4, "", "en", "b", 0),
    (5, "Straße ist schön ☃ " * 4000, "de", "b", 76000), (None, "no id here", "en", None, 10), (7, " \n\t ", "en", "c", 4),
]


@pytest.fixture(scope="module")
def odd(spark):
    # an extra column whose name the operators use inside
    return spark.createDataFrame(ODD, SCHEMA).withColumn("slot", F.lit("mine")).withColumn("h", F.lit(1))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(registry.sql))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(registry.sql[name])
    columns = [c[0] for c in want.description]
    got = registry.queries[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want.fetchall()))


def gapless(rows, key, place):
    groups = defaultdict(list)
    for r in rows:
        groups[r[key]].append(r[place])
    return all(sorted(v) == list(range(len(v))) for v in groups.values())


def test_sharding(spark, sf_dir, odd, empty, texts):
    rows = registry.queries["op1_sharding"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts) and gapless(rows, "shard", "slot")
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) <= 0.01 * sum(load.values())
    rows = sharding.shard_documents(odd, 3).collect()
    assert len(rows) == len(ODD) and gapless(rows, "shard", "slot")
    assert sharding.shard_documents(empty).collect() == []


def test_one_id_on_a_third_of_all_rows(spark):
    rows = [(None if i % 3 == 0 else i, f"text {i % 7}", "en", "a", 1) for i in range(3000)] + [(5, "same", "en", "a", 1)] * 600
    placed = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), 8).collect()
    held, slots = Counter(), defaultdict(list)
    for r in placed:
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(placed) == len(rows) and len(held) == 8 and max(held.values()) < 1.1 * min(held.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_growing_moves_few_slots():
    load = np.random.default_rng(1).integers(1, 1000, 512).astype(float)
    old = sharding.edit_map(load, np.arange(512) % 8, 8)
    new = sharding.edit_map(load, old, 9)
    total = np.bincount(new, weights=load, minlength=9)
    assert total.max() - total.min() <= 2
    moved = np.flatnonzero(old != new)
    # a fair share is 57 slots; swaps that even out the sizes add a few
    assert 0 < len(moved) < 85


def test_mixing(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and mixing.mix(empty).collect() == []
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd).collect()))
    assert all(r.taken <= 3 * r["size"] for r in rows)
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    times = Counter((r.doc_id, r.source, r["size"], r.times) for r in rows)
    assert out.count() == sum(k[3] * n for k, n in times.items())


def test_targets_by_water_filling(spark):
    sizes = {"a": 100, "b": 10, "c": 400, "d": 0, None: 50}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    weight = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    want, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    want |= share
    assert got == pytest.approx(want)


def plain_fingerprint(text):
    ws = [bytes(w) for w in text.encode().lower().split()]
    if not ws:
        return 0
    grams = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, sf_dir, texts, odd, empty):
    rows = registry.queries["op9_simhash"](spark, sf_dir).collect()
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{f:016x}" for i, f in zip(ids, fps)}
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    label = components(len(ids), np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    assert {r.doc_id: r.component_id for r in rows} == {i: ids[k] for i, k in zip(ids, label)}
    got = {r.doc_id: r.component_id for r in simhash.near_classes(odd).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 7: 3, 5: 5, None: None}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "None"]
    assert simhash.near_classes(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_links_in_large_buckets(spark):
    """Buckets of any size give the same classes."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 4)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 9), replace=False)) for b in base for _ in range(150)})
    a, b = np.triu_indices(len(fps), 1)
    near = np.array([(fps[i] ^ fps[j]).bit_count() <= 4 for i, j in zip(a, b)])
    want = components(len(fps), a[near], b[near])
    prints = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "doc_id bigint, fp bigint")
    for run in (16, 4096):
        got = {r.fp: r.component_id for r in simhash.classes(prints, run=run).collect()}
        assert got == {f: k for f, k in zip(fps, want)}


def test_kneser_ney(spark, sf_dir, texts, odd, empty):
    rows = {r.doc_id: r for r in registry.queries["op2_kneser_ney"](spark, sf_dir).collect()}
    train = {i: t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1}
    split = lambda t: [w.decode() for w in t.encode().lower().split()] + ["</s>"]
    count = Counter(w for t in train.values() for w in split(t))
    bi = Counter(p for t in train.values() for p in zip(["<s>", *split(t)], split(t)))
    n, v = sum(count.values()), len(count)
    before = Counter(w for _, w in bi)
    d2, d1 = (kneser_ney.discounts_of(*[sum(1 for x in c.values() if x == k) for k in (1, 2, 3, 4)]) for c in (bi, before))
    cut = lambda d, c: d[min(c, 3) - 1] if c else 0
    total, left = Counter(), defaultdict(float)
    for (a, _), c in bi.items():
        total[a] += c
        left[a] += cut(d2, c)
    rest = sum(cut(d1, c) for c in before.values()) / sum(before.values())

    def p(a, w):
        low = (before[w] - cut(d1, before[w])) / sum(before.values()) + rest / (v + 1)
        return (bi[a, w] - cut(d2, bi[a, w])) / total[a] + left[a] / total[a] * low if total[a] else low

    for i, t in texts.items():
        ws, r = split(t), rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(1 for w in ws if count[w]), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert r.score == pytest.approx(sum(math.log10(p(a, w)) for a, w in zip(["<s>", *ws], ws)))
        assert r.held_out == (i not in train)
    assert sum(p("the", w) for w in [*count, "never seen"]) == pytest.approx(1)
    three = kneser_ney.score(odd, kneser_ney.train(odd, order=3)).collect()
    assert len(three) == len(ODD) and all(-1e9 < r.score < 0 for r in three)
    none = kneser_ney.score(odd, kneser_ney.train(empty)).collect()
    assert all(r.score == 0 for r in none)


def test_kneser_ney_of_order_3(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in registry.queries["op2_kneser_ney_order3"](spark, sf_dir).collect()}
    split = lambda t: ["<s>", "<s>", *(w.decode() for w in t.encode().lower().split()), "</s>"]
    train = [split(t) for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    v = len({w for t in train for w in t[2:]})
    count = {3: Counter(g for t in train for g in zip(t, t[1:], t[2:])), 2: Counter(), 1: Counter()}
    for g, c in count[3].items():
        # after a document's start nothing different can come before
        count[2][g[1:]] += c if g[1] == "<s>" else 1
    for g in count[2]:
        count[1][g[1:]] += 1
    total, left = Counter(), defaultdict(float)
    d = {n: kneser_ney.discounts_of(*[sum(1 for x in c.values() if x == k) for k in (1, 2, 3, 4)]) for n, c in count.items()}
    for n, counts in count.items():
        for g, c in counts.items():
            total[n, g[:-1]] += c
            left[n, g[:-1]] += d[n][min(c, 3) - 1]

    def p(g):
        n = len(g)
        low = p(g[1:]) if n > 1 else 1 / (v + 1)
        c, of = count[n][g], total[n, g[:-1]]
        return ((c - d[n][min(c, 3) - 1] if c else 0) + left[n, g[:-1]] * low) / of if of else low

    for i, t in texts.items():
        ws = split(t)
        assert rows[i].n_tokens == len(ws) - 2
        assert rows[i].score == pytest.approx(sum(math.log10(p(g)) for g in zip(ws, ws[1:], ws[2:])))


def test_many_buckets_need_few_open_files(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(kneser_ney, "MAPPED", 8)
    some = docs.where("doc_id < 200").select("doc_id", "text")
    few, many = (kneser_ney.train(some, folder=str(tmp_path / n), bucket_tokens=t) for n, t in (("few", 10**6), ("many", 2000)))
    assert few.buckets == 8 and many.buckets > 4 * kneser_ney.MAPPED
    tokens = [w for r in some.collect() for w in [kneser_ney.START, *(r.text or "").lower().encode().split(), kneser_ney.END]]
    lengths = np.diff(np.append(np.flatnonzero([t == kneser_ney.START for t in tokens]), len(tokens)))
    found = []
    for model in (few, many):
        scorer = kneser_ney.Scorer(model)
        before = len(os.listdir("/proc/self/fd"))
        ids = scorer.numbering.number(tokens)
        found.append((scorer.probabilities(ids, lengths)[0], scorer.counts(ids)))
        assert len(os.listdir("/proc/self/fd")) - before <= 10 * kneser_ney.MAPPED
    assert np.allclose(found[0][0], found[1][0], rtol=1e-12) and (found[0][1] == found[1][1]).all()


def test_three_token_numbers_share_a_key(spark, odd):
    ids = [np.arange(9), np.arange(9)[::-1], np.full(9, 2**21 - 3)]
    assert [x.tolist() for x in kneser_ney.gram_ids(kneser_ney.gram_key(ids, 2**21 - 3), 3)] == [x.tolist() for x in ids]
    assert kneser_ney.packs(3, 2**21 - 3) and not kneser_ney.packs(3, 2**21 - 2)
    # longer ones keep their numbers beside the key
    four = kneser_ney.score(odd, kneser_ney.train(odd, order=4)).collect()
    assert len(four) == len(ODD) and all(-1e9 < r.score < 0 for r in four)


def test_packed_arrays_come_back():
    key = np.sort(np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64))
    back = kneser_ney.grow(kneser_ney.shrink([key, np.arange(500)]), 2)
    assert (back[0] == key).all() and (back[1] == np.arange(500)).all()
    a, b = kneser_ney.gram_ids(kneser_ney.gram_key([np.arange(9), np.arange(9)[::-1]], 100), 2)
    assert a.tolist() == list(range(9)) and b.tolist() == list(range(9))[::-1]


def test_url_cascade(spark):
    urls = ["http://a.b.net/x", None, "", "nothing", "http://NET", "http://net/", "http://example.net?x=/en/", "s://Example.NET/en/#", "http://notnet/", "http://x.org/fr/1", "http://x.org/fr", "http://net/"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id int, url string, host string")
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("allow", "org", "/fr/"), ("block", None, "/")]
    table = url_cascade.rule_table(spark, rules)
    want = [("net/", "block"), *[(None, "allow")] * 4, ("net/", "block"), (None, "allow"), ("example.net/en/", "allow"), (None, "allow"), ("org/fr/", "allow"), (None, "allow"), ("net/", "block")]
    for most in (url_cascade.MOST_BYTES, 0):  # by filters, and by the join that replaces filters too large
        got = sorted(url_cascade.judge(df, table, most_bytes=most).collect())
        assert [(r.rule, r.verdict) for r in got] == want
    assert url_cascade.judge(df.limit(0), table).count() == 0
    assert {r.verdict for r in url_cascade.judge(df, table.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    """Two thousand listed keys among twenty thousand."""
    every = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    levels = url_cascade.build(every.where("id % 10 = 0"), every)
    rows = every.select("id", *url_cascade._named(F.col("key"))).toPandas()
    got = url_cascade.listed(levels, rows.h1.to_numpy().view(np.uint64), rows.h2.to_numpy().view(np.uint64))
    assert (got == (rows.id % 10 == 0)).all() and len(levels) > 1


def test_neighbours(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    x = np.stack(rows.embedding.to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rows.vec_id.to_numpy()
    got = defaultdict(list)
    for r in sorted(registry.queries["op4_nn_descent"](spark, sf_dir).collect()):
        got[r.query_id].append(r.vec_id)
    hits = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -9
        hits += len(set(ids[np.lexsort((ids, -s))[:5]].tolist()) & set(got[ids[i]]))
    assert hits >= 0.9 * 5 * len(got)
    odd = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [0.0, 1.0])]
    df = spark.createDataFrame(odd, "vec_id bigint, embedding array<float>")
    found = sorted((r.rank, r.vec_id, round(r.score, 6)) for r in nn_descent.nearest(df, F.col("vec_id") == 0).collect())
    assert found == [(1, 1, 1.0), (2, 2, 1.0), (3, 7, 0.0)]
    assert nn_descent.nearest(df.limit(0), F.lit(True)).count() == 0


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("terms, of_one, most", [(40, 5, 5), (3000, 30, 5), (3000, 30, 2000)])
def test_block_max_search_is_exact(monkeypatch, terms, of_one, most):
    monkeypatch.setattr(tfidf_knn, "TOGETHER_POSTINGS", 1000)
    # many terms: most of them are not frequent; large counts: more than a byte tells apart
    rng = np.random.default_rng(4)
    p = 1 / np.arange(1, terms + 1) ** 0.7
    examples = [
        (i, int(rng.integers(2)), sorted(rng.choice(terms, of_one, replace=False, p=p / p.sum()).tolist()), rng.integers(1, most, of_one).tolist())
        for i in range(1200)
    ]
    index = tfidf_knn.build_index(examples, rng.uniform(1, 6, terms))
    assert most < 255 or (len(index.large) and len(index.wide))
    assert terms < 3000 or len(index.code) > 4 * tfidf_knn.TOGETHER_POSTINGS
    dense = np.zeros((len(examples), terms))
    for i, (_, _, t, c) in enumerate(examples):
        dense[i, t] = index.vector(t, c)[1]
    search = tfidf_knn.Search(index)
    asked = list(range(0, len(examples), 25))
    for i, (near, cosine, opened) in zip(asked, search.nearest([index.vector(*examples[i][2:]) for i in asked], 10)):
        s = np.round(dense @ dense[i], 6)
        want = np.lexsort((np.arange(len(examples)), -s))[:10]
        assert near.tolist() == want.tolist() and np.allclose(cosine, s[want], atol=1e-6) and 0 < opened <= search.blocks
    for i, (near, _, _) in zip(asked, search.nearest([index.vector(*examples[i][2:]) for i in asked], 10, asked)):
        assert i not in near and len(near) == 10


def test_terms_of_words_have_one_hash_whatever_the_word_has_beside_them():
    found = [w.encode() for w in ("dreadful", "dreadfull", '"dreadful,', "dreadfuë", "naïveté", "émigré", "12", "a_b", "--", "ab1cd", "straße")]
    names, hashes = [tfidf_knn.terms_of(w) for w in found], tfidf_knn.hashes_of(found)
    by_name, by_hash = {}, {}
    for terms, row in zip(names, hashes.tolist()):
        assert [h != 0 for h in row] == [i < len(terms) for i in range(len(row))]
        for t, h in zip(terms, row):
            assert by_name.setdefault(t, h) == h and by_hash.setdefault(h, t) == t
    assert names[0] == names[2] and names[6] == [] and set(names[0][1:]) & set(names[3])


def long_texts(spark, many):
    rng = np.random.default_rng(6)
    every = ["".join(x) for x in rng.choice(list("abcdefghij"), (3000, 8))]
    texts = [(i, " ".join(rng.choice(every, 300 if i % 3 else 2500)) + " again" * (300 * (i % 7 == 0)), "en", "a", 30) for i in range(many)]
    return spark.createDataFrame(texts, SCHEMA), labels_of(spark, [(i, 1, i % 2) for i in range(many)])


def test_driver_gets_no_postings(monkeypatch, spark):
    docs, labels = long_texts(spark, 300)
    got, collect = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: got.append(collect(df)) or got[-1])
    model = tfidf_knn.fit(docs, labels)
    index = tfidf_knn.index_from(model.sent()[1:])
    postings = int((index.dense > 0).sum()) + len(index.place)
    # a few numbers for each example and each term
    assert postings > 500_000 and sum(t.nbytes for t in got) < postings * 3


@pytest.mark.parametrize("mounted", [True, False])
def test_index_made_by_tasks(monkeypatch, spark, mounted):
    monkeypatch.setattr(tfidf_knn, "TOGETHER_POSTINGS", 5000)
    monkeypatch.setattr(tfidf_knn, "MOST_FREQUENT", 500)
    if not mounted:
        monkeypatch.setattr(tfidf_knn, "blank_arrays", lambda *_: None)
    docs, labels = long_texts(spark, 300)
    vocabulary, *fields = tfidf_knn.fit(docs, labels).sent()
    made, counter, examples = tfidf_knn.index_from(fields), tfidf_knn.TermCounter(vocabulary), []
    for r in docs.orderBy("doc_id").collect():
        _, place, n = counter.count_places([r.text.encode()])
        examples.append((r.doc_id, r.doc_id % 2, place, n))
    want = tfidf_knn.build_index(examples, made.idf)
    assert len(made.example) > tfidf_knn.BLOCK and len(made.place) > 20_000 and len(made.large) + len(made.wide)
    for f in dataclasses.fields(want):
        a, b = getattr(made, f.name), getattr(want, f.name)
        assert a.shape == b.shape and np.allclose(a, b, rtol=1e-6), f.name


def test_toxicity(spark, odd, empty):
    good = [(i, f"plain words number {i} of this tale", "en", "a", 30) for i in range(200)]
    bad = [(i, f"plain words number {i} with dreadfu{'lxyz'[i % 4]} insult", "en", "a", 30) for i in range(200, 240)]
    docs = spark.createDataFrame(good + bad, SCHEMA)
    labels = labels_of(spark, [(i, 1, int(i >= 200)) for i in range(240) if i % 3] + [(None, 1, 1), (5, None, None)])
    model = tfidf_knn.fit(docs, labels)
    rows = tfidf_knn.score(docs, model).collect()
    assert all(r.predicted == int(r.doc_id >= 200) and 0 <= r.score <= 1 for r in rows)
    assert all(r.evidence[0].label == 1 for r in rows if r.predicted)
    assert tfidf_knn.score(odd, model).count() == len(ODD) and tfidf_knn.reject(odd, model).columns == odd.columns
    assert tfidf_knn.score(empty, model).count() == 0
    assert {r.score for r in tfidf_knn.score(odd, tfidf_knn.fit(odd, labels.limit(0))).collect()} == {0.0}


@pytest.mark.parametrize("share", [40, 60])
def test_toxicity_where_toxic_texts_are_common(spark, share):
    texts = [(i, f"plain words number {i} " + ("with dreadful insult" if i % 100 < share else "of this tale"), "en", "a", 30) for i in range(300)]
    docs = spark.createDataFrame(texts, SCHEMA)
    labels = labels_of(spark, [(i, 1, int(i % 100 < share)) for i in range(300) if i % 3])
    model = tfidf_knn.fit(docs, labels)
    assert all(r.predicted == int(r.doc_id % 100 < share) for r in tfidf_knn.score(docs, model).collect())
    assert {r.doc_id for r in tfidf_knn.reject(docs, model).collect()} == {i for i in range(300) if i % 100 >= share}


def test_toxicity_is_by_cosine_of_whole_texts(spark, sf_dir, docs, texts):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id % 3 > 0")
    rows = tfidf_knn.score(docs, tfidf_knn.fit(docs, labels)).collect()

    def terms(text):
        plain = Counter(t for w in text.encode().lower().split() for t in tfidf_knn.terms_of(w))
        return plain | Counter({(t, k): 1 for t, n in plain.items() for k in (2, 3) if n >= k})

    tf = {i: terms(t) for i, t in texts.items()}
    first = {}
    for r in sorted(labels.collect(), key=lambda r: r.doc_id):
        first.setdefault(texts[r.doc_id], r.doc_id)
    examples = sorted(i for i in first.values() if tf[i])
    df = Counter(t for c in tf.values() for t in c)
    held = {t for i in examples for t in tf[i]}
    idf = {t: math.log((1 + len(tf)) / (1 + (df[t] if t in held else 1))) + 1 for t in df}
    vector = {i: {t: (1 + math.log(n)) * idf[t] for t, n in c.items()} for i, c in tf.items()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vector.items()}
    for r in rows:
        v = vector[r.doc_id]
        cosine = {i: sum(x * v[t] for t, x in vector[i].items() if t in v) / norm[i] / norm[r.doc_id] for i in examples} if v else {}
        want = sorted((c for c in cosine.values() if c > 1e-6), reverse=True)[:3]
        assert [e.cosine for e in r.evidence] == pytest.approx(want, abs=1e-5)
        assert [cosine[e.doc_id] for e in r.evidence] == pytest.approx(want, abs=1e-5)
        assert r.doc_id not in examples or r.evidence[0].cosine == pytest.approx(1, abs=1e-5)


def test_quality(spark, odd, empty):
    good = [(i, f"This is a plain sentence about the number {i}, and it goes on for a while.", "en", "a", 30) for i in range(150)]
    bad = [(i, f"BUY!! NOW!! {i}!! BUY!! NOW!! BUY!!", "en", "a", 30) for i in range(150, 200)]
    docs = spark.createDataFrame(good + bad, SCHEMA)
    labels = labels_of(spark, [(i, int(i < 150), 0) for i in range(200) if i % 4])
    assert all(r.predicted == int(r.doc_id < 150) for r in rff_quality.score_documents(docs, labels).collect())
    rows = rff_quality.score_documents(odd.unionByName(odd), labels_of(spark, [(1, 1, 0), (4, 0, 0)])).collect()
    assert len(rows) == 2 * len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert rff_quality.score_documents(empty, labels).count() == 0
    assert {r.score for r in rff_quality.score_documents(odd, labels.limit(0)).collect()} == {0.5}
    assert rff_quality.reject(odd, labels).columns == odd.columns


@pytest.mark.parametrize("name, label, fold, least", [("op6_tfidf_knn", "toxic", (5, 0), 0.9), ("op8_rff_quality", "quality", (3, 1), 0.95)])
def test_held_out_accuracy(spark, name, label, fold, least):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = registry.queries[name](spark, sf_dir).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r[label] for r in held) >= least * len(held)


def test_isotonic():
    x, y = isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert x.tolist() == [0, 1.5, 3] and y.tolist() == [0, 0.5, 1]


def test_packing(spark, sf_dir, texts, odd, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rows = registry.queries["op7_packing"](spark, sf_dir).collect()
    seen = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == seen[r.doc_id]
        ids = whole.encode(texts[r.doc_id], add_special_tokens=False).ids + [0]
        part = ids[r.start : r.start + 2048]
        assert r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        seen[r.doc_id] += r.length
    at = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 2048 and len(at) <= 1.02 * sum(at.values()) / 2048 + 1
    rows = packing.pack_documents(odd, path).collect()
    assert sum(r.start == 0 for r in rows) == len(ODD)
    assert packing.pack_documents(empty, path).count() == 0
    with_ids = packing.token_pieces(odd, path, with_ids=True).collect()
    assert all(len(r.ids) == r.length for r in with_ids)


def test_odd_words_are_encoded_alike():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["a\x0bb \x0cc\x1cd\x85e\xa0f", "ΟΔΟΣ x. (Σίσυφος)", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>.", "á (é) ﬁ İstanbul. K", "it's 'tis. ('s) don't.", "(“x”) ²! ½, Ⅷ.", ""]
    cache = packing.WordCache(path)
    want = [e.ids for e in cache.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in cache.encode([t.encode() for t in texts])] == want


def test_bounds_and_exchange(spark):
    assert packing.lower_bound(np.array([1025] * 3)) == 3
    assert packing.lower_bound(np.array([683] * 7)) == 4
    rng = np.random.default_rng(5)
    lengths = rng.integers(500, 1100, 400)
    _, _, bins = packing.best_fit(sorted(lengths.tolist(), reverse=True))
    assert packing.lower_bound(lengths) <= bins
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    got = packing.pack(pieces, part=40).collect()
    at = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert len(got) == 400 and max(at.values()) <= 2048


def test_paragraph_sketch(spark, sf_dir, texts, odd, empty):
    rows = {r.doc_id: r for r in registry.queries["op10_paragraph_sketch"](spark, sf_dir).collect()}
    ids = sorted(texts)
    assert sorted(rows) == ids
    for i, j in zip(ids, ids[1:] + ids[:1]):
        new = paragraph_sketch.edited(texts[i], texts[j])
        r = rows[i]
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        for other, likeness in ((new, r.near_edited), (texts[j], r.near_next)):
            a, b = (Counter(paragraph_sketch.digests(t).tolist()) for t in (texts[i], other))
            assert likeness == pytest.approx(2 * (a & b).total() / (a + b).total() if a + b else 1.0)
    assert len({r.fingerprint for r in rows.values()}) <= len(set(texts.values()))
    got = paragraph_sketch.compare_versions(odd).collect()
    assert len(got) == len(ODD) and len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    assert paragraph_sketch.compare_versions(empty).count() == 0
    one = paragraph_sketch.compare_versions(odd.where("doc_id = 1")).collect()
    assert one[0].near_next == 1.0


def test_ranges_meet(spark, sf_dir, docs, monkeypatch):
    """Many ranges of ids give what one range gives."""
    want = sorted(paragraph_sketch.compare_versions(docs).collect())
    monkeypatch.setattr(paragraph_sketch, "RANGE_BYTES", 20_000)
    assert sorted(paragraph_sketch.compare_versions(docs).collect()) == want


def test_ranges_hold_about_as_many_bytes(spark, monkeypatch):
    """Long texts come first; ranges by rows would put nearly all bytes into one."""
    rows = [(i, "word " * (2000 if i < 100 else 10), "en", "a", 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.col("doc_id"))
    monkeypatch.setattr(paragraph_sketch, "RANGE_BYTES", 100_000)
    total = sum(len(r[1]) for r in rows)
    cuts = paragraph_sketch.range_cuts(docs, total, 0).tolist()
    held = [sum(len(r[1]) for r in rows if lo <= r[0] < hi) for lo, hi in zip(cuts, [*cuts[1:], 2000])]
    assert len(cuts) > 5 and max(held) < 4 * sorted(held)[len(held) // 2]


def test_pieces_line_up_after_an_edit(texts):
    likeness = []
    for text in texts.values():
        a, b = (Counter(paragraph_sketch.digests(t).tolist()) for t in (text, "surprise " + text))
        if a.total() > 10:
            likeness.append(2 * (a & b).total() / (a + b).total())
    assert len(likeness) > 50 and min(likeness) > 0.7 and sum(x < 0.8 for x in likeness) < len(likeness) / 20
    long = "no line ends here " * 60_000
    assert len(paragraph_sketch.digests(long)) > 10_000


def test_pipeline(spark, sf_dir, docs, texts):
    from cladeframe.session import materialise

    now, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = materialise(stage(spark, now, sf_dir), f"test-{name}")
        assert now.columns == docs.columns
        if name != "mixing":
            assert 0 < now.count() <= before
            before = now.count()
    kept = Counter(r.doc_id for r in now.collect())
    assert set(kept) <= set(texts) and max(kept.values()) <= 3
    packed = corpus_pipeline.run(spark, sf_dir)
    assert Counter(r.doc_id for r in packed.where("piece = 0").collect()) == kept
