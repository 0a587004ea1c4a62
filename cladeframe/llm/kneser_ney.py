"""Interpolated modified Kneser-Ney n-gram model in memory-mapped sorted hash arrays.

Tasks turn documents into n-grams of token numbers and add up equal ones; Spark deals them into buckets by hash.
Each bucket becomes files of sorted arrays in the shared folder, one set for n-grams and one for contexts. Lower orders
are counted from the n-grams of the order above, read back from their files. Tasks that score map the files into memory
and search sorted keys in them, so a model may be larger than a task's memory.
"""

from __future__ import annotations

import os
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm.common import as_bytes, by_value, column_of, local_path, mix64, words
from cladeframe.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens a document starts with and ends with; no word holds blanks.
START, END = b" start", b" end"
#: Words that a task remembers; beyond it, it passes on what it has and starts afresh.
REMEMBERED = 300_000
#: Tokens of training text for one bucket.
BUCKET_TOKENS = 600_000
#: Tokens that a task counts or scores at once.
CHUNK = 500_000
#: Buckets of one order that a task reads to count the order below.
READ = 8
#: Buckets of one table that a task keeps mapped; each array of them holds a file open.
MAPPED = 64


def token_hash(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token)


def unmix64(x: np.ndarray) -> np.ndarray:
    """Inverse of mix64."""
    x = x.copy()
    for shift, factor in ((31, 0x94D049BB133111EB), (27, 0xBF58476D1CE4E5B9), (30, 1)):
        done = shift
        y = x ^ (x >> np.uint64(shift))
        while 2 * done < 64:
            y = x ^ (y >> np.uint64(shift))
            done += shift
        x = y * np.uint64(pow(factor, -1, 2**64))
    return x


def packs(n: int, n_distinct: int) -> bool:
    """Whether the token numbers of an n-gram fit into its key, so that the key gives them back."""
    return n <= 3 and n_distinct + 2 < 2 ** bits_of(n)


def bits_of(n: int) -> int:
    """Bits of a token number in the key of an n-gram."""
    return 64 // max(n, 2)


def gram_key(ids: list[np.ndarray], n_distinct: int) -> np.ndarray:
    """64-bit key of n-grams, given as one array of token numbers for each place."""
    if packs(len(ids), n_distinct):
        h = ids[0].astype(np.uint64)
        for x in ids[1:]:
            h = h << np.uint64(bits_of(len(ids))) | x.astype(np.uint64)
        return mix64(h)
    h = np.zeros(len(ids[0]), np.uint64)
    for x in ids:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64) + np.uint64(1))
    return h


def gram_ids(key: np.ndarray, n: int) -> list[np.ndarray]:
    """Token numbers from keys that hold them."""
    h, bits = unmix64(key), bits_of(n)
    return [(h >> np.uint64(bits * (n - 1 - i)) & np.uint64(2**bits - 1)).astype(np.int64) for i in range(n)]


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the keys' upper half."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def summed(key: np.ndarray, fixed: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Rows of equal key added up, sorted by key; ``fixed`` arrays depend on the key."""
    order = np.argsort(key)
    key = key[order]
    at = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1) if len(key) else np.empty(0, np.int64)
    return key[at], [x[order][at] for x in fixed], [np.add.reduceat(c[order], at) if len(at) else c for c in counts]


def shrink(arrays: list[np.ndarray]) -> bytes:
    """Arrays of non-negative numbers as bytes, the first one sorted: steps of the first, then byte by byte, so that zeros lie together."""
    n = len(arrays[0])
    out = [np.uint64(n).tobytes()]
    for i, a in enumerate(arrays):
        a = a.astype(np.uint64)
        if i == 0 and n:
            a = np.append(a[:1], np.diff(a))
        width = (int(a.max()).bit_length() + 7) // 8 if n else 0
        out += [bytes([width]), a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return b"".join(out)


def grow(data: bytes, k: int) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.uint64, 1)[0])
    at, arrays = 8, []
    for i in range(k):
        width = data[at]
        planes = np.frombuffer(data, np.uint8, n * width, at + 1).reshape(width, n)
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = planes.T
        a = a.view(np.uint64).ravel()
        arrays.append(np.cumsum(a, dtype=np.uint64) if i == 0 else a.astype(np.int64))
        at += 1 + n * width
    return arrays


DEALT = "bucket int, data binary"


def dealt(buckets: int, key: np.ndarray, others: list[np.ndarray]) -> pa.RecordBatch:
    """Sorted rows as one packed row for each bucket that has any."""
    cuts = np.searchsorted(bucket_of(key, buckets), np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    data = [shrink([x[cuts[b] : cuts[b + 1]] for x in (key, *others)]) for b in full]
    return pa.record_batch([pa.array(full.astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "data"])


def save(folder: str, name: str, bucket: int, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays so that readers see whole files only; a second attempt writes the same."""
    for k, a in arrays.items():
        path = f"{folder}/{name}-{k}-{bucket}.npy"
        part = f"{path}.{os.getpid()}-{os.urandom(4).hex()}"
        with open(part, "wb") as f:
            np.save(f, a)
        os.replace(part, path)


def mapped(folder: str, name: str, kind: str, bucket: int) -> np.ndarray:
    path = f"{folder}/{name}-{kind}-{bucket}.npy"
    return np.load(path, mmap_mode="r") if os.path.getsize(path) > 128 else np.load(path)


class Table:
    """Sorted arrays over all buckets; values of keys, and where they are."""

    def __init__(self, folder: str, name: str, buckets: int, kinds: list[str]) -> None:
        self.folder, self.name, self.buckets, self.kinds = folder, name, buckets, kinds
        self.open: dict[int, list[np.ndarray]] = {}

    def part(self, bucket: int) -> list[np.ndarray]:
        arrays = self.open.pop(bucket, None)
        if arrays is None:
            arrays = [mapped(self.folder, self.name, k, bucket) for k in ["key", *self.kinds]]
            # the one not used for longest is first; its files close with its arrays
            while len(self.open) >= MAPPED:
                del self.open[next(iter(self.open))]
        self.open[bucket] = arrays
        return arrays

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Whether each key is there, its place in its bucket, and its values (0 if it isn't)."""
        distinct, back = np.unique(key, return_inverse=True)
        there, place = np.zeros(len(distinct), bool), np.zeros(len(distinct), np.int64)
        values = [np.zeros(len(distinct)) for _ in self.kinds]
        bucket = bucket_of(distinct, self.buckets)
        cuts = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            lo, hi = cuts[b], cuts[b + 1]
            keys, *arrays = self.part(int(b))
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, distinct[lo:hi]), len(keys) - 1)
            hit = keys[at] == distinct[lo:hi]
            there[lo:hi], place[lo:hi] = hit, at
            for v, a in zip(values, arrays):
                v[lo:hi] = np.where(hit, a[at], 0)
        return there[back], place[back], [v[back] for v in values]


@dataclass
class Model:
    folder: str
    order: int
    buckets: int
    #: First token number of each bucket of the vocabulary.
    first: np.ndarray
    n_tokens: int
    n_distinct: int
    #: Discounts for counts 1, 2 and more, by order.
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    #: Of the lowest order: all continuations, and the weight left for tokens never seen.
    total: float = 0.0
    left: float = 1.0

    @property
    def start_id(self) -> int:
        return self.n_distinct

    @property
    def unknown_id(self) -> int:
        return self.n_distinct + 1


class Numbering:
    """Numbers of tokens: a token's place in the sorted vocabulary."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.vocabulary = Table(model.folder, "vocabulary", model.buckets, [])
        self.known: dict[bytes, int] = {START: model.start_id}

    def number(self, tokens: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
            known[START] = self.model.start_id
        new = [w for w in dict.fromkeys(tokens) if w not in known]
        h = mix64(np.array([token_hash(w) for w in new], np.uint64))
        there, place, _ = self.vocabulary.find(h)
        number = np.where(there, self.model.first[bucket_of(h, self.model.buckets)] + place, self.model.unknown_id)
        known.update(zip(new, number.tolist()))
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))


def token_groups(batches: Iterator[pa.RecordBatch], before: list[bytes]) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray]]:
    """Documents of a batch as one list of tokens and their lengths, CHUNK tokens or a single document at a time."""
    for b in batches:
        tokens: list[bytes] = []
        lengths: list[int] = []
        first = 0
        for i, text in enumerate(as_bytes(column_of(b, "text"))):
            ws = words(text)
            tokens += before
            tokens += ws
            tokens.append(END)
            lengths.append(len(before) + len(ws) + 1)
            if len(tokens) >= CHUNK:
                yield b.slice(first, i + 1 - first), tokens, np.array(lengths)
                tokens, lengths, first = [], [], i + 1
        if lengths:
            yield b.slice(first), tokens, np.array(lengths)


def grams(ids: np.ndarray, lengths: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """N-grams that predict each token but the start, and the places they predict.

    Near a document's start they are shorter: a token with k tokens before it has an n-gram of k + 1 tokens at most.
    Returned are those of full order only, so documents carry order - 1 start marks.
    """
    ends = np.cumsum(lengths)
    offset = np.arange(len(ids)) - np.repeat(ends - lengths, lengths)
    at = np.flatnonzero(offset >= order - 1)
    return [ids[at - order + 1 + j] for j in range(order)], at


def _write_buckets(rows: DataFrame, arrays: int, write: Callable[[int, list[np.ndarray]], list[float]], n_out: int) -> np.ndarray:
    """Hand the arrays of every bucket to one call of ``write`` and add up the figures it returns."""
    schema = "bucket int, " + ", ".join(f"x{i} double" for i in range(n_out))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        parts = [grow(x, arrays) for x in t.column("data").to_pylist()]
        out = write(key[0].as_py(), [np.concatenate(x) for x in zip(*parts)])
        return pa.table([pa.array([key[0].as_py()], pa.int32())] + [pa.array([float(x)]) for x in out], names=["bucket"] + [f"x{i}" for i in range(n_out)])

    figures = rows.groupBy("bucket").applyInArrow(run, schema)
    found = figures.agg(*[F.sum(f"x{i}") for i in range(n_out)]).first()
    return np.array([x or 0.0 for x in found])


def _fill_empty(spark: SparkSession, folder: str, name: str, buckets: int, kinds: dict[str, type]) -> None:
    """Buckets that got no rows get empty files. The driver looks at names only."""
    for b in range(buckets):
        for k, t in kinds.items():
            if not os.path.exists(f"{folder}/{name}-{k}-{b}.npy"):
                save(folder, name, b, {k: np.empty(0, t)})


def _vocabulary(docs: DataFrame, folder: str, buckets: int) -> None:
    """Files of token hashes and counts, sorted."""

    def passed(tally: Counter) -> pa.RecordBatch:
        h = mix64(np.fromiter(map(token_hash, tally), np.uint64, len(tally)))
        key, _, (c,) = summed(h, [], [np.fromiter(tally.values(), np.int64, len(tally))])
        return dealt(buckets, key, [c])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for _, tokens, _ in token_groups(batches, []):
            tally.update(tokens)
            if len(tally) > REMEMBERED:
                yield passed(tally)
                tally.clear()
        if tally:
            yield passed(tally)

    def write(bucket: int, arrays: list[np.ndarray]) -> list[float]:
        key, _, (c,) = summed(arrays[0], [], arrays[1:])
        save(folder, "vocabulary", bucket, {"key": key, "count": c})
        return [0.0]

    _write_buckets(docs.select("text").mapInArrow(count, DEALT), 2, write, 1)
    _fill_empty(docs.sparkSession, folder, "vocabulary", buckets, {"key": np.uint64, "count": np.int64})


def discounts_of(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Discounts of modified Kneser-Ney; where counts of counts are missing, half a count per step."""
    if not (n1 and n2):
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    d1 = 1 - 2 * y * n2 / n1
    return tuple(float(min(max(d, 0.05), k - 0.05)) for d, k in zip((d1, d2, d3), (1, 2, 3)))


def _fixed(model: Model, n: int) -> int:
    """Arrays of token numbers kept beside the keys of n-grams."""
    return 0 if packs(n, model.n_distinct) else n


def _level(rows: DataFrame, model: Model, n: int) -> None:
    """Files of the n-grams of one order, and its discounts, from dealt rows."""
    folder, fixed = model.folder, _fixed(model, n)

    def write(bucket: int, arrays: list[np.ndarray]) -> list[float]:
        key, ids, (c,) = summed(arrays[0], arrays[1 : 1 + fixed], arrays[1 + fixed :])
        kept = {"key": key, "count": c.astype(np.uint32) if not len(c) or c.max() < 2**32 else c}
        save(folder, f"grams{n}", bucket, kept | {f"t{i}": x.astype(np.uint32) if model.n_distinct + 2 < 2**32 else x for i, x in enumerate(ids)})
        return [(c == k).sum() for k in (1, 2, 3, 4)]

    found = _write_buckets(rows, 2 + fixed, write, 4)
    empty = {"key": np.uint64, "count": np.uint32} | {f"t{i}": np.int64 for i in range(fixed)}
    _fill_empty(rows.sparkSession, folder, f"grams{n}", model.buckets, empty)
    model.discounts[n] = discounts_of(*found)


def _from_level(spark: SparkSession, model: Model, n: int, turn: Callable[[list[np.ndarray], np.ndarray], tuple[list[np.ndarray], list[np.ndarray]]]) -> DataFrame:
    """Dealt rows made from the files of one order; ``turn`` gives shorter n-grams and their counts."""
    folder, buckets, n_distinct, fixed = model.folder, model.buckets, model.n_distinct, _fixed(model, n)

    def turned(bucket: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        key = np.asarray(mapped(folder, f"grams{n}", "key", bucket))
        ids = [np.asarray(mapped(folder, f"grams{n}", f"t{i}", bucket)).astype(np.int64) for i in range(fixed)] or gram_ids(key, n)
        lower, counts = turn(ids, np.asarray(mapped(folder, f"grams{n}", "count", bucket)).astype(np.int64))
        return summed(gram_key(lower, n_distinct), lower if _fixed(model, n - 1) else [], counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_pylist()
            for i in range(0, len(at), READ):
                parts = [turned(k) for k in at[i : i + READ]]
                key = np.concatenate([p[0] for p in parts])
                joined = [[np.concatenate(x) for x in zip(*(p[j] for p in parts))] for j in (1, 2)]
                key, lower, counts = summed(key, *joined)
                yield dealt(buckets, key, [*lower, *counts])

    return spark.range(0, buckets, 1, max(1, buckets // READ)).mapInArrow(run, DEALT)


def _contexts(spark: SparkSession, model: Model, n: int) -> None:
    """Files of the contexts of one order: total count and the weight left for the order below."""
    folder, fixed = model.folder, _fixed(model, n - 1)
    d1, d2, d3 = model.discounts[n]

    def turn(ids: list[np.ndarray], c: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return ids[:-1], [c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64)]

    def write(bucket: int, arrays: list[np.ndarray]) -> list[float]:
        key, _, (total, n1, n2, n3) = summed(arrays[0], [], arrays[1 + fixed :])
        save(folder, f"contexts{n}", bucket, {"key": key, "total": total.astype(np.float64), "left": (d1 * n1 + d2 * n2 + d3 * n3) / total})
        return [0.0]

    _write_buckets(_from_level(spark, model, n, turn), 5 + fixed, write, 1)
    _fill_empty(spark, folder, f"contexts{n}", model.buckets, {"key": np.uint64, "total": np.float64, "left": np.float64})


def _below(spark: SparkSession, model: Model, n: int) -> DataFrame:
    """Counts of the next lower order: how many different tokens come before, or plain counts after a document's start."""
    start = model.start_id

    def turn(ids: list[np.ndarray], c: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        # an n-gram that begins with a start mark has nothing before it; it counts as often as it occurs
        plain = (ids[1] == start) & (n > 2)
        return ids[1:], [np.where(plain, c, 1)]

    return _from_level(spark, model, n, turn)


def train(docs: DataFrame, order: int = 2, folder: str | None = None, bucket_tokens: int = BUCKET_TOKENS) -> Model:
    """Count a model of the given order over all rows of ``docs`` (``text``) and store it below the shared folder.

    NULL and empty texts are documents of one token, the end. Without rows, the model gives every token the same probability.
    """
    spark = docs.sparkSession
    folder = folder or local_path(scratch_path(spark, "kneser-ney"))
    os.makedirs(folder, exist_ok=True)
    size = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1)).first()[0] or 0
    # about six bytes a token
    buckets = int(max(8, -(-size // (6 * bucket_tokens))))
    _vocabulary(docs, folder, buckets)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                c = mapped(folder, "vocabulary", "count", k)
                yield pa.record_batch([pa.array([k]), pa.array([len(c)]), pa.array([int(c.sum())])], names=["bucket", "n", "total"])

    sizes = spark.range(0, buckets, 1, buckets).mapInArrow(lengths, "bucket bigint, n bigint, total bigint").orderBy("bucket").collect()
    first = np.append(0, np.cumsum([r.n for r in sizes]))
    model = Model(folder, order, buckets, first[:-1], sum(r.total for r in sizes), int(first[-1]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbering = Numbering(model)
        for _, tokens, n in token_groups(batches, [START] * (order - 1)):
            ids, _ = grams(numbering.number(tokens), n, order)
            key, ids, (c,) = summed(gram_key(ids, model.n_distinct), ids if _fixed(model, order) else [], [np.ones(len(ids[0]), np.int64)])
            yield dealt(buckets, key, [*ids, c])

    rows = docs.select("text").mapInArrow(count, DEALT)
    for n in range(order, 1, -1):
        _level(rows, model, n)
        _contexts(spark, model, n)
        rows = _below(spark, model, n)
    _lowest(rows, model)
    return model


def _lowest(rows: DataFrame, model: Model) -> None:
    _level(rows, model, 1)
    folder, buckets = model.folder, model.buckets

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                c = mapped(folder, "grams1", "count", k)
                parts = [c.sum(), (c == 1).sum(), (c == 2).sum(), (c > 2).sum()]
                yield pa.record_batch([pa.array([float(x)]) for x in parts], names=["a", "b", "c", "d"])

    spark = rows.sparkSession
    total, n1, n2, n3 = spark.range(0, buckets, 1, buckets).mapInArrow(totals, "a double, b double, c double, d double").agg(F.sum("a"), F.sum("b"), F.sum("c"), F.sum("d")).first()
    if total:
        d = model.discounts[1]
        model.total, model.left = total, (d[0] * n1 + d[1] * n2 + d[2] * n3) / total


class Scorer:
    """Probabilities from a stored model, mapped into memory."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.numbering = Numbering(model)
        self.words = Table(model.folder, "vocabulary", model.buckets, ["count"])
        self.grams = {n: Table(model.folder, f"grams{n}", model.buckets, ["count"]) for n in range(1, model.order + 1)}
        self.contexts = {n: Table(model.folder, f"contexts{n}", model.buckets, ["total", "left"]) for n in range(2, model.order + 1)}

    def kept(self, n: int, c: np.ndarray) -> np.ndarray:
        d = np.append(0.0, self.model.discounts.get(n, (0.5, 0.5, 0.5)))
        return np.maximum(c - d[np.minimum(c, 3).astype(np.int64)], 0.0)

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of token numbers; 0 for unknown ones."""
        m = self.model
        out = np.zeros(len(ids))
        distinct, back = np.unique(ids, return_inverse=True)
        values = np.zeros(len(distinct))
        real = np.flatnonzero(distinct < m.n_distinct)
        bucket = np.searchsorted(m.first, distinct[real], side="right") - 1
        for b in np.unique(bucket):
            here = real[bucket == b]
            values[here] = self.words.part(int(b))[1][distinct[here] - m.first[b]]
        out[:] = values[back]
        return out

    def probabilities(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each token but the starts, by interpolating all orders; and where those tokens are."""
        m = self.model
        full, at = grams(ids, lengths, m.order)
        p = np.full(len(at), 1.0 / (m.n_distinct + 1))
        for n in range(1, m.order + 1):
            gram = full[m.order - n :]
            _, _, (c,) = self.grams[n].find(gram_key(gram, m.n_distinct))
            if n == 1:
                if m.total:
                    p = self.kept(1, c) / m.total + m.left * p
                continue
            seen, _, (total, left) = self.contexts[n].find(gram_key(gram[:-1], m.n_distinct))
            p = np.where(seen, self.kept(n, c) / np.where(seen, total, 1) + left * p, p)
        return p, at


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score, perplexity`` of every whole document.

    Scores are log10 probabilities. NULL text is empty, a document of one token; repeated rows stay.
    """
    sent = by_value(docs.sparkSession, model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent()
        scorer = Scorer(m)
        marks = m.order - 1
        for b, tokens, lengths in token_groups(batches, [START] * marks):
            ids = scorer.numbering.number(tokens)
            p, where = scorer.probabilities(ids, lengths)
            c = scorer.counts(ids[where])
            n = lengths - marks
            starts = np.cumsum(n) - n
            base = np.add.reduceat(np.log10((c + 0.5) / (m.n_tokens + 0.5 * (m.n_distinct + 1))), starts)
            total = np.add.reduceat(np.log10(p), starts)
            known = np.add.reduceat((c > 0).astype(np.int64), starts)
            out = [column_of(b, "doc_id"), pa.array(n.astype(np.int64)), pa.array(known)]
            out += [pa.array(base), pa.array(total), pa.array(10.0 ** np.minimum(-total / n, 300.0))]
            yield pa.record_batch(out, names=names)

    schema = f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
