"""Quality scores: ridge regression on random Fourier features of document statistics, with isotonic calibration.

A text becomes a short vector of statistics; cosines of random projections of it approximate a Gaussian kernel. Each
task adds up the normal equations of its rows, Spark adds up the tasks, and the driver solves a system whose size
doesn't depend on the data. Rows are dealt into folds, so that calibration uses scores from models that didn't see the row.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import as_bytes, by_value, column_of, id_hash, isotonic, tidy
from cladeframe.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = 256
SEED = 7
#: Width of the kernel, as a share of the usual distance of two standardised rows.
WIDTH = 0.7
RIDGE = 1.0
FOLDS = 4
#: Steps of raw scores that calibration sees.
STEPS = 1000

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
SYMBOL = ~(LETTERS | DIGIT | BLANK)
PLAIN_MARKS = np.zeros(256, bool)
PLAIN_MARKS[[33, 39, 44, 45, 46, 63]] = True
NOT_LETTERS = bytes(i for i in range(256) if not LETTERS[i])
MARKS = bytes(i for i in range(128) if SYMBOL[i])


def statistics(text: bytes) -> list[float]:
    """Statistics of a whole text; all 0 for a text without words."""
    ws = text.split()
    n = len(ws)
    if not n:
        return [0.0] * N_STATISTICS
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size, letters = len(text), max(1, int(byte[LETTERS].sum()))
    count = Counter(ws)
    top = count.most_common(5)
    lines = [x for x in text.split(b"\n") if x.strip()]
    line_count = Counter(lines)
    bare = [w.strip(MARKS) for w in ws]
    bigrams = Counter(zip(bare, bare[1:]))
    triples = len(set(zip(ws, ws[1:], ws[2:]))) if n > 2 else 0
    doubled = sum(1 for w in ws if len(w) > 1 and w[-1] == w[-2] and SYMBOL[w[-1]])
    return [
        np.log1p(n),
        np.log1p(size),
        sum(map(len, ws)) / n,
        byte[UPPER].sum() / letters,
        byte[DIGIT].sum() / size,
        byte[SYMBOL & ~PLAIN_MARKS].sum() / size,
        byte[PLAIN_MARKS].sum() / size,
        byte[33] / size,
        byte[128:].sum() / size,
        (size - byte[BLANK].sum()) / size,
        doubled / n,
        sum(1 for w in bare if not w) / n,
        sum(1 for w in ws if w.isupper() and len(w) > 1) / n,
        np.log(len(count)) / np.log(n) if n > 1 else 1.0,
        top[0][1] / n,
        sum(x[1] for x in top) / n,
        sum(1 for a, b in zip(ws, ws[1:]) if a == b) / n,
        1 - triples / (n - 2) if n > 2 else 0.0,
        max(bigrams.values(), default=0) / n,
        np.log1p(len(lines)),
        1 - len(line_count) / len(lines),
        max(line_count.values()) * 1.0 / len(lines),
        np.log(size / len(lines)),
        sum(1 for w in bare if len(w) <= 3) / n,
        np.log1p(max(map(len, ws))),
        sum(1 for w in ws if w[-1:] in b".,") / n,
        text.count(b"://") / n,
        (byte[ord("{")] + byte[ord("}")] + byte[ord("<")] + byte[ord(">")] + byte[ord(";")]) / size,
        byte[ord("|")] / size,
    ]


N_STATISTICS = 29


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in as_bytes(column_of(b, "text"))]
            yield pa.record_batch([column_of(b, "doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, x array<double>")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    calibrated: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.projection + self.phase), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        return np.interp(self.features(x) @ self.weights, self.raw, self.calibrated)


def matrix_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _normal_equations(rows: DataFrame, model: QualityModel) -> np.ndarray:
    """Sums of (features, label) outer products by fold, from ``x, y, fold``."""
    sent = by_value(rows.sparkSession, model)
    size = FEATURES + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, size, size))
        for b in batches:
            if b.num_rows:
                f = np.hstack([sent().features(matrix_of(column_of(b, "x"))), column_of(b, "y").to_numpy().reshape(-1, 1)])
                fold = column_of(b, "fold").to_numpy()
                for k in range(FOLDS):
                    total[k] += f[fold == k].T @ f[fold == k]
        parts = [(k * size + i, total[k, i].tolist()) for k in range(FOLDS) for i in range(size)]
        yield pa.record_batch([pa.array([p[0] for p in parts]), pa.array([p[1] for p in parts], pa.list_(pa.float64()))], names=["i", "v"])

    def add(t: pa.Table) -> pa.Table:
        v = matrix_of(t.column("v").combine_chunks()).sum(axis=0)
        return pa.table([t.column("i").slice(0, 1), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["i", "v"])

    sums = rows.mapInArrow(partial, "i bigint, v array<double>").groupBy("i").applyInArrow(add, "i bigint, v array<double>")
    out = np.zeros((FOLDS * size, size))
    for r in sums.collect():
        out[r.i] = r.v
    return out.reshape(FOLDS, size, size)


def _solve(a: np.ndarray) -> np.ndarray:
    n = len(a) - 1
    ridge = RIDGE * np.eye(n)
    ridge[-1, -1] = 1e-6  # the constant is free
    return np.linalg.solve(a[:n, :n] + ridge, a[:n, n])


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> QualityModel:
    """Fit on all labelled rows of ``doc_id, x``; labels are 0 or 1, the larger one if an id has several.

    Rows without id or label are left out. Without labelled rows every score is 0.5; with labels of one kind only, that label.
    """
    known = labels.dropna(subset=["doc_id", label]).groupBy("doc_id").agg((F.max(label) > 0).cast("double").alias("y"))
    rows = stats.join(known, "doc_id").select("x", "y", F.pmod(id_hash("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    rows = materialise(rows, "labelled")
    moments = [F.avg(F.col("x")[i]) for i in range(N_STATISTICS)] + [F.stddev_pop(F.col("x")[i]) for i in range(N_STATISTICS)]
    found = rows.agg(F.count(F.lit(1)), F.avg("y"), *moments).first()
    n, share = found[0], found[1]
    rng = np.random.default_rng(SEED)
    width = WIDTH * np.sqrt(2 * N_STATISTICS)
    model = QualityModel(
        np.array([v or 0.0 for v in found[2 : 2 + N_STATISTICS]]), np.array([v or 1.0 for v in found[2 + N_STATISTICS :]]),
        rng.normal(size=(N_STATISTICS, FEATURES)) / width, rng.uniform(0, 2 * np.pi, FEATURES),
        np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5 if not n else share]),
    )
    if not n or share in (0.0, 1.0):
        return model
    sums = _normal_equations(rows, model)
    total = sums.sum(axis=0)
    model.weights = _solve(total)
    held = np.stack([_solve(total - sums[k]) for k in range(FOLDS)])
    sent = by_value(stats.sparkSession, (model, held))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held = sent()
        for b in batches:
            if b.num_rows:
                s = (m.features(matrix_of(column_of(b, "x"))) * held[column_of(b, "fold").to_numpy()]).sum(axis=1)
                step = np.clip(np.round((s + 0.5) / 2 * STEPS), 0, STEPS).astype(np.int64)
                count, up = np.bincount(step, minlength=STEPS + 1), np.bincount(step, weights=column_of(b, "y").to_numpy(), minlength=STEPS + 1)
                some = np.flatnonzero(count)
                yield pa.record_batch([pa.array(some), pa.array(count[some]), pa.array(up[some])], names=["step", "n", "up"])

    steps = rows.mapInArrow(raw, "step bigint, n bigint, up double").groupBy("step").agg(F.sum("n").alias("n"), F.sum("up").alias("up")).collect()
    x = np.array([r.step for r in steps]) / STEPS * 2 - 0.5
    count = np.array([float(r.n) for r in steps])
    model.raw, model.calibrated = isotonic(x, np.array([r.up for r in steps]) / count, count)
    return model


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score, predicted`` from ``doc_id, x``."""
    sent = by_value(stats.sparkSession, model)
    kind = stats.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = sent().score(matrix_of(column_of(b, "x")))
                yield pa.record_batch([column_of(b, "doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return stats.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``doc_id, score, predicted`` of every whole text, learning from ``labels``.

    Empty and NULL texts have statistics of 0 and get whatever score these stand for. Repeated rows stay; an empty table gives no rows.
    """
    stats = materialise(document_statistics(docs), "statistics")
    return score(stats, fit(stats, labels, label))


def reject(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The documents that score at least 0.5, with all their columns."""
    model = fit(materialise(document_statistics(docs), "statistics"), labels, label)
    sent = by_value(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in as_bytes(column_of(b, "text"))]).reshape(-1, N_STATISTICS)
            yield b.filter(pa.array(sent().score(x) >= 0.5, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
