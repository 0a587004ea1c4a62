"""Pieces that several operators share."""

from __future__ import annotations

import ctypes
import os
import sys
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A word is a run of other characters than space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str | Column) -> Column:
    """crc32 of an id written as text; a NULL id counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def id_hash(column: str | Column) -> Column:
    """60 well mixed bits of an id, the same in any SQL engine that knows MD5."""
    c = F.col(column) if isinstance(column, str) else column
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Join condition on equal values, NULL equal to NULL."""
    cond = a[names[0]].eqNullSafe(b[names[0]])
    for n in names[1:]:
        cond &= a[n].eqNullSafe(b[n])
    return cond


def as_bytes(column: pa.Array, step: int = 64) -> Iterator[bytes]:
    """Values of a text column as UTF-8, copied a few at a time; NULL gives the empty text."""
    for at in range(0, len(column), step):
        for x in column.slice(at, step).cast(pa.large_binary()).to_pylist():
            yield x or b""


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(task: Task) -> Task:
    """A task that gives freed memory back to the system at its end; workers are kept, and what they keep adds up over jobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return run


def by_value(spark: SparkSession, value: object) -> Callable[[], object]:
    """Send an object to all tasks, classes of this package included; tasks call the result to get it, and it is made once a task.

    A plain broadcast would name such classes by module, which executors would have to have installed.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    held: list = []

    def get() -> object:
        if not held:
            held.append(cloudpickle.loads(sent.value))
        return held[0]

    return get


def words(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased; ``bytes`` methods know ASCII only, which is what is asked for."""
    return text.lower().split()


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def local_path(uri: str) -> str:
    """The mounted path behind a ``file:`` folder, for files that tasks map into memory."""
    at = urlparse(uri)
    if at.scheme not in ("", "file"):
        raise ValueError(f"{uri}: memory mapping needs a shared folder that is mounted on every machine")
    return at.path


def _mapped(folder: str, many: int) -> Callable[[], list[np.ndarray]]:
    """A function that maps the arrays 0 to ``many`` of a folder into memory."""

    def get() -> list[np.ndarray]:
        paths = [f"{folder}/{i}.npy" for i in range(many)]
        # nothing to map in a file without values
        return [np.asarray(np.load(p, mmap_mode="r")) if os.path.getsize(p) > 128 else np.load(p) for p in paths]

    return get


def shared_arrays(spark: SparkSession, label: str, arrays: list[np.ndarray]) -> Callable[[], list[np.ndarray]]:
    """Hand arrays to all tasks, which call the result to get them: files in the shared folder, written once and mapped into memory.

    A shared folder that is not mounted can't be mapped; arrays are broadcast then.
    """
    path = scratch_path(spark, label)
    if urlparse(path).scheme not in ("", "file"):
        sent = spark.sparkContext.broadcast(arrays)
        return lambda: sent.value
    folder = local_path(path)
    os.makedirs(folder)
    for i, a in enumerate(arrays):
        np.save(f"{folder}/{i}.npy", a)
    return _mapped(folder, len(arrays))


def blank_arrays(
    spark: SparkSession, label: str, kinds: list[tuple[tuple[int, ...], type]]
) -> tuple[Callable[[int, int, np.ndarray], None], Callable[[], list[np.ndarray]]] | None:
    """Arrays of zeros of the given shapes and types as files in the shared folder; None if it is not mounted.

    Tasks call the first function to write rows of the array i from row ``begin`` on, and later ones the second to map the arrays into memory.
    A task that runs again writes the same rows at the same place.
    """
    path = scratch_path(spark, label)
    if urlparse(path).scheme not in ("", "file"):
        return None
    folder = local_path(path)
    os.makedirs(folder)
    for i, (shape, kind) in enumerate(kinds):
        if 0 in shape:
            np.save(f"{folder}/{i}.npy", np.zeros(shape, kind))
        else:
            np.lib.format.open_memmap(f"{folder}/{i}.npy", "w+", kind, shape).flush()

    def fill(i: int, begin: int, rows: np.ndarray) -> None:
        if rows.size:
            file = f"{folder}/{i}.npy"
            at = np.load(file, mmap_mode="r").offset + begin * rows.itemsize * (rows.size // len(rows))
            with open(file, "r+b") as f:
                f.seek(at)
                f.write(rows.tobytes())

    return fill, _mapped(folder, len(kinds))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with well mixed output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of the nodes 0..n-1 over the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
    return label


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted non-decreasing fit: block positions (mean x) and their values, by pooling neighbours that fall."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for i in order:
        blocks.append([float(x[i] * w[i]), float(y[i] * w[i]), float(w[i])])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([p[0] / p[2] for p in blocks]), np.array([p[1] / p[2] for p in blocks])


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches cut where the key changes, so that all rows of a key are in one batch; rows come sorted by key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = column_of(b, key).to_numpy(zero_copy_only=False)
        changes = np.flatnonzero(k[1:] != k[:-1])
        if held and column_of(held[-1], key)[-1].as_py() != k[0]:
            yield pa.concat_batches(held)
            held = []
        if len(changes):
            cut = int(changes[-1]) + 1
            yield pa.concat_batches([*held, b.slice(0, cut)])
            held = []
            b = b.slice(cut)
        held.append(b)
    if held:
        yield pa.concat_batches(held)
