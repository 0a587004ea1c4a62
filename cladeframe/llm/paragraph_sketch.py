"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text is a multiset of paragraphs (lines; long lines are cut after words that their own hash picks, so that pieces line up again after an edit). Each paragraph's
digest goes into three cells of a small table; a cell holds a count and two XOR sums. Subtracting two tables cancels
what the texts share, and peeling cells that hold a single digest recovers what they don't. If the difference is
too large for the table, the digests are sketched again into a larger one, until peeling succeeds.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import column_of, mix64

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: One word in so many ends a piece of a line; a piece has so many words, and characters, at most.
CUT = 5
PIECE_WORDS = 20
PIECE_CHARS = 64
#: Cells of a fingerprint, and by how much a table grows after a failure.
CELLS = 30
GROWTH = 4
TABLES = 3
#: Documents that a task sketches at once, and characters after which it stops collecting more.
GROUP = 512
GROUP_CHARS = 4_000_000
#: Bytes of text per range of documents.
RANGE_BYTES = 32 << 20
#: Fine ranges that make a range.
FINE = 8

CHECK = np.uint64(0x9E3779B97F4A7C15)
#: Added to a digest before it is hashed into a third of a table.
SALTS = [np.uint64(t * 0x9E3779B97F4A7C15 % 2**64) for t in range(2, 2 + TABLES)]


def digests(text: str) -> np.ndarray:
    """Digest of every paragraph, sorted; the n-th copy of a paragraph has a digest of its own."""
    out = []
    digest = xxhash.xxh64_intdigest
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        ws = line.split()
        ends = [i for i, w in enumerate(ws, 1) if not crc32(w) % CUT]
        lo = 0
        for hi in [*ends, len(ws)]:
            pieces = [b" ".join(ws[i : min(i + PIECE_WORDS, hi)]) for i in range(lo, hi, PIECE_WORDS)]
            lo = hi
            for piece in pieces:
                if len(piece) <= PIECE_CHARS:
                    out.append(digest(piece))
                else:
                    out += [digest(piece[j : j + PIECE_CHARS]) for j in range(0, len(piece), PIECE_CHARS)]
    d = np.sort(np.array(out, np.uint64))
    if len(d) > 1:
        first = np.append(0, np.flatnonzero(d[1:] != d[:-1]) + 1)
        copy = np.arange(len(d)) - np.repeat(first, np.diff(np.append(first, len(d))))
        again = copy > 0
        d[again] = mix64(d[again] + copy[again].astype(np.uint64) * CHECK)
    return d


class Sketches:
    """Tables of many texts or pairs of texts, side by side in three arrays."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells = np.asarray(cells, np.int64)
        self.base = np.append(0, np.cumsum(self.cells))
        n = int(self.base[-1])
        self.count, self.key, self.check = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    def add(self, owner: np.ndarray, d: np.ndarray, sign: np.ndarray) -> None:
        """Add (or take away, by sign) digests to their owners' tables."""
        third = (self.cells[owner] // TABLES).astype(np.uint64)
        check = mix64(d ^ CHECK)
        for t, salt in enumerate(SALTS):
            at = self.base[owner] + (mix64(d + salt) % third).astype(np.int64) + t * third.astype(np.int64)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, d)
            np.bitwise_xor.at(self.check, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Recovered digests by owner: how many with plus, how many with minus, and whether the table is empty then."""
        n = len(self.cells)
        owner_of = np.repeat(np.arange(n), self.cells)
        plus, minus = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = np.arange(len(self.count))
        while True:
            pure = at[(np.abs(self.count[at]) == 1)]
            pure = pure[self.check[pure] == mix64(self.key[pure] ^ CHECK)]
            if not len(pure):
                break
            owner, d, sign = owner_of[pure], self.key[pure], self.count[pure]
            order = np.lexsort((d, owner))
            owner, d, sign = owner[order], d[order], sign[order]
            new = np.append(True, (owner[1:] != owner[:-1]) | (d[1:] != d[:-1]))
            owner, d, sign = owner[new], d[new], sign[new]
            np.add.at(plus, owner[sign > 0], 1)
            np.add.at(minus, owner[sign < 0], 1)
            self.add(owner, d, -sign)
            # only tables that changed can have new pure cells
            live = np.zeros(n, bool)
            live[owner] = True
            at = np.flatnonzero(live[owner_of])
        dirty = (self.count != 0) | (self.key != 0) | (self.check != 0)
        failed = np.zeros(n, bool)
        failed[owner_of[dirty]] = True
        return plus, minus, ~failed

    def text(self, i: int) -> str:
        a, b = self.base[i], self.base[i + 1]
        cells = np.zeros(b - a, [("count", "<i4"), ("key", "<u8"), ("check", "<u4")])
        cells["count"], cells["key"], cells["check"] = self.count[a:b], self.key[a:b], self.check[a:b] & np.uint64(0xFFFFFFFF)
        return base64.b64encode(cells.tobytes()).decode()


def sketch_all(sets: list[np.ndarray], cells: int = CELLS) -> Sketches:
    s = Sketches(np.full(len(sets), cells))
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    if len(owner):
        s.add(owner, np.concatenate(sets), np.ones(len(owner), np.int64))
    return s


def difference(a: Sketches, b: Sketches) -> Sketches:
    """Cell by cell, for tables of equal shape."""
    out = Sketches(a.cells)
    out.count, out.key, out.check = a.count - b.count, a.key ^ b.key, a.check ^ b.check
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray], fa: Sketches, fb: Sketches) -> np.ndarray:
    """Share of both texts' paragraphs that the other one has, too, from peeled differences; 1 if both have none.

    ``fa`` and ``fb`` are the pairs' fingerprints; pairs that they can't decode are sketched again, GROWTH times larger each time.
    """
    size = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64)
    apart = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    cells = CELLS
    diff = difference(fa, fb)
    while len(open_):
        plus, minus, ok = diff.peel()
        apart[open_[ok]] = (plus + minus)[ok]
        open_ = open_[~ok]
        cells *= GROWTH
        diff = Sketches(np.full(len(open_), cells))
        for sets, sign in ((a, 1), (b, -1)):
            owner = np.repeat(np.arange(len(open_)), [len(sets[i]) for i in open_])
            if len(owner):
                diff.add(owner, np.concatenate([sets[i] for i in open_]), np.full(len(owner), sign))
    return np.where(size > 0, 1.0 - apart / np.maximum(1, size), 1.0)


def edited(text: str, other: str) -> str:
    """The last quarter of a text replaced by as much of the start of another."""
    k = len(text) // 4
    return text[: len(text) - k] + other[:k]


def _compare(rows: list[tuple[object, str, str]]) -> pa.RecordBatch:
    """Result rows of (doc_id, text, next text)."""
    texts = [r[1] for r in rows]
    changed = [edited(t, o) for _, t, o in rows]
    others = [r[2] for r in rows]
    known: dict[str, np.ndarray] = {}
    sets = []
    for group in (texts, changed, others):
        for t in group:
            if t not in known:
                known[t] = digests(t)
        sets.append([known[t] for t in group])
    prints = [sketch_all(s) for s in sets]
    near_edited = likeness(sets[0], sets[1], prints[0], prints[1])
    near_next = likeness(sets[0], sets[2], prints[0], prints[2])
    n = range(len(rows))
    return pa.record_batch(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
            pa.array([prints[0].text(i) for i in n]),
            pa.array([prints[1].text(i) for i in n]),
            pa.array(near_edited),
            pa.array(near_next),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Stands for a missing id in the order of documents.
NO_ID = -(2**63)


def range_cuts(docs: DataFrame, total: int, first: int) -> np.ndarray:
    """Smallest keys of ranges of about ``RANGE_BYTES`` of text; ``docs(k, text)``.

    Fine ranges of about as many rows each are put together by their bytes.
    """
    ranges = int(max(1, -(-total // RANGE_BYTES)))
    if ranges == 1:
        return np.array([first])
    fine = FINE * ranges
    found = docs.agg(F.percentile_approx("k", [i / fine for i in range(1, fine)], max(10_000, 20 * fine)).alias("q")).first().q
    bins = np.unique(np.append(found, first))

    @F.arrow_udf("int")
    def bin_of(k: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bins, k.to_numpy(zero_copy_only=False), side="right") - 1, pa.int32())

    held = np.zeros(len(bins))
    for r in docs.select("k", F.octet_length("text").alias("n")).groupBy(bin_of("k").alias("b")).agg(F.sum("n").alias("n")).collect():
        held[r.b] = r.n
    # a range ends where a further share of all bytes begins
    share = np.floor((np.cumsum(held) - held) / total * ranges)
    return bins[np.append(True, share[1:] != share[:-1])]


def compare_versions(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of an edited version, and their likeness to each other and the next document.

    The next document is the one with the next larger ``doc_id``, after the last the first; NULL ids come first, rows with equal ids follow by text hash.
    NULL texts are empty; two texts without words are alike (1.0). A table of one row is its own next; an empty
    one gives no rows. Whole texts are moved once: documents go to ranges of ids, one a task, and the first of each range also to
    the range before it. Rows of one id (or none) are one range.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(NO_ID)).alias("k"))
    total, first = docs.agg(F.sum(F.octet_length("text")), F.min("k")).first()
    if first is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    cuts = range_cuts(docs, total, first)
    last = len(cuts) - 1

    @F.arrow_udf("array<int>")
    def ranges_of(k: pa.Array) -> pa.Array:
        """A document's range, and the range before it if it is the first one there; the copy's number is made negative."""
        k = k.to_numpy(zero_copy_only=False)
        own = np.searchsorted(cuts, k, side="right") - 1
        return pa.array([[r, -1 - (r - 1 if r else last)] if cuts[r] == x else [r] for r, x in zip(own.tolist(), k.tolist())], pa.list_(pa.int32()))

    rows = docs.select("doc_id", "text", "k", F.explode(ranges_of("k")).alias("r"))
    rows = rows.select("doc_id", "text", "k", F.when(F.col("r") < 0, -1 - F.col("r")).otherwise(F.col("r")).alias("range"), (F.col("r") < 0).alias("copy"))
    rows = rows.repartitionById(len(cuts), F.col("range")).sortWithinPartitions("range", "copy", "k", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[object, str, str]] = []
        chars = 0
        before = None
        for b in batches:
            for row in zip(*(column_of(b, n).to_pylist() for n in ("doc_id", "text", "range", "copy"))):
                if before and before[2] == row[2] and not before[3]:
                    group.append((before[0], before[1], row[1]))
                    chars += len(before[1]) + len(row[1])
                    if len(group) >= GROUP or chars >= GROUP_CHARS:
                        yield _compare(group)
                        group, chars = [], 0
                before = row
        if group:
            yield _compare(group)

    return rows.mapInArrow(run, RESULT)
