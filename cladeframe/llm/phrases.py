"""Phrases whose words occur together more often than apart, counted exactly in two passes.

Most n-grams are rare, and a table of all of them is many times the text. So the first pass only finds which n-grams *can* be
frequent. N-grams are dealt to hash partitions; each has a Misra-Gries summary, a bounded set of counters. Summaries of chunks
are merged: counts are added, and where more than k counters are left, the (k+1)-th largest count is taken from all of them. What is
taken that way from any n-gram is at most mass / (k+1). With k = floor(mass / least) that is below ``least``, so every n-gram of at least ``least``
occurrences keeps a counter. What a summary knows it has taken (``error``) also rules counters out: count + error is never below the true count.

The second pass goes through the texts again and counts the survivors exactly, by their text. They are passed to the tasks
as a filter of a fixed largest size, in which the hash partitions own ranges of bits; what it lets through by chance is counted,
too, and falls out by its exact count.

Counts, scores and order of the phrases are DataFrame operations on the exact counts.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm.common import as_bytes, column_of, mix64, tidy
from cladeframe.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 21  # words that a task numbers together; three numbers below it fit in 64 bits
BLOCK = 1 << 20  # bytes of a text split at once
PART_BYTES = 1 << 23  # bytes of text that one hash partition stands for
MOST_BITS = 1 << 28  # bits of the filter, at most (32 MB)
BUCKETS = 256  # parts in which the phrases of one language are ranked first

_SEPARATOR = re.compile(rb"[\t \n-\r.,;:!?]")
#: Lower case, every end of a piece as a full stop, every blank as a space.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text with ``b'.'`` between pieces, in blocks that are cut between words."""
    at = 0
    while at < len(text):
        cut = _SEPARATOR.search(text, at + BLOCK) if at + BLOCK < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end].translate(_PLAIN).replace(b".", b" . ").split()
        at = end


class _Numbers(dict):
    """Numbers of words in the order they come; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class _Chunk:
    """Numbered words of one language. The first ``carry`` were counted before and only begin n-grams here."""

    def __init__(self, start: list[bytes]):
        self.numbers = _Numbers({b".": 0})
        self.parts: list[np.ndarray] = []
        self.size = 0
        self.carry = 0
        self.add(start)
        self.carry = len(start)

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def last(self, n: int) -> list[bytes]:
        """The words that an n-gram may go on from."""
        words = list(self.numbers)
        return [words[i] for i in np.concatenate(self.parts)[-n:].tolist()] if n else []


def chunks(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[tuple[str, _Chunk]]:
    """Rows ``lang, text`` as chunks of bounded size; a text may go over several, each of which begins with the ``reach`` last words."""
    held: dict[str, _Chunk] = {}
    size = 0
    for batch in batches:
        langs = column_of(batch, "lang").to_pylist()
        for lang, text in zip(langs, as_bytes(column_of(batch, "text"))):
            if lang not in held:
                held[lang] = _Chunk([])
            for block in tokens(text):
                held[lang].add(block)
                size += len(block)
                if size >= CHUNK:
                    rest = held[lang].last(reach)
                    yield from held.items()
                    held, size = {lang: _Chunk(rest)}, len(rest)
            held[lang].add([b"."])
            size += 1
    yield from held.items()


def windows(lang: str, chunk: _Chunk, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1 to ``most``: numbers of all words, starts of the n-grams and their 64-bit hashes."""
    ids = np.concatenate(chunk.parts)
    seed = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
    word = np.fromiter(map(xxhash.xxh64_intdigest, chunk.numbers), np.uint64, len(chunk.numbers))[ids]
    inside = ids != 0
    hashes, whole = mix64(word ^ seed), inside
    for n in range(1, most + 1):
        if n > 1:
            whole = whole[:-1] & inside[n - 1 :]
            hashes = mix64(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[n - 1 :])
        starts = np.flatnonzero(whole[max(0, chunk.carry - n + 1) :]) + max(0, chunk.carry - n + 1)
        yield ids, starts, hashes[starts]


# --- first pass ------------------------------------------------------------------


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 32-bit keys and their counts, a byte each where they are small."""
    large = counts[counts >= 255].astype(np.int64)
    return b"".join([keys.astype(np.uint32).tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(), large.tobytes()])


def unpacked(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(data, np.uint32, size)
    counts = np.frombuffer(data, np.uint8, size, 4 * size).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, np.int64, -1, 5 * size)
    return keys, counts


def partial_counts(batches: Iterator[pa.RecordBatch], most: int, log_parts: int) -> Iterator[pa.RecordBatch]:
    """Counts of hashed n-grams for each chunk and hash partition, and at the end the mass of each partition in this task."""
    parts = 1 << log_parts
    mass = np.zeros(parts, np.int64)
    names = ["part", "mass", "size", "counts"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def rows(part, mass, size, counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((part, mass, size, counts), types)], names=names)

    for lang, chunk in chunks(batches, most - 1):
        found, counts = np.unique(np.concatenate([h for _, _, h in windows(lang, chunk, most)]), return_counts=True)
        # the upper bits are the partition, the next 32 the key in it
        ends = np.searchsorted(found >> np.uint64(64 - log_parts), np.arange(parts + 1, dtype=np.uint64)) if log_parts else np.array([0, len(found)])
        mass += np.diff(np.concatenate([[0], np.cumsum(counts)])[ends])
        keys = (found << np.uint64(log_parts)) >> np.uint64(32)
        full = np.flatnonzero(np.diff(ends))
        yield rows(full, np.zeros(len(full), np.int64), np.diff(ends)[full], [packed(keys[ends[p] : ends[p + 1]], counts[ends[p] : ends[p + 1]]) for p in full])
    full = np.flatnonzero(mass)
    yield rows(full, mass[full], np.zeros(len(full), np.int32), [None] * len(full))


class Summary:
    """Misra-Gries counters of 32-bit keys, at most ``capacity`` after a merge."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0
        self.error = 0  # what was taken from any key, at most

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(self.capacity, 1 << 16):
            self.merge()

    def merge(self) -> None:
        """Put what waits, which is a summary without error each, into the counters."""
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.size = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys = keys[first]
        self.counts = np.add.reduceat(counts, first) if len(first) else counts
        over = len(self.keys) - self.capacity
        if over > 0:
            taken = int(np.partition(self.counts, over - 1)[over - 1])
            self.error += taken
            kept = self.counts > taken
            self.keys, self.counts = self.keys[kept], self.counts[kept] - taken

    def survivors(self, least: int) -> np.ndarray:
        """Keys that may occur ``least`` times."""
        self.merge()
        return self.keys[self.counts + self.error >= least]


def places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Two bits of a partition's range for each 32-bit key."""
    mixed = mix64(keys.astype(np.uint64) + np.uint64(1))
    yield mixed & np.uint64(bits - 1)
    yield (mixed >> np.uint64(32)) & np.uint64(bits - 1)


def summaries(batches: Iterator[pa.RecordBatch], least: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Survivors of each hash partition as its range of the filter; rows come sorted by partition, masses first."""
    part, mass, summary = None, 0, None

    def closed() -> pa.RecordBatch:
        filled = np.zeros(bits, np.uint8)
        keys = summary.survivors(least) if summary else np.zeros(0, np.uint32)
        for at in places(keys, bits):
            filled[at] = 1
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([np.packbits(filled, bitorder="little").tobytes()], pa.binary())],
            names=["part", "survivors", "bits"],
        )

    for batch in batches:
        columns = [column_of(batch, c) for c in ("part", "mass", "size", "counts")]
        for i in range(batch.num_rows):
            p, m, size, data = (c[i].as_py() for c in columns)
            if p != part:
                if part is not None:
                    yield closed()
                part, mass, summary = p, 0, None
            if data is None:
                mass += m
                continue
            # all masses are known once the first counts come
            summary = summary or Summary(mass // least)
            summary.add(*unpacked(data, size))
    if part is not None:
        yield closed()


# --- second pass -----------------------------------------------------------------


def exact_counts(batches: Iterator[pa.RecordBatch], most: int, log_parts: int, bits: int, data: bytes) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams that the filter lets through, by text, for each chunk; ``words`` 0 has the number of all words."""
    filled = np.frombuffer(data, np.uint8)

    def rows(lang: str, n: int, phrase: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(phrase), pa.string()), pa.array(np.full(len(phrase), n), pa.int32()), phrase, pa.array(counts, pa.int64())],
            names=["lang", "words", "phrase", "n"],
        )

    for lang, chunk in chunks(batches, most - 1):
        texts = pa.array(list(chunk.numbers), pa.binary()).cast(pa.string())
        for n, (ids, starts, hashes) in enumerate(windows(lang, chunk, most), 1):
            if n == 1:
                yield rows(lang, 0, pa.array([""]), np.array([len(starts)]))
            part = hashes >> np.uint64(64 - log_parts) if log_parts else np.zeros(len(hashes), np.uint64)
            through = np.ones(len(hashes), bool)
            for at in places((hashes << np.uint64(log_parts)) >> np.uint64(32), bits):
                at = part * np.uint64(bits) + at
                through &= (filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            starts = starts[through]
            if not len(starts):
                continue
            if len(texts) ** n < 1 << 63:
                code = np.zeros(len(starts), np.int64)
                for k in range(n):
                    code = code * len(texts) + ids[starts + k]
                distinct, counts = np.unique(code, return_counts=True)
                columns = []
                for _ in range(n):
                    distinct, at = np.divmod(distinct, len(texts))
                    columns.append(at)
                columns.reverse()
            else:
                distinct, counts = np.unique(np.stack([ids[starts + k] for k in range(n)], axis=1), axis=0, return_counts=True)
                columns = list(distinct.T)
            words = [texts.take(pa.array(at)) for at in columns]
            yield rows(lang, n, pc.binary_join_element_wise(*words, " ") if n > 1 else words[0], counts)


def frequent(docs: DataFrame, group: str = "lang", most: int = 3, least: int = 10, unknown: str = "und") -> DataFrame:
    """All phrases of 1 to ``most`` words with at least ``least`` occurrences: ``lang, words, phrase, n``; ``words`` 0: number of all words.

    ``docs(text, <group>)``; A-Z are lower-cased, phrases don't go over the ends of pieces. A NULL text is empty, a NULL group is ``unknown``. Repeated rows count each.
    Other columns are not looked at. A text may be of any length and is worked on in blocks. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(group).cast("string"), F.lit(unknown)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log_parts = max(4, (total // PART_BYTES).bit_length())
    bits = max(64, min(MOST_BITS, 1 << (total // 8).bit_length()) >> log_parts)
    partial = texts.mapInArrow(tidy(lambda b: partial_counts(b, most, log_parts)), "part int, mass bigint, size int, counts binary")
    # masses, which have no counts, sort before the counts
    dealt = partial.repartitionById(1 << log_parts, F.col("part")).sortWithinPartitions("part", F.col("counts").isNotNull())
    found = dealt.mapInArrow(tidy(lambda b: summaries(b, least, bits)), "part int, survivors bigint, bits binary").collect()
    data = np.zeros((1 << log_parts, bits // 8), np.uint8)
    for r in found:
        data[r.part] = np.frombuffer(r.bits, np.uint8)
    sent = spark.sparkContext.broadcast(data.tobytes())
    counted = texts.mapInArrow(
        tidy(lambda b: exact_counts(b, most, log_parts, bits, sent.value)), "lang string, words int, phrase string, n bigint"
    )
    return counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | ((F.col("words") == 0) & (F.col("n") > 0)))


def collocations(
    docs: DataFrame, group: str = "lang", most: int = 3, least: int = 10, inside: int = 50, top: int = 2000, unknown: str = "und",
) -> DataFrame:
    """The ``top`` phrases of each group: ``lang, rank, phrase, a, l, r, n, score``.

    A candidate has 2 to ``most`` words and a >= ``least`` occurrences. Cut after its first k words, its parts occur l and r times; the cut of lowest
    ``floor(1000000 a a / (l r))`` counts, the smallest k among equals. A candidate inside a longer one with at least ``inside`` percent of its occurrences is
    dropped. Rank is by score, then a, both falling, then the phrase in order of its bytes. n counts all words of the group. Arithmetic is in 38 decimal
    digits, which holds for counts below 10^16. Nulls, empty tables and other columns: see ``frequent``.
    """
    counts = materialise(frequent(docs, group, most, least, unknown), "phrases")
    phrases = counts.where("words > 0").drop("words")
    pieces = F.split("phrase", " ")
    candidates = counts.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), pieces.alias("w"))
    size = F.size("w")
    # every way to cut a candidate asks for the counts of its two parts
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    asked = cuts.select(
        "lang", "phrase", "a", "k",
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("first"), F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("part")),
                F.struct(F.lit(False).alias("first"), F.array_join(F.slice("w", F.col("k") + 1, size), " ").alias("part")),
            )
        ).alias("q"),
    ).select("lang", "phrase", "a", "k", "q.*")
    parts = phrases.select(F.col("lang").alias("p_lang"), F.col("phrase").alias("p_phrase"), F.col("n").alias("f"))
    answered = asked.join(parts, (F.col("lang") == F.col("p_lang")) & (F.col("part") == F.col("p_phrase")))
    by_cut = answered.groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r")
    )
    score = F.expr("(1000000 * cast(a AS decimal(16,0)) * cast(a AS decimal(16,0))) div (cast(l AS decimal(16,0)) * cast(r AS decimal(16,0)))")
    best = by_cut.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("best")
    )
    within = candidates.where(size > 2).select(
        "lang",
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(2), size - 1),
                    lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda at: F.array_join(F.slice("w", at, m), " ")),
                )
            )
        ).alias("phrase"),
        F.col("a").alias("longer"),
    ).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(within, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < %d * a" % inside)
    # first by parts of a group, so no task ranks all phrases of a large one
    part = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)).alias("part")
    flat = kept.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"), part)
    first = _ranked(_ranked(flat, ["lang", "part"], top).drop("rank", "part"), ["lang"], top)
    all_words = counts.where("words = 0").select("lang", "n")
    return first.join(all_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _ranked(phrases: DataFrame, keys: list[str], top: int) -> DataFrame:
    """The first ``top`` of each group with their ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
    return phrases.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
