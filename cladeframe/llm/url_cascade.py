"""URL filters as Bloom filter cascades.

The first filter holds the listed keys. Keys of the corpus that it takes by mistake go into the second one, listed keys
that the second takes by mistake into the third, and so on until no mistake is left. A key's answer is the parity of
the first filter that refuses it, which is exact for every key of the corpus. Judging needs no join: rows meet only the filters.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm.common import by_value, column_of, mix64
from cladeframe.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits a key and hash functions of the first filter, and of the later ones.
FIRST = (16, 8)
LATER = (4, 2)
#: Filters larger than this are not sent to the tasks; the exact join takes their place.
MOST_BYTES = 256 << 20


@dataclass
class Level:
    bits: np.ndarray
    size: int
    hashes: int
    number: int

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), bool)
        for at in places(h1, h2, self.size, self.hashes, self.number):
            found &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def places(h1: np.ndarray, h2: np.ndarray, size: int, hashes: int, number: int) -> Iterator[np.ndarray]:
    a = mix64(h1 + np.uint64(number))
    b = mix64(h2 ^ np.uint64(number)) | np.uint64(1)
    for j in range(hashes):
        yield mix64(a + np.uint64(j) * b) % np.uint64(size)


def listed(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is in the list the cascade was built for."""
    answer = np.full(len(h1), len(levels) % 2 == 1)
    open_ = np.arange(len(h1))
    for level in levels:
        has = level.has(h1[open_], h2[open_])
        answer[open_[~has]] = level.number % 2 == 1
        open_ = open_[has]
    return answer


def hashes_of(key: Column) -> list[Column]:
    """128 bits of a key, as two numbers."""
    return [F.xxhash64(key), F.xxhash64(F.lit(1), key)]


def _named(key: Column) -> list[Column]:
    return [h.alias(n) for h, n in zip(hashes_of(key), ("h1", "h2"))]


def _unsigned(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(column_of(batch, n).to_numpy(zero_copy_only=False).view(np.uint64) for n in ("h1", "h2"))


def _filter(keys: DataFrame, n: int, number: int) -> Level:
    """A Bloom filter of n keys; tasks make words of bits, Spark joins the words."""
    per_key, hashes = LATER if number else FIRST
    size = max(64, -(-n * per_key // 64) * 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(list(places(*_unsigned(b), size, hashes, number)))
            word, where = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, where, np.uint64(1) << (at & np.uint64(63)))
            yield pa.record_batch([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    words = keys.mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bits = np.zeros(size // 64, np.int64)
    for r in words.toLocalIterator():
        bits[r.word] = r.bits
    return Level(bits.view(np.uint64), size, hashes, number)


def build(keys: DataFrame, universe: DataFrame, most_bytes: int = MOST_BYTES) -> list[Level] | None:
    """Cascade for the listed ``key`` rows over the keys of ``universe``; None if its filters pass the size bound."""
    positive = materialise(keys.select("key").distinct().select(*_named(F.col("key"))), "listed-keys")
    negative = universe.select("key").distinct().join(keys.select("key"), "key", "left_anti").select(*_named(F.col("key")))
    negative = materialise(negative, "other-keys")
    levels: list[Level] = []
    sides = [positive, negative]
    held = 0
    while n := sides[0].count():
        held += n * (LATER if levels else FIRST)[0] // 8
        if held > most_bytes:
            return None
        level = _filter(sides[0], n, len(levels))
        levels.append(level)
        if len(levels) > 200:
            raise ValueError("two keys have one 128-bit hash")
        sent = by_value(sides[1].sparkSession, level)

        def taken(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(sent().has(*_unsigned(b))))

        sides = [materialise(sides[1].mapInArrow(taken, "h1 bigint, h2 bigint"), "mistaken-keys"), sides[0]]
    return levels


def split_url(url: str) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All keys that could be a rule for a URL, the longest first.

    A key is a host's last labels, for each number of labels that rules have, and a path's
    first characters, for each length of path that rules have.
    """
    parts = F.split(host, r"\.")
    found = []
    for n in labels:
        suffix = F.array_join(F.slice(parts, -n, n), ".")
        for m in lengths:
            fits = (F.size(parts) >= n) & (F.length(path) >= m)
            found.append(F.when(fits, F.struct((-F.length(suffix) - m).alias("a"), F.lit(m).alias("b"), F.concat(suffix, F.substring(path, 1, m)).alias("key"))))
    ordered = F.array_sort(F.array_compact(F.array(*found)))
    return F.transform(ordered, lambda x: x["key"])


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Add ``host, path, rule, verdict`` to rows with a ``url``; ``rules`` has ``host, path, verdict`` (block or allow).

    A rule fits its host and all subdomains where the path starts with the rule's; the longest fitting rule
    decides, of equally long ones the one with the longer host; a rule listed with both verdicts blocks. URLs that no rule fits
    get the default. NULL URLs and such without ``://`` have empty host and path, which no rule fits. Rules with NULLs
    are left out. Repeated rows stay; empty tables give no rows.
    """
    spark = urls.sparkSession
    host, path = split_url("url")
    rules = materialise(rules.dropna(subset=["host", "path"]).withColumn("key", F.concat("host", "path")), "rules")
    shape = rules.select(F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("m")).distinct().collect()
    rows = urls.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    if not shape:
        keys = F.expr("cast(array() as array<string>)")
    else:
        keys = candidate_keys(F.col("host"), F.col("path"), sorted({r.n for r in shape}), sorted({r.m for r in shape}))
    rows = rows.withColumn("keys", keys)
    universe = materialise(rows.select(F.explode("keys").alias("key")).distinct(), "corpus-keys")
    every = build(rules, universe, most_bytes)
    blocks = build(rules.where("verdict = 'block'"), rules, most_bytes)
    if every is None or blocks is None:
        return _judge_by_join(urls, rows, rules, default)
    sent = by_value(spark, (every, blocks))

    @F.arrow_udf("struct<place: int, block: boolean>")
    def decide(h1: pa.Array, h2: pa.Array) -> pa.Array:
        every, blocks = sent()
        n = len(h1)
        start = h1.offsets.to_numpy() - h1.offsets[0].as_py()
        row = np.repeat(np.arange(n), np.diff(start))
        h1, h2 = (h.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for h in (h1, h2))
        hit = np.flatnonzero(listed(every, h1, h2))
        first = np.full(n, -1)
        first[row[hit][::-1]] = hit[::-1]  # a row's first hit is written last
        found = np.flatnonzero(first >= 0)
        place, block = np.full(n, -1, np.int32), np.zeros(n, bool)
        place[found] = first[found] - start[found]
        block[found] = listed(blocks, h1[first[found]], h2[first[found]])
        return pa.StructArray.from_arrays([pa.array(place), pa.array(block)], names=["place", "block"])

    def hashes(n: int) -> Column:
        return F.transform("keys", lambda k: hashes_of(k)[n])

    judged = rows.withColumn("found", decide(hashes(0), hashes(1)))
    rule = F.when(F.col("found.place") >= 0, F.get("keys", F.col("found.place")))
    verdict = F.when(F.col("found.place") < 0, F.lit(default)).when(F.col("found.block"), "block").otherwise("allow")
    return judged.select(*_carried(urls), "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _carried(urls: DataFrame) -> list[Column]:
    """The rows' own columns, but for those that the result names itself."""
    return [F.col("row")[c].alias(c) for c in urls.columns if c not in ("host", "path", "rule", "verdict")]


def _judge_by_join(urls: DataFrame, rows: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The exact way for lists whose filters are too large to send: the corpus's distinct keys meet the rules."""
    known = rules.groupBy("key").agg(F.min(F.col("verdict") != "block").alias("allowed"))
    rows = materialise(rows, "url-rows")
    sets = rows.select("keys").distinct()
    hits = sets.select("keys", F.posexplode("keys").alias("place", "key")).join(known, "key")
    best = hits.groupBy("keys").agg(F.min(F.struct("place", "key", "allowed")).alias("best"))
    best = best.withColumnRenamed("keys", "known_keys")
    joined = rows.join(best, rows["keys"] == best["known_keys"], "left")
    verdict = F.when(F.col("best").isNull(), F.lit(default)).otherwise(F.when(F.col("best.allowed"), "allow").otherwise("block"))
    return joined.select(*_carried(urls), "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table from ``(verdict, host, path)``."""
    return spark.createDataFrame([(h, p, v) for v, h, p in rules], "host string, path string, verdict string")
