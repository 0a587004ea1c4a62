"""Best-fit packing of token pieces into sequences, with certified bin counts.

Every partition of pieces is packed by best-fit decreasing. Dual feasible functions give a number of sequences that
no packing of the partition can undercut; where the packing reaches it, the partition is done. The other
partitions keep their full sequences and exchange the pieces of the open ones, which are packed
again together, as long as that saves sequences.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm.common import as_bytes, column_of, tidy
from cladeframe.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
#: Pieces that are packed together, on average.
PART = 50_000
#: Encoded words and parts of words that a worker remembers; beyond it, it starts afresh.
REMEMBERED = 1_000_000
#: Words encoded at once.
TOGETHER = 2000
#: Bytes of text that are looked through for new words at once.
GROUP_BYTES = 4 << 20
#: Symbols that end a word's token wherever they meet a letter or digit.
SYMBOLS = b".,;:!?*$%&#()+-=/|\"[]{}_~@^"
END = b"\0\0\0\0"


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, so that its next tasks find it again."""
    return vars(sys.modules.setdefault("cladeframe_worker_state", types.ModuleType("cladeframe_worker_state")))


class WordCache:
    """Token ids of texts, little-endian 32-bit, each distinct word being encoded once in a worker.

    Words are runs between ASCII blanks; the tokenizer drops blanks, ignores case and never joins characters across blanks, nor
    symbols with a letter or digit beside them, so a word's outer symbols are encoded apart.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.normalized)]
        #: A special token and its id, which part words that are encoded in one go; the library is faster on long texts.
        self.mark = special[0] if special else None
        #: Ids of words and of their parts; a part is a word that isn't cut.
        self.ids: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordCache:
        state = worker_state()
        if path not in state:
            state[path] = cls(path)
        return state[path]

    def cut(self, word: bytes) -> list[bytes]:
        if word.isalpha():  # ASCII letters only
            return [word.lower()]
        if b"<|" in word:  # may hold a special token, which is looked for before anything else
            return [word]
        low = word.lower()
        tail = low.lstrip(SYMBOLS)
        core = tail.rstrip(SYMBOLS)
        text = core.decode("utf-8", "replace")
        if not core or not (text[0].isalnum() and text[-1].isalnum()):
            return [low]
        return [x for x in (low[: len(low) - len(tail)], core, tail[len(core) :]) if x]

    def learn(self, texts: list[bytes]) -> list[list[bytes]]:
        """Encode what is new in the texts; gives their words."""
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
        split = [t.split() for t in texts]
        new: set[bytes] = set()
        for ws in split:
            new.update(ws)
        new -= self.ids.keys()
        cuts = {w: self.cut(w) for w in new}
        parts = list({p for c in cuts.values() for p in c} - self.ids.keys())
        for at in range(0, len(parts), TOGETHER):
            some = parts[at : at + TOGETHER]
            self.ids.update(zip(some, self.encode_words([p.decode("utf-8", "replace") for p in some])))
        known = self.ids
        for w, c in cuts.items():
            if w not in known:
                known[w] = known[c[0]] if len(c) == 1 else b"".join([known[p] for p in c])
        return split

    def encode_words(self, words: list[str]) -> list[bytes]:
        if self.mark and not any(self.mark[1] in w for w in words):
            found = self.tokenizer.encode_batch_fast([self.mark[1].join(words)], add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids)).tolist()
            if len(ends) == len(words):
                data = ids.tobytes()
                return [data[4 * a + 4 : 4 * b] for a, b in zip([-1, *ends], ends)]
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def encode(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """Ids of each text; texts are learned in groups of bounded size."""
        group: list[bytes] = []
        size = 0
        for t in chain(texts, [None]):
            if t is not None:
                group.append(t)
                size += len(t)
            if size > GROUP_BYTES or (t is None and group):
                split, ids = self.learn(group), self.ids
                for ws in split:
                    yield b"".join(map(ids.__getitem__, ws))
                group, size = [], 0


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: ``doc_id, piece, start, length, ids_crc32``, and ``ids`` if asked for.

    A document is the ids of its text and one id 0. NULL and empty texts are one piece of length 1. Only what
    is longer than the capacity is cut.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache.of(path)
        for b in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, data in enumerate(cache.encode(as_bytes(column_of(b, "text")))):
                data += END
                for p, s in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[s : s + 4 * capacity]
                    at.append(i)
                    piece.append(p)
                    start.append(s // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            out = [column_of(b, "doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32())]
            out += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.record_batch(out, names=names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, in the given order, each into the fullest bin that takes it; and the number of bins."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has room r
    bins = 0
    which, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths):
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, bins
            bins += 1
        which[i], offset[i] = b, capacity - r
        r -= n
        if r:
            room[r].append(b)
            mask |= 1 << r
    return which, offset, bins


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Largest bound of two families of dual feasible functions.

    The first counts lengths above capacity - t as whole bins and drops those below t; the second rounds
    (k + 1) x down to k-ths of a bin unless it is whole.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    number, mass = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(count * np.arange(capacity + 1)))
    t = np.arange(capacity // 2 + 1)
    whole = number[-1] - number[capacity - t + 1]
    middle = mass[capacity - t + 1] - mass[t]
    best = int((whole + -(-middle // capacity)).max())
    x = np.arange(capacity + 1)
    for k in range(1, 101):
        exact = (k + 1) * x % capacity == 0
        # in units of 1 / (k * capacity)
        value = np.where(exact, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, int(-(-int((count * value).sum()) // (k * capacity))))
    return best


def _pack(table: pa.Table, capacity: int) -> pa.Table:
    """Pack the pieces of one part; adds where each piece goes, how full its bin is, and the part's bins and bound."""
    length = table.column("length").to_numpy()
    crc = table.column("ids_crc32").to_numpy()
    ids = table.column("doc_id").fill_null(0).to_numpy()
    order = np.lexsort((crc, table.column("piece").to_numpy(), ids, -length))
    which, offset, bins = best_fit(length[order].tolist(), capacity)
    fill = np.bincount(which, weights=length[order], minlength=bins).astype(np.int64)
    table = table.take(pa.array(order))
    n = len(order)
    for name, values in (
        ("bin", which), ("offset", offset), ("fill", fill[which]), ("bins", np.full(n, bins)), ("bound", np.full(n, lower_bound(length, capacity)))
    ):
        table = table.append_column(name, pa.array(values, pa.int64()))
    return table


def pack(pieces: DataFrame, capacity: int = CAPACITY, part: int = PART) -> DataFrame:
    """Add ``sequence_id, offset`` to ``doc_id, piece, start, length, ids_crc32``.

    Pieces as long as the capacity are sequences of their own. Repeated pieces are pieces of their own; an empty
    table gives no rows. ``certified`` says whether the piece's last part reached its lower bound.
    """
    pieces = pieces.select("doc_id", "piece", "start", "length", "ids_crc32")
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema]
    schema = ", ".join([*columns, "part bigint", "bin bigint", "offset bigint", "fill bigint", "bins bigint", "bound bigint"])

    def packed(df: DataFrame) -> DataFrame:
        return materialise(df.groupBy("part").applyInArrow(lambda t: _pack(t, capacity), schema), "packed")

    pieces = materialise(pieces, "pieces")
    full = pieces.where(F.col("length") >= capacity).select(
        *pieces.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified")
    )
    rest = pieces.where(F.col("length") < capacity)
    parts = max(1, -(-rest.count() // part))
    # equal pieces are dealt out over the parts, too
    deal = F.pmod(F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)) + F.spark_partition_id(), F.lit(parts))
    now = packed(rest.withColumn("part", deal))
    done = [full]

    def settle(df: DataFrame, round_: int) -> None:
        number = F.lit(round_).cast("long") * 2**56 + F.col("part") * 2**24 + F.col("bin")
        done.append(df.select(*pieces.columns, number.alias("sequence_id"), "offset", (F.col("bins") == F.col("bound")).alias("certified")))

    round_ = 0
    while True:
        gaps = now.where("bins > bound").select("part").distinct().count()
        if gaps < 2:
            settle(now, round_)
            break
        open_ = now.where((F.col("bins") > F.col("bound")) & (F.col("fill") < capacity))
        # parts meet in groups whose open pieces are about one part; dealt by rank, so none is alone, which would change nothing
        groups = max(1, min(gaps // 2, -(-open_.count() // part)))
        rank = F.row_number().over(Window.orderBy(F.xxhash64("part", F.lit(round_)), "part")) - 1
        ranked = now.where("bins > bound").select("part").distinct().withColumn("group", (rank % groups).cast("long"))
        ranked = materialise(ranked, "groups")
        open_ = open_.join(ranked, "part")
        before = open_.groupBy("group").agg(F.countDistinct("part", "bin").alias("old_bins"))
        again = packed(open_.withColumn("part", F.col("group")).select(*pieces.columns, "part"))
        after = again.groupBy("part").agg(F.max("bins").alias("new_bins"))
        better = before.join(after, before.group == after.part).where("new_bins < old_bins").select("group")
        better = materialise(better, "better")
        if not better.limit(1).count():
            settle(now, round_)
            break
        moved = (F.col("bins") > F.col("bound")) & (F.col("fill") < capacity)
        keyed = now.join(ranked, "part", "left").withColumn("group", F.when(moved, F.col("group")))
        settle(keyed.join(better, "group", "left_anti"), round_)
        now = again.join(better, again.part == better.group, "left_semi")
        round_ += 1
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, part: int = PART) -> DataFrame:
    return pack(token_pieces(docs, path, capacity), capacity, part)
