"""Array arithmetic that runs inside tasks.

These functions travel to the executors by value, so a cluster needs nothing
installed but Spark's own Python dependencies.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from string import ascii_uppercase, digits

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


Merge = tuple[np.ndarray, np.ndarray, np.ndarray]


def downpass(parent: np.ndarray, states: np.ndarray) -> Iterator[Merge]:
    """Merges of T trees (T x branches) on P patterns (taxa x P), children before parents.

    Yields the branch, state sets (T x P) and changes (T x P) of one merge of every
    tree at a time; the last is the root's, whose changes include its own states.
    Absent branches are -2.
    """
    n_trees, n_branches = parent.shape
    n = (n_branches + 3) // 2
    rows = np.arange(n_trees)[:, None]
    # sorting by parent puts sisters side by side, the root's own entry first
    last = np.where(parent == -2, n_branches + 1, parent)
    order = np.argsort(last, axis=1, kind="stable")
    present = int((parent[0] != -2).sum())
    pairs = order[:, 1:present].reshape(n_trees, -1, 2)
    parents = parent[rows[:, :, None], pairs][:, :, 0]
    depth = np.zeros((n_trees, n_branches), dtype=np.int32)
    at = np.broadcast_to(np.arange(n_branches), parent.shape).copy()
    for _ in range(n_branches):
        above = parent[rows, at]
        inner = above >= 0
        if not inner.any():
            break
        depth += inner
        at = np.where(inner, above, at)
    sequence = np.argsort(-depth[rows, parents], axis=1, kind="stable")
    value = np.zeros((n_trees, n_branches, states.shape[1]), dtype=np.uint8)
    value[:, :n] = states[None, :n]
    flat = np.arange(n_trees)
    for k in range(sequence.shape[1]):
        s = sequence[:, k]
        node = parents[flat, s]
        a, b = value[flat, pairs[flat, s, 0]], value[flat, pairs[flat, s, 1]]
        both = a & b
        change = (both == 0).astype(np.uint8)
        merged = np.where(change, a | b, both)
        if k < sequence.shape[1] - 1:
            value[flat, node] = merged
        else:
            change += (merged & value[flat, node]) == 0
        yield node, merged, change


_NIBBLE = np.zeros(256, dtype=np.uint8)
for _i, _c in enumerate(b"0123456789ABCDEF"):
    _NIBBLE[_c] = _i

_CELLS = 4_000_000  # cells of the working array held at once


def listed_parents(packs: pa.Array, i: int) -> np.ndarray:
    """Trees of a pack that has them as lists."""
    trees = packs[i].values
    lo, hi = trees.offsets[0].as_py(), trees.offsets[len(trees)].as_py()
    return trees.values.slice(lo, hi - lo).to_numpy(zero_copy_only=False).reshape(len(trees), -1)


def _pairs(batch: pa.RecordBatch, parents_of) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, first tree, parent arrays, states and weights of each row, in slices that fit the working array."""
    packs, raw, weights = batch.column("_parents"), batch.column("_bytes"), batch.column("_weights")
    for i in range(batch.num_rows):
        parent = parents_of(packs, i)
        n = (parent.shape[1] + 3) // 2
        weight = weights[i].values.to_numpy(zero_copy_only=False)
        found = _NIBBLE[np.frombuffer(raw[i].as_py(), dtype=np.uint8)]
        if len(found) != n * len(weight):
            raise ValueError(f"alignment {batch.column('alignment_id')[i]}: patterns and trees differ in their taxa")
        if not found.all():
            raise ValueError(f"alignment {batch.column('alignment_id')[i]}: a pattern has a cell without a nucleotide set")
        states = np.ascontiguousarray(found.reshape(-1, n).T)
        step = max(1, _CELLS // max(1, parent.shape[1] * states.shape[1]))
        for start in range(0, len(parent), step):
            yield i, start, parent[start : start + step], states, weight


def lengths_of(parent: np.ndarray, states: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One number per tree: changes over all patterns."""
    # a pattern all taxa agree on never needs a change
    open_ = np.bitwise_and.reduce(states, axis=0) == 0
    total = np.zeros((len(parent), 1), dtype=np.int64)
    for _, _, change in downpass(parent, np.ascontiguousarray(states[:, open_])):
        total[:, 0] += change @ weight[open_]
    return total


def site_changes_of(parent: np.ndarray, states: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Changes per tree and pattern."""
    total = np.zeros((len(parent), states.shape[1]), dtype=np.int64)
    for _, _, change in downpass(parent, states):
        total += change
    return total


def branch_changes_of(parent: np.ndarray, states: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Changes per tree and branch over all patterns; -1 on branches without a merge."""
    out = np.full(parent.shape, -1, dtype=np.int64)
    for node, _, change in downpass(parent, states):
        out[np.arange(len(parent)), node] = change @ weight
    return out


def inner_states_of(parent: np.ndarray, states: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """State sets per tree of every inner branch (in branch order) and pattern, flat."""
    n, width = states.shape
    out = np.zeros((len(parent), parent.shape[1] - n, width), dtype=np.int64)
    for node, merged, _ in downpass(parent, states):
        inner = np.flatnonzero(node >= n)
        out[inner, node[inner] - n] = merged[inner]
    return out.reshape(len(parent), -1)


def scoring_batches(measure, passed: list[str], parents_of=listed_parents):
    """Task function: a pack of trees and a block of patterns to one array of numbers per tree.

    Out: the ``passed`` columns, ``_first`` (the first tree of a slice of the pack) and ``_values``. A batch is closed before
    its numbers pass what a slice may hold, so offsets stay small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, first, found = [], [], []

            def closed() -> pa.RecordBatch:
                numbers = np.concatenate([v.ravel() for v in found])
                inner = np.concatenate([[0], np.cumsum(np.concatenate([np.full(len(v), v.shape[1]) for v in found]))])
                outer = np.concatenate([[0], np.cumsum([len(v) for v in found])])
                per_tree = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(numbers, pa.int64()))
                values = pa.ListArray.from_arrays(pa.array(outer, pa.int32()), per_tree)
                at = pa.array(rows)
                return pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(at) for c in passed), pa.array(first, pa.int32()), values], names=[*passed, "_first", "_values"]
                )

            size = 0
            for i, start, parent, states, weight in _pairs(batch, parents_of):
                rows.append(i)
                first.append(start)
                found.append(measure(parent, states, weight))
                size += found[-1].size
                if size >= _CELLS:
                    yield closed()
                    rows, first, found, size = [], [], [], 0
            if rows:
                yield closed()

    return run


def pack_batches(batches: Iterator[pa.RecordBatch], group: str, budget: int, final: bool) -> Iterator[pa.RecordBatch]:
    """Put rows of a group together in packs of about ``budget`` units, as they come.

    In: ``group, _units, _row`` (a struct); with ``final`` rows are packs already, and ``_row`` is a list of structs. Out: ``group``, ``_units`` of the
    pack and ``_rows``. What a task holds open is bounded: beyond that, all open packs are closed.
    """
    open_: dict = {}
    total = 0

    def closed(names: list) -> pa.RecordBatch:
        units = [open_[k][1] for k in names]
        parts = [pa.concat_arrays(open_.pop(k)[0]) for k in names]
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(parts))
        return pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(units, pa.int64()), lists], names=[group, "_units", "_rows"])

    kind = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(group)
        kind = keys.type
        coded = keys.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        units = batch.column("_units").to_numpy(zero_copy_only=False)
        rows = batch.column("_rows" if final else "_row")
        order = np.argsort(code, kind="stable")
        bounds = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0, [True]]))
        full = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            name = coded.dictionary[int(code[order[lo]])].as_py()
            # cut where the units pass a further multiple of the budget
            own = order[lo:hi]
            cuts = np.flatnonzero(np.diff((np.cumsum(units[own]) - 1) // budget) > 0) + 1
            for part in np.split(own, cuts):
                taken = rows.take(pa.array(part))
                held = open_.setdefault(name, [[], 0])
                held[0].append(taken.flatten() if final else taken)
                more = int(units[part].sum())
                held[1] += more
                total += more
                if held[1] >= budget:
                    total -= held[1]
                    full.append(closed([name]))
        yield from full
        if total > 64 * budget:
            yield closed(list(open_))
            total = 0
    if open_:
        yield closed(list(open_))


# --- cooling epochs: state = accepted * max_propose + proposed -----------------


def _boundaries(accepted: np.ndarray, max_accept: int, max_propose: int) -> tuple[np.ndarray, np.ndarray]:
    """Where an epoch that starts fresh at row s ends (exclusive; beyond the rows if it does not)."""
    rows = len(accepted)
    seen = np.concatenate([[0], np.cumsum(accepted)])
    hits = np.concatenate([np.flatnonzero(accepted) + 1, np.full(max_accept, rows + max_propose)])
    start = np.arange(rows + 1)
    return np.minimum(hits[np.minimum(seen + max_accept - 1, len(hits) - 1)], start + max_propose), seen


def epoch_tables(pdf: pd.DataFrame, max_accept: int, max_propose: int) -> pd.DataFrame:
    """One segment as a table from entry state to exit state and epochs ended; a first segment starts in state 0 only."""
    accepted = pdf.sort_values("iter")["accepted"].to_numpy(dtype=np.int64)
    rows = len(accepted)
    end, seen = _boundaries(accepted, max_accept, max_propose)
    stop = ((seen[-1] - seen) * max_propose + (rows - np.arange(rows + 1))).tolist()
    ended = [0] * (rows + 1)
    ends = end.tolist()
    for s in range(rows, -1, -1):
        if ends[s] <= rows and s < rows:
            stop[s] = stop[ends[s]]
            ended[s] = ended[ends[s]] + 1
    stop_a, ended_a = np.array(stop), np.array(ended)
    states = np.arange(max_accept * max_propose if pdf["_seg"].iloc[0] else 1)
    a, p = np.divmod(states, max_propose)
    hits = np.concatenate([np.flatnonzero(accepted) + 1, np.full(max_accept, rows + max_propose)])
    first = np.minimum(hits[np.minimum(max_accept - a - 1, len(hits) - 1)], max_propose - p)
    inside = first <= rows
    at = np.where(inside, first, 0)
    exits = np.where(inside, stop_a[at], (a + seen[-1]) * max_propose + p + rows)
    count = np.where(inside, ended_a[at] + 1, 0)
    return pd.DataFrame(
        {
            "run_id": [pdf["run_id"].iloc[0]],
            "_seg": [pdf["_seg"].iloc[0]],
            "exits": [exits.astype(np.int32).tobytes()],
            "ended": [count.astype(np.int64).tobytes()],
        }
    )


def epoch_tables_composed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Tables of consecutive segments chained into one."""
    pdf = pdf.sort_values("_seg")
    state, count = None, None
    for exits, ended in zip(pdf["exits"], pdf["ended"]):
        exits, ended = np.frombuffer(exits, np.int32), np.frombuffer(ended, np.int64)
        if state is None:
            state, count = exits, ended
        else:
            state, count = exits[state], count + ended[state]
    return pd.DataFrame(
        {
            "run_id": [pdf["run_id"].iloc[0]],
            "_seg": [pdf["_group"].iloc[0]],
            "exits": [state.astype(np.int32).tobytes()],
            "ended": [count.astype(np.int64).tobytes()],
        }
    )


def epoch_scan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Follow one known entry state through consecutive segments."""
    pdf = pdf.sort_values("_seg")
    state, before = int(pdf["entry0"].iloc[0]), int(pdf["before0"].iloc[0])
    entry, counts = [], []
    for exits, ended in zip(pdf["exits"], pdf["ended"]):
        entry.append(state)
        counts.append(before)
        before += int(np.frombuffer(ended, np.int64)[state])
        state = int(np.frombuffer(exits, np.int32)[state])
    return pd.DataFrame(
        {"run_id": pdf["run_id"].to_numpy(), "_seg": pdf["_seg"].to_numpy(), "entry": entry, "before": counts}
    )


def epoch_numbers(pdf: pd.DataFrame, max_accept: int, max_propose: int) -> pd.DataFrame:
    """Epoch of each row of a segment, given the state it starts in."""
    pdf = pdf.sort_values("iter")
    accepted = pdf["accepted"].to_numpy(dtype=np.int64)
    rows = len(accepted)
    end, _ = _boundaries(accepted, max_accept, max_propose)
    a, p = divmod(int(pdf["entry"].iloc[0]), max_propose)
    hits = np.flatnonzero(accepted) + 1
    need = max_accept - a
    first = min(int(hits[need - 1]) if len(hits) >= need else rows + max_propose, max_propose - p)
    marks = np.zeros(rows + 1, dtype=np.int64)
    at = first
    while at <= rows - 1:
        marks[at] = 1
        at = int(end[at])
    epoch = int(pdf["before"].iloc[0]) + np.cumsum(marks[:rows])
    return pd.DataFrame(
        {"run_id": pdf["run_id"].to_numpy(), "iter": pdf["iter"].to_numpy(), "accepted": accepted, "epoch": epoch}
    )


# --- alignment columns ---------------------------------------------------------


def _text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets


def mask_batches(batches: Iterator[pa.RecordBatch], accepted: str, width: int) -> Iterator[pa.RecordBatch]:
    """Bit mask of characters per column, combined over the rows of a batch, in blocks of ``width`` columns.

    In: ``alignment_id, seq``; out: ``alignment_id, first`` (the site a block starts at), ``masks``. Characters that are not accepted have bits, too:
    one for each upper-case letter, one for all digits, one for everything else.
    """
    others = [c for c in ascii_uppercase if c not in accepted]
    bit = np.full(256, 1 << (len(accepted) + len(others) + 1), dtype=np.int32)
    bit[list(digits.encode())] = 1 << (len(accepted) + len(others))
    for i, c in enumerate(accepted.encode() + "".join(others).encode()):
        bit[c] = 1 << i
    for batch in batches:
        ids = batch.column("alignment_id").dictionary_encode()
        code = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        raw, offsets = _text(batch.column("seq"))
        length = np.diff(offsets)
        order = np.lexsort((code, length))
        out_code, out_first, flat, sizes = [], [], [], []
        # rows of one length form a matrix; its rows are grouped by alignment
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for rows in np.split(order, cuts) if len(order) else []:
            starts = np.concatenate([[0], np.flatnonzero(np.diff(code[rows])) + 1])
            for first in range(0, int(length[rows[0]]), width):
                here = min(width, int(length[rows[0]]) - first)
                masks = bit[raw[offsets[rows][:, None] + np.arange(first, first + here)]]
                flat.append(np.bitwise_or.reduceat(masks, starts, axis=0).ravel())
                out_code.append(code[rows[starts]])
                out_first.append(np.full(len(starts), first))
                sizes.append(np.full(len(starts), here))
        if not flat:
            continue
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                ids.dictionary.take(pa.array(np.concatenate(out_code))),
                pa.array(np.concatenate(out_first), pa.int32()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat), pa.int32())),
            ],
            names=["alignment_id", "first", "masks"],
        )


def merged_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of a block put together; rows come sorted by ``alignment_id, first``. A block is as long as its longest row."""
    now, held = None, None
    ids: list = []
    firsts: list[int] = []
    found: list[np.ndarray] = []

    def closed() -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum([len(m) for m in found])]).astype(np.int32)
        masks = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found), pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(firsts, pa.int32()), masks], names=["alignment_id", "first", "masks"])

    for batch in batches:
        masks = batch.column("masks")
        values, offsets = masks.values.to_numpy(zero_copy_only=False), masks.offsets.to_numpy()
        for i, here in enumerate(zip(batch.column("alignment_id").to_pylist(), batch.column("first").to_pylist())):
            own = values[offsets[i] : offsets[i + 1]]
            if here == now:
                if len(own) > len(held):
                    own, held = held, own.copy()
                held[: len(own)] |= own
                found[-1] = held
                continue
            if len(ids) >= 1024:
                yield closed()
                ids, firsts, found = [], [], []
            now, held = here, own.copy()
            ids.append(here[0])
            firsts.append(here[1])
            found.append(held)
    if ids:
        yield closed()


def piece_batches(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Sequences cut every ``_w`` bytes: ``keep``, ``first`` and ``piece``. An empty or NULL sequence is one such piece.

    The text isn't copied: pieces only have more offsets into it.
    """
    for batch in batches:
        raw, offsets = _text(batch.column("seq"))
        length = np.diff(offsets)
        width = batch.column("_w").to_numpy(zero_copy_only=False).astype(np.int64)
        many = np.maximum(1, -(-length // width))
        row = np.repeat(np.arange(len(length)), many)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        first = nth * width[row]
        lo = offsets[row] + first
        hi = np.minimum(lo + width[row], offsets[row + 1])
        ends = np.concatenate([lo[:1], hi]) if len(lo) else np.zeros(1, np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(raw)).cast(pa.string())
        at = pa.array(row)
        pieces = pc.if_else(batch.column("seq").is_null().take(at), pa.scalar(None, pa.string()), pieces)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), pa.array(first, pa.int32()), pieces], names=[*keep, "first", "piece"])


def cut_batches(batches: Iterator[pa.RecordBatch], passed: list[str]) -> Iterator[pa.RecordBatch]:
    """Pieces without the columns that ``keep`` (a flag per column of the block) leaves out; shorter rows use the flags they reach."""
    for batch in batches:
        piece, keep = batch.column("piece"), batch.column("keep")
        raw, offsets = _text(piece)
        starts = keep.offsets.to_numpy()[:-1].astype(np.int64)
        length = np.diff(offsets)
        at = np.arange(offsets[0], offsets[-1]) + np.repeat(starts - offsets[:-1], length)
        kept = keep.values.to_numpy(zero_copy_only=False)[at].astype(bool)
        ends = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])[offsets - offsets[0]]
        data = raw[offsets[0] : offsets[-1]][kept]
        if len(data) and data.max() > 127:
            texts = [data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(ends[:-1], ends[1:])]
            cut = pa.array(texts, pa.string())
        else:
            buffers = pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())
            cut = pa.LargeStringArray.from_buffers(len(piece), *buffers).cast(pa.string())
        cut = pc.if_else(piece.is_null(), pa.scalar(None, pa.string()), cut)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), cut], names=[*passed, "piece"])


def cut_whole_batches(batches: Iterator[pa.RecordBatch], accepted: str, together: int) -> Iterator[pa.RecordBatch]:
    """Whole alignments without their constant columns; rows come sorted by ``alignment_id, taxon_id, name``.

    In: these and ``seq``; out: these, ``seq``, ``original_m`` and ``m``. Alignments of about ``together`` bytes are worked on at once. Rows of one
    name are joined in the order of their cut text, and alignments without any column go, as ``cut_constant_sites`` has it.
    """
    others = [c for c in ascii_uppercase if c not in accepted]
    kind = np.full(256, len(accepted) + len(others) + 1, dtype=np.uint8)
    kind[list(digits.encode())] = len(accepted) + len(others)
    for i, c in enumerate(accepted.encode() + "".join(others).encode()):
        kind[c] = i

    def cut(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        raw, offsets = _text(rows.column("seq"))
        length = np.diff(offsets)
        code = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(length))))
        wide = np.maximum.reduceat(length, starts)
        base = np.cumsum(wide) - wide
        least, most = np.full(int(wide.sum()), 255, np.uint8), np.zeros(int(wide.sum()), np.uint8)
        order = np.argsort(length, kind="stable")
        # rows of one length form a matrix; its rows are grouped by alignment
        for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            size = int(length[own[0]])
            if not size:
                continue
            first = np.concatenate([[0], np.flatnonzero(np.diff(code[own])) + 1])
            found = kind[raw[offsets[own][:, None] + np.arange(size)]]
            at = base[code[own[first]]][:, None] + np.arange(size)
            least[at] = np.minimum(least[at], np.minimum.reduceat(found, first, axis=0))
            most[at] = np.maximum(most[at], np.maximum.reduceat(found, first, axis=0))
        keep = least != most
        m = np.add.reduceat(np.append(keep, False).astype(np.int64), base) if len(base) else base
        m = np.where(wide > 0, m, 0)
        flags = keep[np.arange(offsets[0], offsets[-1]) + np.repeat(base[code] - offsets[:-1], length)]
        ends = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets - offsets[0]]
        data = raw[offsets[0] : offsets[-1]][flags]
        null = rows.column("seq").is_null().to_numpy(zero_copy_only=False)
        names = [rows.column(c) for c in ("taxon_id", "name")]
        new = np.append(True, np.diff(code) != 0)
        for c in names:
            c = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= np.diff(c) != 0
        if new.all() and not (len(data) and data.max() > 127):
            buffers = pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())
            text = pa.LargeStringArray.from_buffers(len(length), *buffers).cast(pa.string())
            text = pc.if_else(pa.array(null), pa.scalar(None, pa.string()), text)
        else:
            parts = [data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(ends[:-1], ends[1:])]
            groups = np.split(np.arange(len(length)), np.flatnonzero(new)[1:])
            text = pa.array([None if null[g].any() else "".join(sorted(parts[i] for i in g)) for g in groups], pa.string())
        at = np.flatnonzero(new)
        at, text = at[wide[code[at]] > 0], text.filter(pa.array(wide[code[at]] > 0))
        columns = [rows.column(c).take(pa.array(at)) for c in ("alignment_id", "taxon_id", "name")]
        columns += [text, pa.array(wide[code[at]], pa.int32()), pa.array(m[code[at]], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["alignment_id", "taxon_id", "name", "seq", "original_m", "m"])

    def starts_of(rows: pa.RecordBatch) -> np.ndarray:
        code = rows.column("alignment_id").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        return np.flatnonzero(np.append(True, np.diff(code) != 0))

    def joined(parts: list) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    held, size = [], 0
    for batch in batches:
        for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
            held.append(part)
            size += int(pc.sum(pc.binary_length(part.column("seq"))).as_py() or 0) + part.num_rows
            if size < together:
                continue
            # the last alignment may go on
            rows = joined(held)
            starts = starts_of(rows)
            if len(starts) > 1:
                yield cut(rows.slice(0, int(starts[-1])), starts[:-1])
            rest = rows.slice(int(starts[-1]))
            held, size = [rest], int(pc.sum(pc.binary_length(rest.column("seq"))).as_py() or 0) + rest.num_rows
    if held:
        rows = joined(held)
        yield cut(rows, starts_of(rows))


def pattern_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turn blocks of an alignment (taxa after each other) into distinct columns with counts.

    In: ``alignment_id, n, block`` (n pieces of equal length, joined); out:
    ``alignment_id, patterns, weights``.
    """
    for batch in batches:
        patterns, weights, ends = [], [], [0]
        taxa = batch.column("n").to_pylist()
        raw, offsets = _text(batch.column("block"))
        for i, n in enumerate(taxa):
            cells = raw[offsets[i] : offsets[i + 1]].reshape(n, -1)
            if not _NIBBLE[cells].all():
                raise ValueError(f"alignment {batch.column('alignment_id')[i]}: a character without a nucleotide set")
            columns = np.ascontiguousarray(cells.T).view(f"S{n}").ravel()
            distinct, counts = np.unique(columns, return_counts=True)
            patterns.append(distinct.astype(f"U{n}"))
            weights.append(counts)
            ends.append(ends[-1] + len(distinct))
        offsets_out = pa.array(ends, pa.int32())
        texts = pa.array([p for block in patterns for p in block.tolist()], pa.string())
        counts_out = pa.array(np.concatenate(weights) if weights else [], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("alignment_id"),
                pa.ListArray.from_arrays(offsets_out, texts),
                pa.ListArray.from_arrays(offsets_out, counts_out),
            ],
            names=["alignment_id", "patterns", "weights"],
        )


# --- lines of files -----------------------------------------------------------


def line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the lines of each block of a file, in the order they come.

    In: ``path, block, value, full, keep, ...``; out: ``i`` (number among all lines of the block), ``k`` (full lines before it) and the
    other columns of the lines to keep. After each block comes a row with NULL ``value`` and the block's totals.
    """
    now, lines, full = None, 0, 0
    extra: list[str] = []

    def end() -> pa.RecordBatch:
        columns = [[now[0]], [now[1]], [lines], [full], [None], [False], *[[False]] * len(extra)]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.bool_()] * (1 + len(extra))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["path", "block", "i", "k", "value", "full", *extra])

    for batch in batches:
        if not batch.num_rows:
            continue
        extra = [c for c in batch.schema.names if c not in ("path", "block", "value", "full", "keep")]
        paths = batch.column("path").dictionary_encode()
        code = paths.indices.to_numpy(zero_copy_only=False)
        block = batch.column("block").to_numpy(zero_copy_only=False)
        change = np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            here = (paths.dictionary[int(code[lo])].as_py(), int(block[lo]))
            if here != now:
                if now is not None:
                    yield end()
                now, lines, full = here, 0, 0
            part = batch.slice(lo, hi - lo)
            is_full = part.column("full").to_numpy(zero_copy_only=False).astype(bool)
            kept = np.flatnonzero(part.column("keep").to_numpy(zero_copy_only=False).astype(bool))
            before = full + np.concatenate([[0], np.cumsum(is_full)])
            at = pa.array(kept)
            columns = [part.column(c).take(at) for c in ("path", "block")]
            columns += [pa.array(lines + kept, pa.int64()), pa.array(before[kept], pa.int64())]
            columns += [part.column(c).take(at) for c in ("value", "full", *extra)]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "block", "i", "k", "value", "full", *extra])
            lines, full = lines + hi - lo, int(before[-1])
    if now is not None:
        yield end()
