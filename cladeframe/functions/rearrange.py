"""Tree rearrangements and split keys as array arithmetic inside tasks.

Trees of one size are worked on together, a row of the matrix ``parent`` (T x B)
for each. A task gets a tree and a range of the branches that are moved, so one
large tree is the work of many tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELLS = 1 << 22  # cells of (tree, moved branch, other branch) looked at together
OUT_CELLS = 1 << 20  # numbers of one batch of neighbours

Rows = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Trees:
    """Parents, children, sisters and subtrees of T trees with B branches, rooted at a taxon."""

    def __init__(self, parent: np.ndarray):
        self.parent = parent
        t, b = parent.shape
        self.n = (b + 3) // 2
        self.all = np.arange(t)
        self.root = np.argmin(parent, axis=1)
        # sorting by parent puts sisters side by side, the lower number first; the root comes before all
        pairs = np.argsort(parent, axis=1, kind="stable")[:, 1:].reshape(t, -1, 2)
        rows = self.all[:, None]
        nodes = parent[rows, pairs[:, :, 0]]
        self.sister = np.full((t, b), -1)
        self.sister[rows, pairs[:, :, 0]] = pairs[:, :, 1]
        self.sister[rows, pairs[:, :, 1]] = pairs[:, :, 0]
        self.kids = np.full((t, b, 2), -1)
        self.kids[rows, nodes] = pairs
        self.depth = np.zeros((t, b), np.int64)
        at = np.broadcast_to(np.arange(b), (t, b))
        while (above := parent[rows, at]).max(initial=-1) >= 0:
            self.depth += above >= 0
            at = np.where(above >= 0, above, at)
        # a subtree is the branches ``first`` to ``first + size - 1`` in the order of a walk from the root
        self.merges = np.argsort(-self.depth[rows, nodes], axis=1, kind="stable")
        self.nodes, self.pairs = nodes, pairs
        self.size = np.ones((t, b), np.int64)
        for node, a, c in self.upward():
            self.size[self.all, node] += self.size[self.all, a] + self.size[self.all, c]
        self.first = np.zeros((t, b), np.int64)
        for node, a, c in reversed(list(self.upward())):
            self.first[self.all, a] = self.first[self.all, node] + 1
            self.first[self.all, c] = self.first[self.all, a] + self.size[self.all, a]

    def upward(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A branch and its two children of every tree at a time, children before parents."""
        for k in range(self.merges.shape[1]):
            s = self.merges[:, k]
            yield self.nodes[self.all, s], self.pairs[self.all, s, 0], self.pairs[self.all, s, 1]

    def below(self, branch: np.ndarray) -> np.ndarray:
        """T x len(branch) x B: whether a branch is the given one or below it."""
        lo = self.first[:, branch, None]
        return (self.first[:, None, :] >= lo) & (self.first[:, None, :] < lo + self.size[:, branch, None])


def turn(trees: Trees, out: np.ndarray, t: np.ndarray, start: np.ndarray, end: np.ndarray, top: np.ndarray) -> None:
    """Re-root the subtree ``end`` on the branch ``start`` in it, in every row of ``out`` at a time.

    The branch above ``start`` becomes the top one, below ``top``; those between turn over, and the old sisters on the way
    move on two steps. Nothing happens where ``end`` is right above ``start``. A negative ``start`` stays as well.
    """
    parent, rows = trees.parent, np.flatnonzero(start >= 0)
    a = start[rows]
    b = parent[t[rows], a]
    going = b != end[rows]
    rows, a, b = rows[going], a[going], b[going]
    out[rows, b] = top[rows]
    while len(rows):
        c = parent[t[rows], b]
        out[rows, trees.sister[t[rows], a]] = c
        out[rows, c] = b
        going = c != end[rows]
        rows, a, b = rows[going], b[going], c[going]


# --- single moves: (trees, tree of each row, three numbers of each row) to parents ---


def interchanged(trees: Trees, t: np.ndarray, branch: np.ndarray, side: np.ndarray, _) -> np.ndarray:
    """The left (side 0) or right (side 1) child of an inner branch changes places with its sister."""
    out, row = trees.parent[t], np.arange(len(t))
    out[row, trees.kids[t, branch, side]] = trees.parent[t, branch]
    out[row, trees.sister[t, branch]] = branch
    return out


def regrafted(trees: Trees, t: np.ndarray, src: np.ndarray, dest: np.ndarray, _) -> np.ndarray:
    """Close the gap, then split the destination branch."""
    out, row = trees.parent[t], np.arange(len(t))
    up = trees.parent[t, src]
    out[row, trees.sister[t, src]] = trees.parent[t, up]
    out[row, up] = trees.parent[t, dest]
    out[row, dest] = up
    return out


def turned(trees: Trees, t: np.ndarray, src: np.ndarray, dest: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """A subtree moves, re-rooted at ``leaf``."""
    out = regrafted(trees, t, src, dest, leaf)
    turn(trees, out, t, leaf, src, trees.parent[t, src])
    return out


def onto_root(trees: Trees, t: np.ndarray, src: np.ndarray, dest: np.ndarray, _) -> np.ndarray:
    """A subtree moves onto the branch of the root taxon itself."""
    parent, r = trees.parent, trees.root[t]
    out, row = parent[t], np.arange(len(t))
    up = parent[t, src]
    above = parent[t, up]
    out[row[:, None], trees.kids[t, r]] = up[:, None]
    out[row, trees.sister[t, src]] = np.where(above == r, up, above)
    out[row, up] = r
    out[row, src] = r
    return out


def outside(trees: Trees, t: np.ndarray, src: np.ndarray, dest: np.ndarray, _) -> np.ndarray:
    """Everything outside the subtree ``src`` moves onto ``dest`` in it, which turns the subtree over in place."""
    out = trees.parent[t]
    turn(trees, out, t, dest, src, trees.parent[t, src])
    return out


def near_root(trees: Trees, t: np.ndarray, branch: np.ndarray) -> np.ndarray:
    """The child of the root above a branch."""
    at = branch
    while (lower := trees.depth[t, at] > 1).any():
        at = np.where(lower, trees.parent[t, at], at)
    return at


def root_taxon(trees: Trees, t: np.ndarray, src: np.ndarray, dest: np.ndarray, _) -> np.ndarray:
    """The root taxon alone moves onto ``dest``."""
    parent, r, near = trees.parent, trees.root[t], near_root(trees, t, dest)
    out, row = parent[t], np.arange(len(t))
    b = parent[t, dest]
    out[row, b] = r
    out[row, trees.sister[t, near]] = near
    out[row, dest] = r
    c = parent[t, b]
    while len(row):
        going = c != r[row]
        row, b, c = row[going], b[going], c[going]
        out[row, c] = b
        b, c = c, parent[t[row], c]
    return out


def far_child(trees: Trees, t: np.ndarray, src: np.ndarray, dest: np.ndarray, _) -> np.ndarray:
    """The child of the root that ``dest`` is not below moves onto it."""
    r, near = trees.root[t], near_root(trees, t, dest)
    out, row = trees.parent[t], np.arange(len(t))
    above = trees.parent[t, dest]
    out[row[:, None], trees.kids[t, near]] = r[:, None]
    out[row, near] = np.where(above == near, r, above)
    out[row, src] = near
    out[row, dest] = near
    return out


MOVES = (interchanged, regrafted, turned, onto_root, outside, root_taxon, far_child)

# --- all moves of a kind: number of the move function, tree and three numbers of each row ---


def interchanges(trees: Trees, lo: int, hi: int) -> Iterator[Rows]:
    """``interchanged`` for each inner branch and side."""
    branch = np.arange(max(lo, trees.n), max(hi, trees.n))
    t, k, side = (x.ravel() for x in np.indices((len(trees.parent), len(branch), 2)))
    yield 0, t, branch[k], side, side


def movable(trees: Trees, lo: int, hi: int) -> np.ndarray:
    """T x (hi - lo): subtrees that may be moved; the root and its children stay where they are."""
    up = trees.parent[:, lo:hi]
    return (up >= 0) & (up != trees.root[:, None])


def graft_points(trees: Trees, lo: int, hi: int) -> np.ndarray:
    """T x (hi - lo) x B: branches a moved subtree can go to and give another tree."""
    src, every = np.arange(lo, hi), np.arange(trees.parent.shape[1])
    return (
        movable(trees, lo, hi)[:, :, None]
        & (trees.parent >= 0)[:, None, :]
        & (every != trees.parent[:, src, None])
        & (every != trees.sister[:, src, None])
        & ~trees.below(src)
    )


def regrafts(trees: Trees, lo: int, hi: int) -> Iterator[Rows]:
    """Every subtree ``src`` on every branch ``dest`` outside of it."""
    t, src, dest = np.nonzero(graft_points(trees, lo, hi))
    yield 1, t, src + lo, dest, dest


def all_regrafts(trees: Trees, lo: int, hi: int) -> Iterator[Rows]:
    """``regrafts`` and the moves that need another root: onto the root's own branch, of the root's children, of the part with the root."""
    yield from regrafts(trees, lo, hi)
    t, src = np.nonzero(movable(trees, lo, hi))
    yield 3, t, src + lo, trees.root[t], src

    # everything else goes around a branch ``dest`` that is no child of the root
    t, dest = np.nonzero(trees.depth[:, lo:hi] >= 2)
    dest = dest + lo
    # the part outside a subtree around ``dest``: all branches two or more above it but the root
    rows, at = np.arange(len(dest)), trees.parent[t, dest]
    while len(rows):
        at = trees.parent[t[rows], at]
        inner = trees.depth[t[rows], at] > 0
        rows, at = rows[inner], at[inner]
        yield 4, t[rows], at, dest[rows], dest[rows]
    yield 5, t, trees.root[t], dest, dest
    yield 6, t, trees.sister[t, near_root(trees, t, dest)], dest, dest


def turned_regrafts(trees: Trees, lo: int, hi: int) -> Iterator[Rows]:
    """``regrafts`` with the subtree re-rooted at each of its taxa that is no child of ``src`` (``leaf``).

    Subtrees of one or two taxa move as they are (``leaf`` -1).
    """
    src = np.arange(lo, hi)
    taxa = trees.below(src)[:, :, : trees.n] & (np.arange(trees.n) != src[:, None])
    large = taxa.sum(axis=2) > 2
    leaves = taxa & large[:, :, None] & (trees.parent[:, None, : trees.n] != src[:, None])
    leaves = np.concatenate([leaves, ~large[:, :, None]], axis=2) & movable(trees, lo, hi)[:, :, None]
    v_t, v_at, leaf = np.nonzero(leaves)
    leaf = np.where(leaf == trees.n, -1, leaf)
    points = graft_points(trees, lo, hi)
    counts = points.sum(axis=2)
    # the turned subtrees one after another, each with all its destinations
    p_dest = np.nonzero(points)[2]
    starts = np.concatenate([[0], np.cumsum(counts.ravel())])[:-1].reshape(counts.shape)
    many = counts[v_t, v_at]
    which = np.repeat(np.arange(len(v_t)), many)
    place = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    yield 2, v_t[which], v_at[which] + lo, p_dest[starts[v_t, v_at][which] + place], leaf[which]


def all_turned(trees: Trees, lo: int, hi: int) -> Iterator[Rows]:
    """Moves with and without turning the subtree."""
    yield from all_regrafts(trees, lo, hi)
    yield from turned_regrafts(trees, lo, hi)


KINDS = {"nni": interchanges, "spr": regrafts, "spr_full": all_regrafts, "tbr": turned_regrafts, "tbr_full": all_turned}


def matrices(parents: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column by length: their numbers and the matrix of their values."""
    offsets = parents.offsets.to_numpy()
    values = parents.values.to_numpy(zero_copy_only=False)
    length = np.diff(offsets)
    for b in np.unique(length):
        rows = np.flatnonzero(length == b)
        yield rows, values[offsets[rows][:, None] + np.arange(b)]


def move_batches(kind: str, keep: list[str], columns: list[str], result: str):
    """Task function: rows ``keep, parent, lo, hi`` to moves of the branches ``lo`` to ``hi - 1``.

    Out: ``keep``, the ``columns`` that name a move, and as ``result`` says ``parent`` (the new tree), ``key`` (its split key, after ``code``, the
    number of the move function) or nothing.
    """
    moves = KINDS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            los, his = (batch.column(c).to_numpy() for c in ("lo", "hi"))
            kept = [batch.column(c) for c in keep]
            for rows, parent in matrices(batch.column("parent")):
                b = parent.shape[1]
                if b < 5:
                    continue
                for lo, hi in np.unique(np.stack([los[rows], his[rows]], axis=1), axis=0).tolist():
                    same = np.flatnonzero((los[rows] == lo) & (his[rows] == hi))
                    step = max(1, CELLS // (b * (hi - lo)))
                    for at in range(0, len(same), step):
                        part = same[at : at + step]
                        trees = Trees(parent[part])
                        for code, t, *numbers in moves(trees, lo, hi):
                            size = max(1, OUT_CELLS // (b if result else 8))
                            for s in range(0, len(t), size):
                                cut = slice(s, s + size)
                                origin = pa.array(rows[part[t[cut]]])
                                out = [c.take(origin) for c in kept] + [pa.array(x[cut], pa.int32()) for x in numbers[: len(columns)]]
                                names = [*keep, *columns]
                                if result:
                                    flat = MOVES[code](trees, t[cut], *(x[cut] for x in numbers))
                                    if result == "key":
                                        out.append(pa.array(np.full(len(flat), code), pa.int32()))
                                        out.append(pa.array(keys_of(flat), pa.string()))
                                        names += ["code", "key"]
                                    else:
                                        out.append(listed(flat))
                                        names.append("parent")
                                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def place_of(weights: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of numbers (T x k) the column of ``weights`` (T x m) that it falls in when columns follow each other, and its place there."""
    upto = np.cumsum(weights, axis=1)
    column = np.minimum((upto[:, None, :] <= number[:, :, None]).sum(axis=2), max(0, weights.shape[1] - 1))
    row = np.arange(len(weights))[:, None]
    return column, number - (upto - weights)[row, column]


def nth(flags: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Index of the ``number``-th set flag of each row."""
    return np.argmax(np.cumsum(flags, axis=1) > number[:, None], axis=1)


def drawn(trees: Trees, kind: int, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The moves (T x k x 4: code and three numbers) that the draws ``u`` (T x k) stand for, and whether there are any.

    Moves are counted, not listed: a move's number gives its subtree by sums over the subtrees' sizes, then its destination and turn.
    Kinds are 0 (interchange), 1 (regraft) and 2 (regraft with a turn), in the order of ``interchanges``, ``regrafts`` and ``turned_regrafts``.
    """
    t, b = trees.parent.shape
    out = np.zeros((t, u.shape[1], 4), np.int64)
    out[:, :, 0], out[:, :, 3] = kind, -1
    if kind == 0:
        total = np.full(t, max(0, 2 * (trees.n - 3)))
        number = (u * total[:, None]).astype(np.int64)
        out[:, :, 1], out[:, :, 2] = trees.n + number // 2, number % 2
        return out, total[:, None] > np.zeros_like(u)
    # all but the root, the subtree, the branch above it and its sister
    dests = np.where(movable(trees, 0, b), b - 3 - trees.size, 0)
    taxa = (trees.size + 1) // 2
    children = ((trees.kids >= 0) & (trees.kids < trees.n)).sum(axis=2)
    turns = np.where((taxa > 2) & (trees.kids[:, :, 0] >= 0), taxa - children, 1) if kind == 2 else np.ones_like(dests)
    total = (dests * turns).sum(axis=1)
    number = (u * total[:, None]).astype(np.int64)
    src, rest = place_of(dests * turns, number)
    row, draws = (x.ravel() for x in np.indices(u.shape))
    src, rest = src.ravel(), rest.ravel()
    many = np.maximum(dests[row, src], 1)
    every = np.arange(b)
    inside = (trees.first[row] >= trees.first[row, src][:, None]) & (trees.first[row] < (trees.first + trees.size)[row, src][:, None])
    legal = (trees.parent[row] >= 0) & ~inside & (every != trees.parent[row, src][:, None]) & (every != trees.sister[row, src][:, None])
    out[row, draws, 1] = src
    out[row, draws, 2] = nth(legal, rest % many)
    if kind == 2:
        far = inside[:, : trees.n] & (trees.parent[row][:, : trees.n] != src[:, None])
        large = (taxa[row, src] > 2) & (src >= trees.n)
        out[row, draws, 3] = np.where(large, nth(far, rest // many), -1)
    return out, (total > 0)[:, None] & np.ones(u.shape, bool)


def draw_batches(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows ``keep, parent, kinds, draws`` (a kind and a draw for each slot) to ``slot, code, a, b, c`` and the tree after the move.

    A slot for which a tree has no move has NULL numbers and the tree as it was.
    """
    for batch in batches:
        slots = len(batch.column("kinds")[0]) if batch.num_rows else 0
        kinds, draws = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, slots) for c in ("kinds", "draws"))
        for rows, parent in matrices(batch.column("parent")):
            step = max(1, CELLS // (parent.shape[1] * max(1, slots) * 8))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                trees = Trees(parent[at : at + step])
                moves, there = np.zeros((len(part), slots, 4), np.int64), np.zeros((len(part), slots), bool)
                for kind in range(3) if parent.shape[1] >= 5 else ():
                    found, some = drawn(trees, kind, draws[part])
                    own = kinds[part] == kind
                    moves[own], there[own] = found[own], some[own]
                t = np.repeat(np.arange(len(part)), slots)
                flat, ok = moves.reshape(-1, 4), there.ravel()
                new = trees.parent[t]
                for code in np.unique(flat[ok, 0]):
                    r = np.flatnonzero(ok & (flat[:, 0] == code))
                    new[r] = MOVES[code](trees, t[r], *flat[r, 1:].T)
                origin = pa.array(part[t])
                numbers = [pa.array(np.tile(np.arange(slots), len(part)), pa.int32()), pa.array(kinds[part].ravel(), pa.int32())]
                numbers += [pa.array(flat[:, j], pa.int32(), mask=~ok) for j in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(origin) for c in keep), *numbers, listed(new)], names=[*keep, "slot", "kind", "a", "b", "c", "parent"]
                )


def listed(flat: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    ends = pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(flat.ravel(), pa.int32()))


def moved_trees(parent: np.ndarray, t: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Parents after the moves (rows of ``code`` and its three numbers) of the trees ``t``."""
    trees, out = Trees(parent), np.empty((len(t), parent.shape[1]), parent.dtype)
    for code in np.unique(moves[:, 0]):
        rows = np.flatnonzero(moves[:, 0] == code)
        out[rows] = MOVES[code](trees, t[rows], *moves[rows, 1:].T)
    return out


def applied_batches(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows with ``parent`` and a move (``code, a, b, c``): the ``names`` columns and the tree after the move."""
    for batch in batches:
        moves = np.stack([batch.column(c).to_numpy() for c in ("code", "a", "b", "c")], axis=1)
        for rows, parent in matrices(batch.column("parent")):
            at = pa.array(rows)
            new = listed(moved_trees(parent, np.arange(len(rows)), moves[rows]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), new], names=[*names, "parent"])


def grouped_parents(packs: pa.Array, i: int) -> np.ndarray:
    """Trees of a pack of groups ``parent, moves``: each group's moves of its tree, one after another."""
    groups = packs[i].values
    trees, moves = groups.field("parent"), groups.field("moves")
    offsets, own = trees.offsets.to_numpy(), moves.offsets.to_numpy()
    b = int(offsets[1] - offsets[0])
    parent = trees.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].reshape(-1, b)
    inner = moves.values.slice(int(own[0]), int(own[-1] - own[0]))
    numbers = np.stack([inner.field(c).to_numpy(zero_copy_only=False) for c in ("code", "a", "b", "c")], axis=1)
    return moved_trees(parent, np.repeat(np.arange(len(groups)), np.diff(own)), numbers)


# --- keys --------------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of a number, one to one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def keys_of(parent: np.ndarray) -> list[str]:
    """Split keys of the rows of a matrix, see ``split_keys``."""
    trees, halves = Trees(parent), []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        value = np.zeros(parent.shape, np.uint64)
        value[:, : trees.n] = mixed(np.arange(1, trees.n + 1, dtype=np.uint64) * np.uint64(seed))
        total = np.full(len(parent), parent.shape[1], np.uint64)
        for node, a, c in trees.upward():
            both = value[trees.all, a] ^ value[trees.all, c]
            # the root's own merge is no split
            total += np.where(parent[trees.all, node] >= 0, mixed(both ^ np.uint64(seed)), np.uint64(0))
            value[trees.all, node] = both
        halves.append(total.tolist())
    return [f"{x:016x}{y:016x}" for x, y in zip(*halves)]


def split_keys(parents: pa.Array) -> pa.Array:
    """128 bits that two trees on the same taxa share exactly when they have the same splits, as 32 hex digits.

    Every taxon has a random number; a split is the exclusive or of the taxa on its side without the root taxon, and a tree the
    sum of its mixed splits, in whichever order. Twice 64 bits, so that unequal trees meet by chance only once in 2^128 pairs.
    """
    out = np.empty(len(parents), dtype="U32")
    for rows, parent in matrices(parents):
        out[rows] = keys_of(parent)
    return pa.array(out.tolist(), pa.string())
