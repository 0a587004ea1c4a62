"""Column expressions over one tree, held as an array of parent branches.

A tree of n taxa has 2n-3 branches: 0..n-1 are the taxa, the rest are inner
branches. One taxon is the root (parent -1, normally taxon 0); it has two
children like every inner branch. The lower-numbered child is the left one.
All expressions work inside one row, so none of them shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def taxa(parent: Column) -> Column:
    """Number of taxa."""
    return ((F.size(parent) + 3) / 2).cast("int")


def at(array: Column, index: Column | int) -> Column:
    """0-based array element."""
    return F.get(array, index if isinstance(index, Column) else F.lit(index))


def root_of(parent: Column) -> Column:
    return (F.array_position(parent, F.lit(-1)) - 1).cast("int")


def child_list(parent: Column) -> Column:
    """Branches sorted by parent: the root, its two children, then two per inner branch.

    Only valid when the root is a taxon; see ``child_offset`` for the lookup.
    """
    pairs = F.transform(parent, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda s: s["i"])


def child_offset(branch: Column, n: Column) -> Column:
    """Where the two children of a branch start in ``child_list``."""
    return F.when(branch < n, F.lit(1)).otherwise((branch - n) * 2 + 3)


def children(parent: Column, branch: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(parent) - 1), lambda b: at(parent, b) == branch)


def sister(parent: Column, branch: Column) -> Column:
    """The other child of my parent; NULL for the root."""
    mine = at(parent, branch)
    others = F.filter(
        F.sequence(F.lit(0), F.size(parent) - 1),
        lambda b: (at(parent, b) == mine) & (b != branch) & (mine >= 0),
    )
    return at(others, 0)


def root_path(parent: Column, branch: Column) -> Column:
    """Branch, its parent, and so on up to the root."""
    def up(path: Column) -> Column:
        return at(parent, F.element_at(path, -1))

    return F.aggregate(
        F.sequence(F.lit(1), F.size(parent)),
        F.array(branch.cast("int")),
        lambda path, _: F.when(up(path) < 0, path).otherwise(F.concat(path, F.array(up(path)))),
    )


def upward_order(parent: Column, kids: Column) -> Column:
    """Inner branches with children before parents, the root last.

    A breadth-first queue from the root, reversed. ``kids`` is ``child_list``.
    """
    n = taxa(parent)
    return F.reverse(
        F.aggregate(
            F.sequence(F.lit(0), n - 3),
            F.array(root_of(parent)),
            lambda queue, k: F.concat(
                queue, F.filter(F.slice(kids, child_offset(at(queue, k), n) + 1, 2), lambda c: c >= n)
            ),
        )
    )


def merges(kids: Column, order: Column) -> Column:
    """Merges in upward order as ``struct(node, l, r)``; ``l`` and ``r`` are slots.

    A taxon has its own number as slot, the k-th merge has slot n + k. The last
    merge is that of the root.
    """
    n = taxa(kids)

    def slot(branch: Column) -> Column:
        return (
            F.when(branch < n, branch).otherwise(n + F.array_position(order, branch) - 1).cast("int")
        )

    return F.transform(
        order,
        lambda u: F.struct(
            u.alias("node"),
            slot(at(kids, child_offset(u, n))).alias("l"),
            slot(at(kids, child_offset(u, n) + 1)).alias("r"),
        ),
    )


def upward_fold(plan: Column, leaves: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Values of all slots: the given leaf values, then one per merge but the root's."""
    return F.aggregate(
        F.slice(plan, F.lit(1), F.size(plan) - 1),
        leaves,
        lambda acc, m: F.concat(acc, F.array(combine(at(acc, m["l"]), at(acc, m["r"])))),
    )


def slot_members(plan: Column) -> Column:
    """Sorted taxa below every slot."""
    leaves = F.transform(F.sequence(F.lit(0), F.size(plan) + 1), lambda i: F.array(i))
    return upward_fold(plan, leaves, lambda a, b: F.array_sort(F.concat(a, b)))


def clades(plan: Column, members: Column) -> Column:
    """Every inner branch as ``struct(branch, size, members)``; the root's own clade is left out."""
    n = F.size(plan) + 2
    return F.transform(
        F.slice(plan, F.lit(1), F.size(plan) - 1),
        lambda m, k: F.struct(
            m["node"].alias("branch"),
            F.size(at(members, n + k)).alias("size"),
            at(members, n + k).alias("members"),
        ),
    )


def sorted_clades(clade_array: Column) -> Column:
    """Clades as ``struct(size, members)`` in canonical order: by size, then content."""
    return F.array_sort(
        F.transform(clade_array, lambda c: F.struct(c["size"].alias("size"), c["members"].alias("members")))
    )


def canonical_text(sorted_array: Column) -> Column:
    """Canonical text of sorted clades.

    Fixed format: one line per clade, ``index    count    member   member   ...``.
    """
    return F.array_join(
        F.transform(
            sorted_array,
            lambda c, i: F.concat(
                i.cast("string"),
                F.lit("    "),
                c["size"].cast("string"),
                F.lit("    "),
                F.array_join(c["members"].cast("array<string>"), "   "),
                F.lit("   \n"),
            ),
        ),
        "",
    )


def bracketed(plan: Column, text: Column) -> Column:
    """Whole tree from the texts of its slots, the root taxon first."""
    top = F.element_at(plan, -1)
    return F.concat(
        F.lit("("), at(text, top["node"]), F.lit(","), at(text, top["l"]),
        F.lit(","), at(text, top["r"]), F.lit(");"),
    )


def edit(branch: Column, new_parent: Column) -> Column:
    return F.struct(branch.cast("int").alias("b"), new_parent.cast("int").alias("p"))


def rewire(parent: Column, edits: Column) -> Column:
    """Parent array after ``edits``, an array of ``struct(b, p)``: branch b gets parent p."""
    return F.transform(
        parent,
        lambda p, i: F.coalesce(at(F.filter(edits, lambda e: e["b"] == i), 0)["p"], p),
    )


def reroot_edits(parent: Column, path: Column) -> Column:
    """Edits that make the first taxon of ``path`` the root; ``path`` ends at the old root.

    Along the path every branch becomes the child of the one before it, and so
    does the old sister of the one before it.
    """
    below = F.slice(path, F.lit(1), F.size(path) - 1)
    return F.concat(
        F.array(edit(at(path, 0), F.lit(-1))),
        F.transform(below, lambda b, k: edit(at(path, k + 1), b)),
        F.transform(below, lambda b: edit(sister(parent, b), b)),
    )
