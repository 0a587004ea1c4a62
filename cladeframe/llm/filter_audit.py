"""What each of several filters does, alone and in every order: a table of coalitions and its Shapley values.

A filter order is a chain of coalitions (the filters applied so far). So the documents are only counted by the *set* of filters
they fail: 2^m sets for m filters, however many documents there are. From those counts come

* ``v(S)``, the documents that the coalition S removes, for all coalitions;
* every step of every order: step j removes ``v(S_j) - v(S_{j-1})``;
* the Shapley values, as the solution of a least-squares problem. Over all coalitions other than the empty and the full one,
  ``sum_S k(|S|) (v(S) - sum_{i in S} phi_i)^2`` is least, where ``k(s) = (m-1) / (C(m,s) s (m-s))`` and the ``phi_i`` must add up to v of
  all filters (efficiency). The normal equations with that constraint are solved in rationals. Their matrix is the same for
  every part, and the solution is linear in v, so it is solved once for each unit vector of v and then applied to all
  parts by integer arithmetic: ``m! phi_i`` is a whole number.

A document is counted under its set in the part it belongs to. Rows that leave the tasks are sets of a part, never documents.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import WORD

#: The five filters of ``document_failures``, as bits 0 to 4 of a failure set.
NAMES = "ABCDE"
#: Every order of the filters is reported, so their number is bounded.
MOST_FILTERS = 6


def failing(text: Column) -> Column:
    """Bits 0 to 3: what a text fails by itself (NULL counts as empty).

    A: under 100 words; B: under 80% of them distinct; C: over 10% of its code points are ``[A-Z]``; D: it holds one of ``#$%&*|``.
    """
    text = F.coalesce(text, F.lit(""))
    # one pass finds the words; both counts use the array
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))

    def bit(cond: Column, at: int) -> Column:
        return F.when(cond, 1 << at).otherwise(0)

    # transform binds the array once
    by_words = F.transform(
        F.array(words),
        lambda w: bit(F.size(w) < 100, 0) + bit(100 * F.size(F.array_distinct(w)) < 80 * F.size(w), 1),
    )
    return F.get(by_words, F.lit(0)) + bit(100 * capitals > 10 * F.length(text), 2) + bit(text.rlike("[#$%&*|]"), 3)


def document_failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Documents by part and failure set: ``part, fails, n, good, toxic``.

    ``docs(doc_id, text, <part>)``; a NULL part counts as the empty string. E (bit 4) is a text that a smaller ``doc_id`` of the
    whole table has, too, whether that one is kept or not. ``labels(doc_id, quality, toxic)`` say which documents are good
    (quality 1) and toxic (1); several rows of one id count as one with the larger value. ``good`` and ``toxic`` count documents of the set.

    NULL and empty texts are the same text. Rows of one id and text are equal, none is smaller: they all fail E or none does. A
    NULL id is neither smaller nor larger than another: such a row never fails E, makes no other fail and has no label. An empty
    table gives no rows. Other columns are not looked at.

    Texts don't move: they stand for each other by SHA-256. Rows are first counted by part, text and id (so a repeated id or text shrinks
    before any join), then by part and text, where the smallest id is parted from the rest. Only the least id of a text is looked up
    in the whole table, by counted rows: one for each part of a text, not one for each copy.
    """
    rows = docs.select(
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col("doc_id").alias("id"),
        F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest"),
        failing(F.col("text")).alias("own"),
    )
    per_id = rows.groupBy("part", "digest", "id").agg(F.max("own").alias("own"), F.count(F.lit(1)).alias("n"))
    marks = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("id"))
        .agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("is_good"),
            F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("is_toxic"),
        )
    )
    marked = per_id.join(marks, "id", "left").select(
        "part", "digest", "id", "own", "n",
        (F.col("n") * F.coalesce("is_good", F.lit(0))).alias("good"),
        (F.col("n") * F.coalesce("is_toxic", F.lit(0))).alias("toxic"),
    )
    known = marked.where("id IS NOT NULL")
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    per_text = known.groupBy("part", "digest").agg(
        F.max("own").alias("own"),
        F.min_by(F.struct("id", "n", "good", "toxic"), "id").alias("first"),
        *sums,
    )
    least = per_text.groupBy("digest").agg(F.min("first.id").alias("least"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    # a text of one part has its smallest id there; only texts of several parts ask for it
    resolved = per_text.join(least.drop("parts"), "digest", "left").withColumn(
        "keeps", F.col("least").isNull() | (F.col("first.id") == F.col("least"))
    )
    by_set = resolved.select(
        "part",
        F.explode(
            F.array(
                *[
                    F.struct(
                        (F.col("own") + extra).alias("fails"),
                        *[value(c).cast("long").alias(c) for c in ("n", "good", "toxic")],
                    )
                    for extra, value in (
                        (0, lambda c: F.when(F.col("keeps"), F.col("first")[c]).otherwise(0)),
                        (16, lambda c: F.when(F.col("keeps"), F.col(c) - F.col("first")[c]).otherwise(F.col(c))),
                    )
                ]
            )
        ).alias("s"),
    ).select("part", "s.*")
    nameless = marked.where("id IS NULL").select("part", F.col("own").alias("fails"), "n", "good", "toxic")
    return by_set.unionByName(nameless).where("n > 0").groupBy("part", "fails").agg(*sums)


def shapley_weights(m: int) -> list[list[int]]:
    """Row i, column S: what ``v(S)`` adds to ``m!`` times the Shapley value of filter i.

    Solves the constrained normal equations ``[[A, 1], [1', 0]] [phi, t] = [b, v(all)]`` by elimination in rationals, for all unit
    vectors of v at once; ``A_ij = sum of k(|S|) over S with i and j``, ``b_i = sum of k(|S|) v(S) over S with i``.
    """
    everything = (1 << m) - 1
    kernel = {s: Fraction(m - 1, comb(m, s.bit_count()) * s.bit_count() * (m - s.bit_count())) for s in range(1, everything)}
    rows = []
    for i in range(m):
        left = [sum((k for s, k in kernel.items() if s >> i & s >> j & 1), Fraction(0)) for j in range(m)] + [Fraction(1)]
        rows.append(left + [kernel[s] if s in kernel and s >> i & 1 else Fraction(0) for s in range(everything + 1)])
    rows.append([Fraction(1)] * m + [Fraction(0)] + [Fraction(int(s == everything)) for s in range(everything + 1)])
    for at in range(m + 1):
        pivot = next(r for r in range(at, m + 1) if rows[r][at])
        rows[at], rows[pivot] = rows[pivot], rows[at]
        rows[at] = [x / rows[at][at] for x in rows[at]]
        for r in range(m + 1):
            if r != at and rows[r][at]:
                rows[r] = [x - rows[r][at] * y for x, y in zip(rows[r], rows[at])]
    whole = [[x * factorial(m) for x in rows[i][m + 1 :]] for i in range(m)]
    if any(x.denominator != 1 for row in whole for x in row):
        raise ArithmeticError("the normal equations were not solved exactly")
    return [[int(x) for x in row] for row in whole]


def audit(sets: DataFrame, names: str = NAMES) -> DataFrame:
    """Every step of every order of the filters, for each part.

    ``sets(part, fails, n, good, toxic)`` count documents by failure set (bit i: filter ``names[i]``). One row per part, order and step, zeros
    included: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``. ``redundant`` fail the step's filter but
    are gone already, ``unique_fails`` fail no other. ``shapley`` is m! times the filter's Shapley value of ``v``, which is
    what it removes summed over all m! orders. A part's sets may come in several rows. An empty table gives no rows.
    """
    m = len(names)
    if not 2 <= m <= MOST_FILTERS or len(set(names)) != m:
        raise ValueError(f"2 to {MOST_FILTERS} different one-letter filters")
    everything = (1 << m) - 1
    counted = sets.groupBy("part", "fails").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    # at most 2^m rows a part
    table = counted.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"), F.sum("n").alias("all"))

    def removed_by(what: str) -> Column:
        """v for all coalitions: documents that fail one of their filters."""
        return F.transform(
            F.sequence(F.lit(0), F.lit(everything)),
            lambda s: F.aggregate(
                F.filter("sets", lambda x: x["fails"].bitwiseAND(s) != 0), F.lit(0).cast("long"), lambda acc, x: acc + x[what]
            ),
        )

    weights = F.array(*[F.array(*[F.lit(w).cast("long") for w in row]) for row in shapley_weights(m)])
    coalitions = table.select(
        "part", "all", removed_by("n").alias("v"), removed_by("good").alias("v_good"), removed_by("toxic").alias("v_toxic"),
    ).withColumn(
        "phi",
        F.transform(weights, lambda row: F.aggregate(F.zip_with(row, "v", lambda w, x: w * x), F.lit(0).cast("long"), lambda acc, x: acc + x)),
    )
    orders = F.array(*[F.lit("".join(p)) for p in permutations(names)])
    steps = coalitions.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(m))))
    # filters at places before the step
    before = reduce(
        Column.__add__, [F.when(F.instr("filter_order", c) < F.col("step"), 1 << i).otherwise(0) for i, c in enumerate(names)]
    )
    mine = F.instr(F.lit(names), F.expr("substring(filter_order, step, 1)")) - 1
    steps = steps.withColumns({"before": before, "mine": mine})
    own = F.expr("shiftleft(1, mine)")

    def lost(v: str) -> Column:
        return F.get(v, F.col("before") + own) - F.get(v, F.col("before"))

    return steps.select(
        "part", "filter_order", "step",
        (F.col("all") - F.get("v", F.col("before") + own)).alias("kept"),
        lost("v").alias("removed"),
        (F.get("v", own) - lost("v")).alias("redundant"),
        (F.get("v", F.lit(everything)) - F.get("v", everything - own)).alias("unique_fails"),
        lost("v_good").alias("good_lost"),
        lost("v_toxic").alias("toxic_lost"),
        F.get("phi", F.col("mine")).alias("shapley"),
    )
