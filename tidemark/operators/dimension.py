"""Names for steps from a dimension: the deepest name reached, what stays reachable, and the mass of paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.checks import must
from tidemark.functions.shared import keep, parted


def destination(label: Column, reachable: Column) -> Column:
    """A label only where it is a choice: null while several labels are still reachable."""
    return F.when(reachable == 1, label)


def choices(least: Column, greatest: Column) -> Column:
    """Whether no label is reachable (0), one (1) or several (2), of the least and the greatest: no set of labels is kept."""
    return F.when(least.isNull(), 0).when(least == greatest, 1).otherwise(2)


def theory_share(depth: Column, available: Column) -> Column:
    """Depth used of the depth there is; 0 for what has no name."""
    return F.when(F.coalesce(available, F.lit(0)) == 0, 0.0).otherwise(F.coalesce(depth, F.lit(0)).cast("double") / available)


def checked_dimension(rows: DataFrame, key: str) -> DataFrame:
    """The dimension, failing if a key comes twice."""
    n = F.count("*").over(W.partitionBy(key))
    return rows.withColumn("_n", n).filter(must(F.col("_n") == 1, F.concat(F.lit("duplicate key: "), F.col(key).cast("string")))).drop("_n")


def deepest(steps: DataFrame, book: DataFrame, sequence: str, step: str, key: str, entry: list[str]) -> DataFrame:
    """For each sequence the book entry of its last named step; sequences without one keep nulls."""
    hit = steps.select(sequence, step, key).join(book, key, "left").filter(F.col(entry[0]).isNotNull())
    best = hit.groupBy(sequence).agg(F.max_by(F.struct(*entry, F.col(step).alias("depth")), step).alias("e")).select(sequence, "e.*")
    return steps.select(sequence).distinct().join(best, sequence, "left")


def progression(steps: DataFrame, sequence: str, step: str, label: str) -> DataFrame:
    """The label in force after each step."""
    run = W.partitionBy(sequence).orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    return steps.withColumn("in_force", F.last(label, ignorenulls=True).over(run))


def continuations(paths: DataFrame, path: str, key: str, depth: str, levels: list[str]) -> DataFrame:
    """For each key: the depth of the deepest path through it, and how many labels of each level are reachable from it."""
    dealt = parted(paths.select(path, key, depth, *levels), path)
    reach = dealt.groupBy(path).agg(F.max(depth).alias("_deep"), F.max_by(F.struct(*levels), depth).alias("_e"))
    seen = dealt.select(path, key).distinct().join(reach, path).select(key, "_deep", "_e.*")
    # a row for each level, with its label alone; they are made distinct in tasks that the input's size sets
    one = lambda i: F.struct(F.lit(i).alias("_level"), *[(F.col(c) if i == j else F.lit(None).cast(seen.schema[c].dataType)).alias(c) for j, c in enumerate(levels)])
    rows = seen.select(key, "_deep", F.explode(F.array(*[one(i) for i in range(len(levels))])).alias("_e")).select(key, "_deep", "_e.*")
    labels = parted(rows, key, "_level", *levels).groupBy(key, "_level", *levels).agg(F.max("_deep").alias("_deep"))
    return labels.groupBy(key).agg(F.max("_deep").alias("available"), *[F.count(c).alias(f"n_{c}") for c in levels])


#: How far above 1 the shares of one state's continuations may sum.
MASS_SLACK = 1e-6


def expanded(frontier: DataFrame, transitions: DataFrame) -> DataFrame:
    """``(state, next, p)`` of the frontier's states, from a table of transitions; states without one have no row."""
    return transitions.join(frontier.select("state").distinct(), "state", "left_semi").select("state", "next", "p")


def mass_ledger(start: DataFrame, expand: Callable[[DataFrame], DataFrame], plies: int, threshold: float, committed: DataFrame | None = None) -> DataFrame:
    """``(kind, state, mass)``: where the mass of ``start(state, mass)`` is after a number of plies; all of it, once.

    ``expand(frontier)`` gives ``(state, next, p)`` for the states of a frontier; what a state's shares leave over ends
    there. Kinds: ``settled``, in a state after the last ply; ``terminal``, ended in its state; ``pruned``, under the
    threshold in a ``committed(state)`` one, whose label can't change any more; ``unsettled``, under it elsewhere. The
    frontier is one row for each state at every ply, whatever the number of paths, and is written once.
    """
    if plies < 1 or not 0 < threshold <= 1:
        raise ValueError("a walk needs a ply and a threshold over 0 and up to 1")
    kinds = start.schema["state"].dataType
    known = committed.select("state").distinct() if committed is not None else None
    frontier, ledger = keep(start.groupBy("state").agg(F.sum("mass").alias("mass")), "frontier"), None

    def book(rows: DataFrame, kind: Column) -> None:
        nonlocal ledger
        rows = rows.select(kind.alias("kind"), F.col("state").cast(kinds).alias("state"), "mass")
        ledger = rows if ledger is None else ledger.unionByName(rows)

    for _ in range(plies):
        small = frontier.filter(F.col("mass") < threshold)
        if known is None:
            book(small, F.lit("unsettled"))
        else:
            book(small.join(known, "state", "left_semi"), F.lit("pruned"))
            book(small.join(known, "state", "left_anti"), F.lit("unsettled"))
        large = frontier.filter(F.col("mass") >= threshold)
        moves = keep(expand(large).filter(F.col("p") > 0).select(F.col("state").alias("_from"), F.col("next").cast(kinds).alias("next"), "p"), "moves")
        spent = moves.groupBy("_from").agg(F.sum("p").alias("_spent")).filter(must(F.col("_spent") <= 1 + MASS_SLACK, "a state's shares sum to more than 1"))
        rest = large.join(spent, F.col("state").eqNullSafe(F.col("_from")), "left").select("state", (F.col("mass") * F.greatest(F.lit(0.0), 1 - F.coalesce("_spent", F.lit(0.0)))).alias("mass"))
        book(rest.filter("mass > 0"), F.lit("terminal"))
        grown = large.join(moves, F.col("state").eqNullSafe(F.col("_from"))).select(F.col("next").alias("state"), (F.col("mass") * F.col("p")).alias("mass"))
        frontier = keep(grown.groupBy("state").agg(F.sum("mass").alias("mass")), "frontier")
    book(frontier, F.lit("settled"))
    return ledger.groupBy("kind", "state").agg(F.sum("mass").alias("mass"))


def path_mass(transitions: DataFrame, start: DataFrame, plies: int, threshold: float, committed: DataFrame | None = None) -> DataFrame:
    """The ledger of a walk by a table of transitions ``(state, next, p)``."""
    return mass_ledger(start, lambda frontier: expanded(frontier, transitions), plies, threshold, committed)
