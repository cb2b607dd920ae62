"""Exact order statistics of groups of any size, by counting passes and without a sort or a map of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.shared import keep

#: Bins of a pass, and the number of brackets up to which they go to every task.
BINS, MOST_HELD = 1024, 100_000


def same(keys: Sequence[str], prefix: str = "_k") -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"{prefix}{i}")) for i, c in enumerate(keys)]


def renamed(rows: DataFrame, keys: Sequence[str], *others: Column | str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *others)


def bin_of(v: Column, low: Column, high: Column) -> Column:
    """The bin of a value between two finite ends, halved so that their distance is finite; other values have bins of their own."""
    inside = F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * BINS).cast("int")
    return F.when(F.isnan(v), BINS + 2).when(v == float("inf"), BINS + 1).when(v == float("-inf"), -1).when(v >= high, BINS).when(v <= low, 0).otherwise(inside)


def held(rows: DataFrame) -> DataFrame:
    """``rows`` for every task if they are few, else as they are, so that a join with them deals both sides out."""
    return F.broadcast(rows) if rows.limit(MOST_HELD + 1).count() <= MOST_HELD else rows


def nth_values(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], value: str, k: str, rounds: int = 256) -> DataFrame:
    """``(*keys, k, nth)`` for ``wanted(*keys, k)``: the value with ``k`` values before it in the order of its group.

    Each round counts the rows in the bins of a bracket; the bin that holds the wanted place, from its least to its
    greatest value, is the next bracket, until these are one. Counts are combined in the tasks, so a round moves a
    row for each task and bin. Nulls don't count, NaN is the greatest value; places past the end have no row.
    """
    data = keep(rows.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null"), "order-values")
    finite = ~F.isnan("_v") & ~F.col("_v").isin(float("inf"), float("-inf"))
    ends = data.groupBy(*keys).agg(F.coalesce(F.min(F.when(finite, F.col("_v"))), F.lit(0.0)).alias("_lo"), F.coalesce(F.max(F.when(finite, F.col("_v"))), F.lit(0.0)).alias("_hi"))
    goal = renamed(wanted, keys, F.col(k).cast("long").alias("_want")).distinct()
    state = [f"_k{i}" for i in range(len(keys))]
    first = ends.join(goal, same(keys)) if keys else ends.crossJoin(F.broadcast(goal))
    open_ = keep(first.select(*state, "_want", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.lit(True).alias("_first")), "brackets")
    done = None
    for _ in range(rounds):
        brackets = held(open_.select(*state, "_lo", "_hi", "_first").distinct())
        inside = F.col("_first") | F.col("_v").between(F.col("_lo"), F.col("_hi"))
        met = data.join(brackets, [*same(keys), inside]).withColumn("_bin", bin_of(F.col("_v"), F.col("_lo"), F.col("_hi")))
        counts = met.groupBy(*state, "_lo", "_hi", "_bin").agg(F.count("*").alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        upto = F.sum("_n").over(W.partitionBy(*state, "_lo", "_hi").orderBy("_bin").rowsBetween(W.unboundedPreceding, 0))
        counts = counts.select(*[F.col(c).alias(f"_b{c}") for c in state], F.col("_lo").alias("_blo"), F.col("_hi").alias("_bhi"), "_n", "_a", "_b", upto.alias("_upto"))
        place = F.col("_want") - F.col("_below")
        here = [F.col(c).eqNullSafe(F.col(f"_b{c}")) for c in state] + [F.col("_lo") == F.col("_blo"), F.col("_hi") == F.col("_bhi"), place >= F.col("_upto") - F.col("_n"), place < F.col("_upto")]
        found = keep(open_.join(counts, here).select(*state, "_want", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), (F.col("_below") + F.col("_upto") - F.col("_n")).alias("_below"), F.lit(False).alias("_first")), "brackets")
        settled = found.filter("_lo = _hi")
        done = settled if done is None else done.unionByName(settled)
        open_ = found.filter("_lo <> _hi")
        if open_.isEmpty():
            return done.select(*[F.col(s).alias(c) for s, c in zip(state, keys)], F.col("_want").alias(k), F.col("_lo").alias("nth"))
    raise RuntimeError(f"brackets did not close in {rounds} rounds")


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``(*keys, *shares)``: exact percentiles, between two values in proportion, as ``percentile`` gives them."""
    sizes = rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    at = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("_n") - 1)).alias("at")) for name, p in shares.items()])
    spots = keep(sizes.select(*keys, F.explode(at).alias("s")).select(*keys, F.col("s.name").alias("_name"), F.col("s.at").alias("_at")), "spots")
    ends = spots.select(*keys, F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_k"))
    found = nth_values(rows, ends, keys, value, "_k")
    ends = [renamed(found, keys, F.col("_k").alias(f"_k_{e}"), F.col("nth").alias(f"_{e}")) for e in ("low", "high")]
    out = spots.withColumns({"_fl": F.floor("_at"), "_ce": F.ceil("_at")})
    for end, at, name in zip(ends, ("_fl", "_ce"), ("low", "high")):
        out = out.join(end, [*same(keys), F.col(at) == F.col(f"_k_{name}")]).drop(*[f"_k{i}" for i in range(len(keys))], f"_k_{name}")
    part = F.col("_at") - F.col("_fl")
    value_ = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise((1 - part) * F.col("_low") + part * F.col("_high"))
    return out.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, value_)).alias(name) for name in shares])
